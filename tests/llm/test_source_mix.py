"""The source mix: targets against a plain water level, roundings against their expectation."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from obslake.llm import source_mix as M

from .helpers import words

SCHEMA = "doc_id long, text string, source string, size long, copies string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, -1, "x") for i, t, s in rows], SCHEMA)


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, target = Fraction(3 * sum(sizes.values()), 2), {}
    while True:
        rest = [s for s in names if s not in target]
        w = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / w >= 2 * sizes[s]]
        if not over:
            return {**target, **{s: left * weight[s] / w for s in rest}}
        for s in over:
            target[s] = Fraction(2 * sizes[s])
            left -= target[s]
        if len(over) == len(rest):
            return target


def corpus(seed, n, sources=("a", "b", "ä", None, "hot")):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.choice([0, 1, 3, 9, 30, 200])), r.choice([*sources, "hot", "hot"])) for i in range(n)]


@pytest.mark.parametrize("leaf,reserve,fan,top", [(1024, 16, 32, 64), (8, 2, 2, 4), (20, 1, 3, 64)])
def test_targets_and_words_taken(spark, monkeypatch, leaf, reserve, fan, top):
    """Whatever the tree, every row comes back once, within its bounds, and sources come near their targets."""
    rows = corpus(leaf, 700) + [(-1, None, "a"), (None, "x y", "a"), (None, "x y", "a"), (7, "x y z", "b"), (7, "x y z", "b"), (800, "word " * 20_000, "hot"), (801, None, "empty"), (802, " \t", "empty")]
    monkeypatch.setattr(M, "LEAF", leaf), monkeypatch.setattr(M, "RESERVE", reserve), monkeypatch.setattr(M, "FAN", fan), monkeypatch.setattr(M, "TOP", top)
    got = M.copies(table(spark, rows).repartition(5)).collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = brute_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(words(t))) for i, t, _ in rows)
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 for r in got)
    source = {(i, len(words(t))): s for i, t, s in rows}
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and abs(r["target"] - float(want[s])) < 1e-6
    largest = {s: max(len(words(t)) for _, t, c in rows if c == s) for s in sizes}
    assert all(abs(taken[s] - float(want[s])) <= (15 if top == 64 and largest[s] <= 200 else largest[s] / 2) for s in sizes), (taken, want)


def test_reruns_and_partitions_agree(spark):
    rows = corpus(5, 3000)
    runs = [sorted((r["doc_id"], r["taken"]) for r in M.copies(table(spark, rows).repartition(n)).collect()) for n in (1, 7)]
    assert runs[0] == runs[1]
    other = sorted((r["doc_id"], r["taken"]) for r in M.copies(table(spark, rows), seed=8).collect())
    assert other != runs[0]


def test_meetings_keep_words_and_expectations():
    r = random.Random(1)
    for _ in range(200):
        a, b = (r.randint(1, 50), r.random()), (r.randint(1, 50), r.random())
        up, down = min(a[0] * (1 - a[1]), b[0] * b[1]), min(a[0] * a[1], b[0] * (1 - b[1]))
        ends = [M.meet(a, b, 0.0), M.meet(a, b, 1.0)]
        for p, q in ends:
            assert abs(a[0] * p + b[0] * q - a[0] * a[1] - b[0] * b[1]) < 1e-9 and {p, q} & {0.0, 1.0}
        odds = down / (up + down)
        assert abs(odds * ends[0][0] + (1 - odds) * ends[1][0] - a[1]) < 1e-9


def test_the_last_in_turn_keep_expectations():
    r, n = random.Random(2), 4000
    sizes, p = [9, 7, 6, 5, 5, *[4] * 15, *[3] * 10, *[1] * 9], 0.37
    seen = [M.in_turn([(s, p) for s in sizes], [r.random() for _ in sizes]) for _ in range(n)]
    for k in range(20):
        assert abs(sum(x[k] for x in seen) / n - p) < 0.03
    assert all(abs(sum(s * x for s, x in zip(sizes, got)) - p * sum(sizes)) <= 2 for got in seen)


def test_the_mix_itself_and_an_empty_table(spark):
    docs = table(spark, corpus(9, 200))
    taken = {r["doc_id"]: r["copies"] for r in M.copies(docs).collect()}
    assert Counter(r["doc_id"] for r in M.mixed(docs).collect()) == Counter({k: v for k, v in taken.items() if v})
    assert M.copies(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        M.mixed(table(spark, [(1, "a", "s"), (1, "b", "s")]))
