"""Phrase collocations against a plain count, tiles and streams against numpy."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from obslake.llm import phrases as P

from .helpers import LOWER


def brute(rows, least, longest, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for k in range(len(w) - m + 1):
                    f[lang, tuple(w[k : k + m])] += 1
    out = {}
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        cut = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        l, r = f[lang, p[: cut[1]]], f[lang, p[cut[1] :]]  # noqa: E741
        hidden = any(g == lang and len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in f.items() if b >= least)
        if not hidden:
            out.setdefault(lang, []).append((-cut[0], -a, " ".join(p).encode(), l, r))
    return sorted((g, k + 1, p.decode(), -a, l, r, n[g], -s) for g, x in out.items() for k, (s, a, p, l, r) in enumerate(sorted(x)[:most]))


def texts(seed, n=120):
    r = random.Random(seed)
    words = ["red", "Red", "fox", "é", "ß", "x\x0by", "a", "b", "the", "C-3", "ÀB"]
    base = [r.choice([" ", "\t", ", ", ". ", " ; ", "\n", "  "]).join(r.choices(words, [1, 1, 4, 2, 1, 1, 6, 6, 9, 1, 1], k=r.randint(0, 40))) for _ in range(n)]
    rows = [(t, r.choice(["en", "en", "en", "de", None, "und"])) for t in base]
    return rows + [(None, "en"), ("", None), (" .,\n\t", "en"), ("the fox " * 3000, "en"), ("one two three four five six", "xx")] + rows[:30]


@pytest.mark.parametrize("least,longest,most", [(5, 5, 2000), (3, 4, 7), (1, 5, 50)])
def test_against_a_plain_count(spark, least, longest, most):
    rows = texts(least)
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in rows], "text string, lang string, rank int, l string").repartition(5)
    got = P.collocations(df, least=least, longest=longest, most=most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(rows, least, longest, most)


def test_numbers_by_shuffle_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(P, "SMALL", -1)
    rows = texts(9)
    got = P.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=4, longest=4)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 4, 2000)


def test_small_slices_buffers_and_tiles_give_the_same(spark, monkeypatch):
    """Many slices, many buffers, tiles of four by four, all dense or none: one result. Run in this process, over the same functions."""
    r = np.random.default_rng(5)
    x, y = (np.minimum(r.zipf(1.3, 20_000), 5000) + 10**10 for _ in range(2))
    want = Counter(zip(x.tolist(), y.tolist()))
    for tile, dense in ((4, 1), (4, 1 << 60), (64, 20), (1024, 100)):
        monkeypatch.setattr(P, "TILE", tile), monkeypatch.setattr(P, "DENSE", dense)
        l, rr, n = P.tile_counts(x, y, 10**10)  # noqa: E741
        assert dict(zip(zip(l.tolist(), rr.tolist()), n.tolist())) == want and len(l) == len(want)


def test_far_numbers_keep_their_pairs():
    x = np.array([5, 1 << 62, 5, 7]), np.array([1 << 61, 9, 1 << 61, 7])
    l, r, n = P.tile_counts(*x, 0)  # noqa: E741
    assert sorted(zip(l.tolist(), r.tolist(), n.tolist())) == [(5, 1 << 61, 2), (7, 7, 1), (1 << 62, 9, 1)]


def test_compacted_streams():
    c = lambda *x: P.compacted(np.array(x)).tolist()
    assert c(1, 2, -1, -1, 3, -1, 4, 5, 6) == [1, 2, -1, 4, 5, 6]
    assert c(-1, 3, -1) == [] and c(1) == [] and c() == []


def test_an_empty_table(spark):
    assert P.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_exact_arithmetic_past_64_bits(spark):
    n, a = 3 * 10**15, 10**14 + 7
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    rows = [("en", "a b", 2, a), ("en", "a", 1, a + 11), ("en", "b", 1, a + 13)]
    got = P.scored(totals, spark.createDataFrame(rows, "lang string, phrase string, m int, f long")).first()
    assert got["score"] == 1000 * a * n // ((a + 11) * (a + 13))


def test_scratch_tables_go(spark):
    from obslake.llm.common import Scratch

    with Scratch(spark, "t") as s:
        kept, gone = s.keep(spark.range(3).toDF("id")), s.result(spark.range(4).toDF("id"))
        assert kept.count() == 3
    assert gone.count() == 4
    with pytest.raises(Exception):
        kept.count()
