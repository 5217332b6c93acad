"""The pipeline's near-duplicate stage against brute force at five words and 80 %."""

import random

import corpus_pipeline

from .helpers import docs, least, odd_rows, words


def groups(rows):
    """Components of the rows: near copies, and rows of one text."""
    sets = []
    for _, t in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    of = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if rows[a] == rows[b] or (i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i)):
                of = [of[b] if x == of[a] else x for x in of]
    return {g: [r for r, x in zip(rows, of) if x == g] for g in set(of)}


def kept(spark, sf_dir, rows):
    out = corpus_pipeline.drop_near_duplicates(spark, docs(spark, rows), sf_dir)
    return [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()]


def check(rows, got):
    """One row of each group is left, of its least id."""
    found = groups(rows)
    assert len(got) == len(found)
    for group in found.values():
        (stays,) = set(group) & set(got)
        assert least(stays[0]) == min(least(i) for i, _ in group)


def changed(words_, k, r):
    out = list(words_)
    out[r.randrange(20, len(out) - 20)] = f"x{k}"
    return " ".join(out)


def test_copies_at_five_words_and_eighty_percent(spark, sf_dir):
    """Texts whose shingles of four words agree by less than 85 %, and those of five by 80 % and more, are copies."""
    r = random.Random(3)
    rows = []
    for k in range(12):
        base = [f"w{k}-{i}" for i in range(50)]
        rows += [(100 * k, " ".join(base)), (100 * k + 1, changed(base, k, r))]
    check(rows, kept(spark, sf_dir, rows))


def test_rows_of_one_id_and_of_none(spark, sf_dir):
    """Rows are dropped for their texts only: null and repeated ids stay with different texts, and one of equal rows stays."""
    r = random.Random(4)
    base, other = ([f"{n}{i}" for i in range(60)] for n in "ab")
    rows = [(None, f"a text of its own number {k} {k * k}") for k in range(6)] + [(7, f"another text under seven {k} {k * k}") for k in range(6)]
    rows += [(None, " ".join(base)), (3, changed(base, 1, r)), (None, " ".join(other)), (4, changed(other, 2, r)), (9, "the same row twice"), (9, "the same row twice"), (None, None), (None, "")]
    check(rows, kept(spark, sf_dir, rows))
    rows = odd_rows(8, n=40, longest=30)
    check(rows, kept(spark, sf_dir, rows))
