"""The n-gram Jaccard join against brute force over all pairs."""

import random

import numpy as np
import pytest

from obslake.llm import jaccard_join as J
from obslake.llm.components import components

from .helpers import docs, least, odd_rows, words


def brute(rows, percent=85):
    sets, ids = [], []
    for i, t in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
        ids.append(i)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            same = ids[a] == ids[b]
            i = len(sets[a] & sets[b])
            if same or (i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i)):
                up[find(a)] = find(b)
    low = {}
    for k in range(len(rows)):
        r = find(k)
        low[r] = min(low.get(r, (1 << 62, None)), (least(ids[k]), ids[k]))
    return sorted((least(ids[k]), len(sets[k]), least(low[find(k)][1])) for k in range(len(rows)))


def got(frame):
    return sorted((least(r["doc_id"]), r["n_shingles"], least(r["component_id"])) for r in frame.collect())


def near_copies(n, size, changes, seed=1):
    """n texts of one source, each with its own few changed words: a large group, linked in part."""
    r = random.Random(seed)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(size)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(size)] = f"x{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    return rows


def test_odd_rows(spark):
    rows = odd_rows(4, n=50, longest=40)
    assert got(J.near_duplicates(docs(spark, rows), block_bytes=2000)) == brute(rows)


@pytest.mark.parametrize("chunk", [512, 4])
def test_large_groups_in_chunks(spark, chunk):
    """Meetings past the chunk size are dealt out, and no component is lost."""
    rows = near_copies(40, 120, 8) + [(100 + i, t) for i, t in near_copies(20, 60, 3, seed=2)]
    assert got(J.near_duplicates(docs(spark, rows), chunk=chunk)) == brute(rows)


def test_empty_table(spark):
    assert J.near_duplicates(docs(spark, [])).count() == 0


def test_trie_finds_all_links():
    r = random.Random(6)
    for _ in range(60):
        base = [sorted(r.sample(range(200), r.randint(1, 40))) for _ in range(4)]
        sets = []
        for _ in range(14):
            s = set(r.choice(base))
            for _ in range(r.randint(0, 4)):
                s ^= {r.randrange(200)}
            sets.append(np.array(sorted(s or {1}), np.int64))
        _, known = J.trie_join(sets, 85)
        up = J.Union(len(sets))
        for a in range(len(sets)):
            for b in range(a):
                i = len(np.intersect1d(sets[a], sets[b]))
                if 100 * i >= 85 * (len(sets[a]) + len(sets[b]) - i):
                    up.join(a, b)
        assert [known.find(i) for i in range(len(sets))] == [up.find(i) for i in range(len(sets))]


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 200), (7, 7)], "u long, v long")
    rows = {r["node"]: r["component"] for r in components(edges).collect()}
    assert set(rows.values()) == {0, 100} and rows[40] == 0 and rows[200] == 100
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
