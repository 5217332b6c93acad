"""Substring and suffix-array dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from obslake.llm import blocks as B
from obslake.llm import substring_dedup, suffix_dedup

from .helpers import docs, least, odd_rows, words


def brute_windows(rows, size):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (least(r[0]), r[1] or "")):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen:
                gone[s : s + size] = [True] * size
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.setdefault(i, []).append((len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def collected(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(tuple(r[1:]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_match_brute_force(spark, seed):
    rows = odd_rows(seed)
    got = substring_dedup.dedup(docs(spark, rows), digest=True, block_bytes=2000)
    assert "lang" in got.columns and got.columns.count("n_words") == 1
    assert collected(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_windows(rows, 20)


def test_ranges_parted_by_arithmetic(spark, monkeypatch):
    """Few quantiles and many blocks: blocks still follow the order of the ids."""
    monkeypatch.setattr(B, "MOST_RANGES", 3)
    rows = odd_rows(3)
    d = docs(spark, rows)
    cuts = B.cut_points(d, "doc_id", "text", 1000)
    blocks = sorted((least(r["doc_id"]), r[B.BLOCK]) for r in B.with_block(d, "doc_id", cuts).collect())
    assert cuts.parts > 3 and [b for _, b in blocks] == sorted(b for _, b in blocks) and len({b for _, b in blocks}) > 5
    got = substring_dedup.dedup(d, digest=True, block_bytes=1000)
    assert collected(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_windows(rows, 20)


def test_repeated_rows_keep_one(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(30)))] * 3
    got = substring_dedup.dedup(docs(spark, rows)).orderBy("n_removed").collect()
    assert [r["n_removed"] for r in got] == [0, 30, 30] and got[1]["text"] == ""


def test_empty_table(spark):
    none = docs(spark, [])
    assert substring_dedup.dedup(none).count() == 0
    assert suffix_dedup.dedup(none).count() == 0


def test_untouched_text_stays(spark):
    got = substring_dedup.dedup(docs(spark, [(1, "a  b\tc"), (2, None)])).orderBy("doc_id").collect()
    assert got[0]["text"] == "a  b\tc" and got[1]["text"] is None


def test_cover_positions_meet():
    """Any two starts have a shift under the period that brings both onto the cover."""
    p, cover = substring_dedup.PERIOD, set(substring_dedup.COVER)
    assert all(any((i + d) % p in cover and (j + d) % p in cover for d in range(p)) for i in range(p) for j in range(p))


def brute_bytes(rows, size):
    first = {}
    enc = [(least(i), i, (t or "").encode()) for i, t in rows]
    for k, _, b in sorted(enc, key=lambda x: x[0]):
        for s in range(len(b) - size + 1):
            first.setdefault(b[s : s + size], k)
    out = {}
    for k, i, b in enc:
        gone = bytearray(len(b))
        for s in range(len(b) - size + 1):
            if first[b[s : s + size]] < k:
                gone[s : s + size] = b"\1" * size
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.setdefault(i, []).append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, seed):
    rows = odd_rows(seed, longest=60)
    got = suffix_dedup.dedup(docs(spark, rows), digest=True, block_bytes=1500)
    assert collected(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute_bytes(rows, 50)


def test_spans_and_kept_bytes(spark):
    text = "".join(random.Random(5).choice("abcdefgh") for _ in range(200))
    got = suffix_dedup.dedup(docs(spark, [(1, text), (2, "X" * 10 + text[50:150] + "Y" * 10)])).orderBy("doc_id").collect()
    assert got[0]["spans"] == [] and bytes(got[0]["kept"]).decode() == text
    assert [tuple(s) for s in got[1]["spans"]] == [(10, 110)] and bytes(got[1]["kept"]) == b"X" * 10 + b"Y" * 10


def test_maximal_repeats_cover_all_common_windows():
    r, size, width = random.Random(3), 5, 12
    for _ in range(200):
        segs = list({"".join(r.choice("ab") for _ in range(r.randint(size, width))) for _ in range(r.randint(1, 8))})
        m, sizes = np.zeros((len(segs), width), np.uint8), np.array([len(s) for s in segs])
        for i, s in enumerate(segs):
            m[i, : len(s)] = list(s.encode())
        length, group, seg, off = suffix_dedup.repeats_of(m, sizes, size)
        found = {}
        for k in range(len(group)):
            members = set(seg[group == group[k]].tolist())
            text = segs[seg[k]][off[k] : off[k] + length[group[k]]]
            assert all(text in segs[x] for x in members)
            for o in range(off[k], off[k] + length[group[k]] - size + 1):
                found.setdefault((int(seg[k]), int(o)), set()).update(members)
        for i, s in enumerate(segs):
            for o in range(len(s) - size + 1):
                holders = {k for k, x in enumerate(segs) if s[o : o + size] in x}
                assert len(holders) == 1 or found.get((i, o)) == holders


def test_only_windows_around_a_shared_anchor_are_hashed(spark, monkeypatch):
    """Anchors are hashed at cover positions only, windows only where an anchor in them occurs twice."""
    seen = []
    plain = substring_dedup.window_hash
    monkeypatch.setattr(substring_dedup, "window_hash", lambda h, n, seed=0, at=None: (seen.append((n, at)), plain(h, n, seed, at))[1])
    text = " ".join(f"w{k}" for k in range(100)) + " end " + " ".join(f"w{k}" for k in range(40, 65))
    buf = np.frombuffer(text.encode(), np.uint8)
    words = substring_dedup.Words(buf, np.array([0, len(buf)]))
    at, _ = substring_dedup._anchors(words, 20)
    assert {int(k) % 13 for k in at} == {0, 1, 3, 9} and (seen[-1][1] == at).all()
    frame = docs(spark, [(1, text)])
    assert [(r["n_words"], r["n_removed"]) for r in substring_dedup.dedup(frame).collect()] == [(126, 25)]
    at = np.arange(40, 45)
    assert (substring_dedup._windows(words, at, 20)[0] == plain(words.hashes, 20)[at]).all()


def test_very_long_documents(spark):
    r = random.Random(11)
    base = [f"w{r.randint(0, 5000)}" for _ in range(120_000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[50_000:50_400])), (3, " ".join(base[:30] + ["x"] + base[70_000:70_100])), (4, None)]
    got = substring_dedup.dedup(docs(spark, rows), digest=True, block_bytes=100_000)
    assert collected(got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_windows(rows, 20)


@pytest.mark.parametrize("hot", [0, 2])
def test_hot_minimizers_are_split(spark, hot):
    """Minimizers of many segments are dealt out window by window, with the same result."""
    rows = odd_rows(3, longest=60)
    got = suffix_dedup.dedup(docs(spark, rows), digest=True, block_bytes=1500, hot=hot)
    assert "lang" in got.columns and got.columns.count("n_words") == 1
    assert collected(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute_bytes(rows, 50)


@pytest.mark.parametrize("hot", [4096, 1])
def test_repeat_groups_have_all_occurrences(spark, hot):
    r = random.Random(4)
    page = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    shared = [page(130) for _ in range(3)]
    rows = [(i, page(r.randint(0, 30)) + r.choice(shared) + page(20) + r.choice(shared)[r.randint(0, 60) :]) for i in range(12)]
    rows += [(20, rows[0][1]), (21, rows[0][1]), (22, page(90)), (23, None)]
    text = {i: (t or "").encode() for i, t in rows}
    found = suffix_dedup.repeat_groups(docs(spark, rows), block_bytes=600, hot=hot).collect()
    groups = {}
    for g in found:
        groups.setdefault(g["repeat"], set()).add((g["doc_id"], g["start"], text[g["doc_id"]][g["start"] : g["start"] + g["size"]]))
    for members in groups.values():
        (content,) = {c for _, _, c in members}
        every = {(i, s) for i, t in text.items() for s in range(len(t) - len(content) + 1) if t[s : s + len(content)] == content}
        assert {(i, s) for i, s, _ in members} == every and len({i for i, _ in every}) > 1
    windows = {}
    for i, t in text.items():
        for s in range(len(t) - 49):
            windows.setdefault(t[s : s + 50], set()).add((i, s))
    covered = {(i, s + k) for members in groups.values() for i, s, c in members for k in range(len(c) - 49)}
    assert covered == {p for w in windows.values() if len({i for i, _ in w}) > 1 for p in w}
    assert suffix_dedup.repeat_groups(docs(spark, [])).count() == 0
