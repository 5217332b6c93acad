"""Substring dedup by difference-cover anchors.

A window is `window` consecutive words of one document.  Every word covered by a
window whose word sequence also starts earlier (smaller id, or the same document
and an earlier start) is removed; windows are judged on the input.

Method.  D = {0, 1, 3, 9} is a difference cover modulo 13: for any two starts i
and j there is a shift under 13 that brings both onto positions in D.  So two
equal windows of 20 words share an anchor, the 8 words at an aligned cover
position, and only anchors at cover positions are hashed and looked up (4 of 13
positions), inside a block as between blocks.  Where an anchor occurs twice, its
match is extended: the windows around it are compared as wholes, by two hashes of
their 20 words (96 bits between blocks, 128 inside one), and the first occurrence
keeps its words.  No other window is ever hashed.

Edge cases: null or blank text has no words and stays as it is;
documents shorter than a window are never cut; very long texts are read whole, in a
block of their own size; rows with one id are documents of their own, ordered by
text; extra columns pass through; a result column replaces an input column of its
name; an empty table gives an empty table.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import blocks as B
from .common import extended, none_of, sha256, with_columns
from .text import Words, column_bytes, covered, inside_document, window_hash

PERIOD, COVER = 13, (0, 1, 3, 9)


def cover_positions(offsets: np.ndarray) -> np.ndarray:
    """Marks the positions of each document that are in the cover modulo the period."""
    within = np.arange(offsets[-1]) - np.repeat(offsets[:-1], np.diff(offsets))
    at = np.zeros(PERIOD, bool)
    at[list(COVER)] = True
    return at[within % PERIOD]


def _anchors(words: Words, window: int):
    """Positions and hashes of the anchors."""
    size = window - PERIOD + 1
    ok = (inside_document(words.offsets, size) & cover_positions(words.offsets))[: max(0, len(words) - size + 1)]
    at = np.flatnonzero(ok)
    return at, window_hash(words.hashes, size, at=at)


def _first_of(keys: np.ndarray):
    """Indices of the first occurrence of each distinct key, sorted by key, and for each item the number of its key and how often it occurs."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    first = np.minimum.reduceat(order, starts) if len(starts) else starts
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return first, number, np.diff(np.concatenate([starts, [len(k)]]))


def _windows(words: Words, at: np.ndarray, window: int):
    """Two hashes of the windows at some positions, the number of each among the distinct ones, and the first of each of those."""
    one, two = window_hash(words.hashes, window, at=at), window_hash(words.hashes, window, seed=77, at=at)
    _, a, _ = _first_of(one)
    _, b, _ = _first_of(two)
    first, number, _ = _first_of(a * (len(at) + 1) + b)
    return one, two, number, first


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, block_bytes: int | None = None, digest: bool = False) -> DataFrame:
    """df with text_col cut down to the kept words (joined by one space), n_words and n_removed; with digest, kept_sha256 in place of the text.

    A document from which nothing is removed keeps its text as it is.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be over {PERIOD} words")
    cuts = B.cut_points(df, id_col, text_col, block_bytes)
    n = cuts.buckets
    blocked = B.dealt(df, id_col, cuts)

    def words_of(table):
        table = B.ordered(table, id_col, text_col)
        buf, off = column_bytes(table.column(text_col))
        return table, buf, Words(buf, off)

    def send_anchors(table):
        block = table.column(B.BLOCK)[0].as_py()
        _, keys = _anchors(words_of(table)[2], window)
        keys = np.unique(keys)
        return B.scatter(block, B.bucket_of(keys, n), n, B.low48(keys))

    def shared(table):
        bucket = B.number_of(table, n)
        raw, lens = B.blob(table, "a")
        keys, counts = B.from48(raw), lens // 6
        block = np.repeat(table.column(B.BLOCK).to_numpy(), counts)
        place = np.concatenate([np.arange(c) for c in counts]).astype(np.uint32) if len(counts) else np.zeros(0, np.uint32)
        order = np.argsort(keys)
        k = keys[order]
        same = k[1:] == k[:-1]
        hit = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(k) else order
        return B.answers(bucket, block[hit], place[hit])

    def candidates(words, replies):
        """Positions of the windows that hold an anchor which occurs twice, in the block or (replies) in others."""
        at, keys = _anchors(words, window)
        first, number, counts = _first_of(keys)
        known = counts > 1
        if replies is not None:
            unique = keys[first]
            order, bounds = B.entry_index(unique, B.bucket_of(unique, n), n)
            known[B.answered(replies, order, bounds, {"a": np.uint32})[0]] = True
        marks = np.zeros(len(words) + PERIOD, np.int64)
        marks[at[known[number]]] = 1
        total = np.concatenate([[0], np.cumsum(marks)])
        i = np.arange(len(words))
        return np.flatnonzero(((total[i + PERIOD] - total[i]) > 0) & inside_document(words.offsets, window))

    def send_windows(table, replies):
        if not len(table):
            return B.empty(B.ENTRY_ARROW)
        block = table.column(B.BLOCK)[0].as_py()
        words = words_of(table)[2]
        at = candidates(words, replies)
        h, check, _, first = _windows(words, at, window)
        first = np.sort(first)
        return B.scatter(block, B.bucket_of(h[first], n), n, h[first].astype("<u8"), check[first].astype("<u4"), at[first].astype("<u4"))

    def earlier(table):
        bucket = B.number_of(table, n)
        raw, lens = B.blob(table, "a")
        h = np.frombuffer(raw.tobytes() if len(raw) else b"", "<u8")
        check = np.frombuffer(bytes(B.blob(table, "b")[0]), "<u4")
        at = np.frombuffer(bytes(B.blob(table, "c")[0]), "<u4")
        block = np.repeat(table.column(B.BLOCK).to_numpy(), lens // 8)
        if not len(h):
            return B.empty(B.ANSWER_ARROW)
        place = (block.astype(np.uint64) << np.uint64(32)) | at
        order = np.argsort(h)
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        c = check[order]
        if (~new[1:] & (c[1:] != c[:-1])).any():  # equal 64 bits, unequal check: sort by both
            order = np.lexsort((check, h))
            new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (check[order][1:] != check[order][:-1])])
        starts = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(place[order], starts), np.diff(np.concatenate([starts, [len(h)]])))
        gone = order[place[order] != least]
        return B.answers(bucket, block[gone], at[gone])

    out = extended(df.schema, n_words="long", n_removed="long", kept_sha256="string") if digest else extended(df.schema, n_words="long", n_removed="long")

    def cut(table, replies):
        if not len(table):
            return none_of(out)
        table, buf, words = words_of(table)
        at = candidates(words, None)
        first = _windows(words, at, window)[3]
        gone = np.ones(len(at), bool)
        gone[first] = False
        starts = np.zeros(len(words), bool)
        starts[at[gone]] = True
        if len(replies):
            starts[np.frombuffer(bytes(B.blob(replies, "a")[0]), "<u4")] = True
        removed = covered(starts, window)
        keep, counts, o = ~removed, words.counts, words.offsets
        lost = np.add.reduceat(np.concatenate([removed, [False]]).astype(np.int64), o[:-1]) * (counts > 0) if len(counts) else counts
        data, ends = buf.tobytes(), column_bytes(table.column(text_col))[1]
        kept = []
        for i in range(len(table)):
            w = data[ends[i] : ends[i + 1]].split()
            kept.append(b" ".join(compress(w, keep[o[i] : o[i + 1]].tolist()) if lost[i] else w))
        more = {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(lost, pa.int64())}
        table = table.drop_columns([B.BLOCK])
        if digest:
            return with_columns(table, **more, kept_sha256=pa.array([sha256(k) for k in kept], pa.string()))
        texts = pa.array(kept, pa.binary()).cast(pa.string())
        texts = pc.if_else(pa.array(lost > 0), texts, table.column(text_col))
        table = table.set_column(table.schema.get_field_index(text_col), text_col, texts)
        return with_columns(table, **more)

    anchors = B.by_bucket(B.per_block(blocked, send_anchors, B.ENTRY), cuts, shared)
    windows = B.by_bucket(B.with_answers(blocked, anchors, send_windows, B.ENTRY), cuts, earlier)
    return B.with_answers(blocked, windows, cut, out)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: per document n_words, n_removed and the digest of the kept words."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs, digest=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: windows are numbered over the whole table; the first of each word sequence stays
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(generate_series(1, len(w) - 19)) AS s, w FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, array_to_string(w[s:s+19], ' ') AS win FROM p),
e AS (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS r FROM k),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS i FROM e WHERE r > 1),
h AS (SELECT doc_id, list(i) AS gone, count(*) AS n FROM g GROUP BY doc_id),
x AS (SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_removed, w, coalesce(h.gone, []) AS gone FROM d LEFT JOIN h USING (doc_id)),
u AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d),
y AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN g ON g.doc_id = u.doc_id AND g.i = u.i GROUP BY u.doc_id)
SELECT x.doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM x LEFT JOIN y USING (doc_id)
"""
