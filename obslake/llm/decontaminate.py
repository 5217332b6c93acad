"""Benchmark decontamination with a generalised suffix automaton.

Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII.
A window is `window` consecutive words of one benchmark item; a shorter item that
isn't empty is one window.  A document word inside any occurrence of a window is
hit.

Method.  The items' words are numbered and read into one suffix automaton (a state
is a set of equal end positions; the end of each item starts anew at the root).
Training tokens stream through it while the length of the longest match is
tracked: where that reaches the window's length, the words of the match are hit
and the state's items occur.  Only stretches of tokens all of whose neighbouring
pairs occur in some item are streamed, as no match goes on over another pair.
Spans beyond the length limit, and all spans of a document beyond the coverage
limit, are taken out of its text (`cleaned`).

The benchmark is dealt into shards of `shard_words` words by DataFrame functions;
an item that is longer is cut into pieces that overlap by a window less one word,
so that each window stands whole in one piece.  One task a shard builds its
automaton, once, as flat arrays in a table.

One shard streams over the documents as they are read.  With more of them the
documents are first held against the hashes of all windows, WINDOWS of them at a
time: the distinct texts that hold one are written to the shared folder, and only
these, a small part of the corpus, are streamed through shard after shard, one in
memory at a time.  Their marks go back to the documents by the digest of the text,
for the documents that hold a window only; all others pass by without a shuffle.
So the documents are read three times, however many shards there are (once more for
each further WINDOWS windows of the benchmark).

Words are compared by 64-bit hashes.

Edge cases: null text has no words; item ids are compared as text, a null one is
the id "", and rows with one id are one item's; items with equal texts are all
reported; an item without words has no window; with an empty benchmark nothing is
hit; very long texts are read in slices of rows, each text whole; rows with one id
are handled each by itself; an empty table gives an empty table; extra columns
pass through; a result column replaces an input column of its name.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .common import checkpointed, extended, release, sha256, shared_dir, with_columns
from .text import ALNUM, BYTE_LOWER, Words, column_bytes, inside_document, mix, window_hash

SHARD_WORDS = 200_000
#: window hashes that are sent to all tasks at a time: 128 MB of them at most, and bits for a first look
WINDOWS, BITS = 1 << 24, 27
DIGEST, MARKED, FOUND, HOLDS = "__ob_digest", "__ob_marked", "__ob_found", "__ob_holds"
SHARD, PIECE = "__ob_shard", "__ob_piece"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
NAMES = T.ArrayType(T.StringType())
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class _Build:
    """Suffix automaton over word numbers as it grows."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _copy(self, p, w, q):
        c = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.size.append(self.size[p] + 1)
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        self.link[q] = c
        return c

    def add(self, last, w):
        q = self.next[last].get(w)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._copy(last, w, q)
        new = len(self.next)
        self.next.append({})
        self.size.append(self.size[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._copy(p, w, q)
        return new


class Automaton:
    """Generalised suffix automaton of some items, in flat arrays.

    Transitions: sorted keys state * words + word, and their states.  link, size: of each state.  top: the shortest state
    of window length at or above it on the suffix links, -1 for none.  short: the nearest state at or above it where a whole
    short item ends.  ends[low[v] : high[v]]: items in which the strings of state v end (the states below v on the links
    are numbered next to each other).  whole_*: short items by state.
    """

    def __init__(self, items: list[np.ndarray], names: list[str], window: int):
        self.window, self.names = window, names
        self.words = np.unique(np.concatenate(items))
        numbers = [np.searchsorted(self.words, w) for w in items]
        self.pairs = np.unique(np.concatenate([n[:-1] * len(self.words) + n[1:] for n in numbers]))
        self.least = min(window, min(map(len, numbers)))
        made, own = _Build(), []
        for k, words in enumerate(numbers):
            last = 0
            for w in words.tolist():
                last = made.add(last, w)
                own.append((last, k))
        n = len(made.size)
        self.link, self.size = np.array(made.link, np.int32), np.array(made.size, np.int32)
        by_size = np.argsort(self.size, kind="stable")[1:].tolist()
        link, size = made.link, made.size
        self.top, self.short = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        whole = {}
        for k, words in enumerate(numbers):
            if 0 < len(words) < window:
                v = 0
                for w in words.tolist():
                    v = made.next[v][w]
                whole.setdefault(v, []).append((len(words), k))
        self.whole_state, self.whole_length, self.whole_item = (np.array(x, np.int32) for x in (zip(*[(v, m, k) for v, x in whole.items() for m, k in x]) if whole else ((), (), ())))
        for v in by_size:
            up = link[v]
            if size[v] >= window:
                self.top[v] = self.top[up] if size[up] >= window else v
            self.short[v] = v if v in whole else (self.short[up] if up > 0 else -1)
        # numbers in depth-first order of the links, from the sizes of the subtrees
        below = [1] * n
        for v in reversed(by_size):
            below[link[v]] += below[v]
        place, free = [0] * n, [1] * n
        for v in by_size:
            place[v] = place[link[v]] + free[link[v]]
            free[link[v]] += below[v]
        ends = np.unique(np.array([(place[v], k) for v, k in own], np.int64), axis=0)
        first = np.array(place)
        self.ends = ends[:, 1].astype(np.int32)
        self.low, self.high = (np.searchsorted(ends[:, 0], x).astype(np.int32) for x in (first, first + np.array(below)))
        keys = np.array([v * len(self.words) + w for v, x in enumerate(made.next) for w in x], np.int64)
        to = np.array([q for x in made.next for q in x.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]

    FLAT = ("words", "pairs", "link", "size", "top", "short", "ends", "low", "high", "keys", "to", "whole_state", "whole_length", "whole_item")

    def row(self) -> dict:
        """Everything as one row of a table."""
        return {"window": self.window, "least": int(self.least), "names": self.names, **{k: getattr(self, k).tobytes() for k in self.FLAT}}

    @classmethod
    def read(cls, row) -> Automaton:
        kinds = {"words": np.uint64, "pairs": np.int64, "keys": np.int64}
        made = cls.__new__(cls)
        made.window, made.least, made.names = row["window"], row["least"], list(row["names"])
        for k in cls.FLAT:
            setattr(made, k, np.frombuffer(bytes(row[k]), kinds.get(k, np.int32)))
        return made

    def look_ups(self):
        """What streaming reads word by word; made once a Python worker and shard."""
        if not hasattr(self, "_look_ups"):
            bits = max(16, int(len(self.words) * 16 - 1).bit_length())
            shift = np.uint64(64 - bits)
            seen = np.zeros(1 << bits, bool)
            seen[(self.words >> shift).astype(np.int64)] = True
            whole: dict[int, list[tuple[int, int]]] = {}
            for v, m, k in zip(self.whole_state.tolist(), self.whole_length.tolist(), self.whole_item.tolist()):
                whole.setdefault(v, []).append((m, k))
            self._look_ups = (dict(zip(self.keys.tolist(), self.to.tolist())), self.link.tolist(), self.size.tolist(), self.top.tolist(), self.short.tolist(), whole, shift, seen)
        return self._look_ups

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_look_ups"}

    def stream(self, words, start: int, marks: bytearray, states: set[int], found: set[int]) -> None:
        """Reads words that stand from `start` on; marks what is hit and adds the states of windows and the short items that occur."""
        follow, link, size, top, short, whole, *_ = self.look_ups()
        many, window = len(self.words), self.window
        v = n = 0
        for i, w in enumerate(words, start + 1):
            to = follow.get(v * many + w)
            while to is None and v:
                v = link[v]
                n = size[v]
                to = follow.get(v * many + w)
            if to is None:
                n = 0
                continue
            v = to
            n += 1
            if n >= window:
                marks[i - n : i] = b"\1" * n
                states.add(top[v])
            u = short[v]
            while u > 0:
                for length, k in whole[u]:
                    if length <= n:
                        marks[i - length : i] = b"\1" * length
                        found.add(k)
                u = short[link[u]] if link[u] > 0 else -1

    def run(self, words: Words) -> dict[int, tuple[bytearray, list[str]]]:
        """For each document (by its number) with a hit: a mark for each word, and the items, each once."""
        shift, seen = self.look_ups()[-2:]
        h, o = words.hashes, words.offsets
        maybe = np.flatnonzero(seen[(h >> shift).astype(np.int64)])
        number = np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, h[maybe]), len(self.words) - 1)
        known = self.words[at] == h[maybe]
        number[maybe[known]] = at[known]
        first = np.zeros(len(h) + 1, bool)
        first[o[:-1]] = True
        go_on = np.zeros(len(h), bool)  # the pair (i-1, i) is in an item
        i = np.flatnonzero((number[1:] >= 0) & (number[:-1] >= 0) & ~first[1:-1]) + 1 if len(h) > 1 else np.zeros(0, np.int64)
        key = number[i - 1] * len(self.words) + number[i]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            go_on[i[self.pairs[at] == key]] = True
        begin = np.flatnonzero((number >= 0) & ~go_on)
        if not len(begin):
            return {}
        stop = np.flatnonzero(~go_on)
        end = np.concatenate([stop[1:], [len(h)]])[np.searchsorted(stop, begin)]
        long = end - begin >= self.least
        begin, end = begin[long], end[long]
        doc = np.searchsorted(o, begin, "right") - 1
        seen_by: dict[int, tuple[bytearray, set[int], set[int]]] = {}
        for a, z, d in zip(begin.tolist(), end.tolist(), doc.tolist()):
            if d not in seen_by:
                seen_by[d] = (bytearray(int(o[d + 1] - o[d])), set(), set())
            self.stream(number[a:z].tolist(), a - int(o[d]), *seen_by[d])
        out = {}
        for d, (marks, states, found) in seen_by.items():
            for v in states:
                found.update(self.ends[self.low[v] : self.high[v]].tolist())
            if found:
                out[d] = marks, sorted({self.names[k] for k in found})
        return out


def shards_of(benchmark: DataFrame, item_col: str, text_col: str, window: int, shard_words: int) -> DataFrame:
    """A table of automata, each over at most shard_words words or one piece (written to the shared folder)."""
    most = max(shard_words, 2 * window)
    kinds = "window int, least int, names array<string>, " + ", ".join(f"{k} binary" for k in Automaton.FLAT)

    def cut(batches):
        for batch in batches:
            parts = Words(*column_bytes(batch.column("t")), ALNUM, BYTE_LOWER)
            o, names, pieces = parts.offsets.tolist(), [], []
            for k, a, z in zip(batch.column("k").to_pylist(), o, o[1:]):
                for s in range(a, max(a + 1, z - window + 1), most - window + 1) if z > a else ():
                    names.append(k), pieces.append(parts.hashes[s : min(z, s + most)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(pieces, pa.binary())], names=["k", PIECE])

    def build(table):
        rows = sorted(zip(table.column("k").to_pylist(), table.column(PIECE).to_pylist()))
        out, items, size = [], [], 0
        for k, raw in [*rows, (None, None)]:
            if items and (raw is None or size + len(raw) // 8 > most):
                out.append(Automaton([np.frombuffer(x, np.uint64) for _, x in items], [x for x, _ in items], window).row())
                items, size = [], 0
            if raw is not None:
                items.append((k, raw))
                size += len(raw) // 8
        return pa.Table.from_pylist(out, schema=pa.schema([("window", pa.int32()), ("least", pa.int32()), ("names", pa.list_(pa.string())), *[(k, pa.binary()) for k in Automaton.FLAT]]))

    pieces = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("k"), F.col(text_col).alias("t")).mapInArrow(cut, f"k string, {PIECE} binary")
    shards = math.ceil(1.25 * (pieces.agg(F.sum(F.octet_length(PIECE))).first()[0] or 0) / 8 / most)
    made = pieces.withColumn(SHARD, F.pmod(F.xxhash64("k", PIECE), F.lit(max(1, shards)))).groupBy(SHARD).applyInArrow(build, kinds)
    folder = f"{shared_dir(benchmark.sparkSession)}/automata-{uuid.uuid4().hex}"
    made.withColumn(SHARD, F.monotonically_increasing_id()).write.parquet(folder)
    return benchmark.sparkSession.read.parquet(folder)


class Held:
    """Hashes of windows, sorted, and a bit field over them for a first look."""

    def __init__(self, sizes: list[int], keys: np.ndarray):
        self.sizes, self.keys = sizes, np.sort(keys)
        bits = np.zeros(1 << BITS, bool)
        bits[self._place(self.keys)] = True
        self.bits = np.packbits(bits, bitorder="little")

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - BITS)).astype(np.int64)

    def documents(self, words: Words) -> np.ndarray:
        """Whether each document of a batch holds a window."""
        out = np.zeros(len(words.offsets) - 1, bool)
        for n in self.sizes:
            keys = _keys(words, n)
            at = np.flatnonzero(inside_document(words.offsets, n)[: len(keys)]) if len(keys) else np.zeros(0, np.int64)
            place = self._place(keys[at])
            at = at[self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0]
            found = np.minimum(np.searchsorted(self.keys, keys[at]), len(self.keys) - 1)
            at = at[self.keys[found] == keys[at]]
            out[np.searchsorted(words.offsets, at, "right") - 1] = True
        return out


def _keys(words: Words, n: int) -> np.ndarray:
    return mix(window_hash(words.hashes, n) + np.uint64(n))


def windows_of(benchmark: DataFrame, text_col: str, window: int) -> DataFrame:
    """(n, key): the distinct windows of all items, n words each, by hash."""

    def work(batches):
        for batch in batches:
            words = Words(*column_bytes(batch.column("t")), ALNUM, BYTE_LOWER)
            counts, start = words.counts, words.offsets[:-1]
            for n in sorted({window, *np.unique(counts[(counts > 0) & (counts < window)]).tolist()}):
                keys = _keys(words, n)
                at = np.flatnonzero(inside_document(words.offsets, n)[: len(keys)]) if n == window else start[counts == n]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n), pa.int32()), pa.array(keys[at].view(np.int64), pa.int64())], names=["n", "key"])

    return benchmark.select(F.col(text_col).alias("t")).mapInArrow(work, "n int, key bigint").distinct()


def _flagged(df: DataFrame, text_col: str, sent) -> DataFrame:
    """df with HOLDS: whether the text holds one of the windows that were sent."""

    def work(batches):
        for batch in batches:
            for part in _slices([batch]):
                yield with_columns(part, **{HOLDS: pa.array(sent.value.documents(Words(*column_bytes(part.column(text_col)), ALNUM, BYTE_LOWER)))})
        release()

    return df.mapInArrow(work, extended(df.schema, **{HOLDS: "boolean"}))


def _marks(df: DataFrame, benchmark: DataFrame, automata: DataFrame, shards: list, text_col: str, item_text_col: str, window: int, take) -> DataFrame:
    """df with the marks of all shards: see the module. Rows that hold no window get none."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/decontaminate-{uuid.uuid4().hex}"
    windows = checkpointed(windows_of(benchmark, item_text_col, window))
    parts = max(1, math.ceil(1.1 * windows.count() / WINDOWS))
    sends = []
    for k in range(parts):
        got = windows.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).toArrow()
        sends.append(spark.sparkContext.broadcast(Held(sorted(set(got.column("n").to_pylist())), got.column("key").to_numpy().view(np.uint64))) if len(got) else None)
    sends = [s for s in sends if s is not None]
    texts = df.select(F.col(text_col).alias("t"))
    held = None
    for sent in sends:
        some = _flagged(texts, "t", sent).where(HOLDS).select(_digest("t").alias(DIGEST), "t")
        held = some if held is None else held.unionByName(some)
    if held is None:
        return df
    held.dropDuplicates([DIGEST]).write.parquet(f"{folder}/texts")
    distinct = spark.read.parquet(f"{folder}/texts")
    for k in shards:
        sent = take(k)
        marked = distinct.select("t").mapInArrow(_sparse(sent), f"t string, {MARKED} array<struct<start:bigint,end:bigint>>, {FOUND} array<string>")
        marked.select(_digest("t").alias(DIGEST), MARKED, FOUND).write.mode("append").parquet(f"{folder}/marks")
        sent.destroy()
    every = spark.read.schema(f"{DIGEST} string, {MARKED} array<struct<start:bigint,end:bigint>>, {FOUND} array<string>").parquet(f"{folder}/marks").groupBy(DIGEST).agg(F.flatten(F.collect_list(MARKED)).alias(MARKED), F.flatten(F.collect_list(FOUND)).alias(FOUND))
    rest, out = df, None
    for sent in sends:
        both = _flagged(rest, text_col, sent)
        holds = both.where(HOLDS).drop(HOLDS).withColumn(DIGEST, _digest(text_col)).join(every, DIGEST, "left").drop(DIGEST)
        out = holds if out is None else out.unionByName(holds)
        rest = both.where(~F.col(HOLDS)).drop(HOLDS)
    kinds = every.schema
    return out.unionByName(rest.select("*", *[F.lit(None).cast(kinds[c].dataType).alias(c) for c in (MARKED, FOUND)]))


def _digest(text_col: str):
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def decontaminate(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: tuple[int, int] = (1, 20), shard_words: int = SHARD_WORDS, longest: int | None = None,
) -> DataFrame:
    """df with n_words, n_hit, n_items, items (sorted as strings), items_sha256, spans of hit words, contaminated (at least share of the words are hit, and one is), and cleaned.

    cleaned: the text without the spans of more than `longest` hit words (by default: all spans), and without any span where the document is contaminated.
    """
    spark = df.sparkSession
    automata = shards_of(benchmark, item_col, item_text_col, window, shard_words)
    shards = [r[SHARD] for r in automata.select(SHARD).orderBy(SHARD).collect()]
    take = lambda k: spark.sparkContext.broadcast(Automaton.read(automata.where(F.col(SHARD) == k).first()))  # noqa: E731  one shard at a time
    out = df
    last = take(shards[0]) if len(shards) == 1 else None
    if len(shards) > 1:
        out = _marks(df, benchmark, automata, shards, text_col, item_text_col, window, take)

    def finish(batches):
        for batch in _slices(batches):
            buf, off = column_bytes(batch.column(text_col))
            words = Words(buf, off, ALNUM, BYTE_LOWER)
            counts = words.counts
            got = last.value.run(words) if last is not None else {}
            if MARKED in batch.schema.names:
                for d, (spans, names) in enumerate(zip(batch.column(MARKED).to_pylist(), batch.column(FOUND).to_pylist())):
                    if spans:
                        marks, items = got.get(d, (bytearray(int(counts[d])), []))
                        for s in spans:
                            marks[s["start"] : s["end"]] = b"\1" * (s["end"] - s["start"])
                        got[d] = marks, sorted({*items, *names})
                batch = batch.drop_columns([MARKED, FOUND])
            hit = np.array([got[d][0].count(1) if d in got else 0 for d in range(len(batch))], np.int64)
            items = [got[d][1] if d in got else [] for d in range(len(batch))]
            spans = [_spans(got[d][0]) if d in got else [] for d in range(len(batch))]
            bad = (hit > 0) & (share[1] * hit >= share[0] * counts)
            texts = batch.column(text_col)
            if len(got):
                texts = texts.to_pylist()
                for d in got:
                    cut = [s for s in spans[d] if bad[d] or longest is None or s["end"] - s["start"] > longest]
                    texts[d] = _without(buf, int(off[d]), int(off[d + 1]), words, int(words.offsets[d]), cut)
                texts = pa.array(texts, pa.string())
            yield with_columns(
                batch,
                n_words=pa.array(counts, pa.int64()), n_hit=pa.array(hit, pa.int64()), n_items=pa.array([len(x) for x in items], pa.int64()), items=pa.array(items, pa.list_(pa.string())),
                items_sha256=pa.array([sha256(",".join(x).encode()) for x in items], pa.string()), spans=pa.array(spans, _SPAN), contaminated=pa.array(bad), cleaned=texts,
            )
        release()

    return out.mapInArrow(finish, extended(df.schema, n_words="long", n_hit="long", n_items="long", items=NAMES, items_sha256="string", spans=SPANS, contaminated="boolean", cleaned="string"))


def _slices(batches):
    for batch in batches:
        for a in range(0, len(batch), 512):
            yield batch.slice(a, 512)


def _spans(marks):
    m = np.concatenate([[0], np.frombuffer(marks, np.uint8), [0]]).astype(np.int8)
    step = np.diff(m)
    return [{"start": a, "end": z} for a, z in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist())]


def _without(buf, low: int, high: int, words: Words, base: int, spans) -> str:
    """A text (bytes low to high) without the bytes from the first to the last word of each span."""
    kept, at = [], low
    for s in spans:
        kept.append(buf[at : words.starts[base + s["start"]]].tobytes())
        at = int(words.ends[base + s["end"] - 1])
    return b"".join([*kept, buf[at:high].tobytes()]).decode()


def _sparse(sent):
    def work(batches):
        for batch in _slices(batches):
            got = sent.value.run(Words(*column_bytes(batch.column("t")), ALNUM, BYTE_LOWER))
            at = sorted(got)
            yield pa.RecordBatch.from_arrays(
                [batch.column("t").take(pa.array(at, pa.int64())), pa.array([_spans(got[d][0]) for d in at], _SPAN), pa.array([got[d][1] for d in at], pa.list_(pa.string()))], names=["t", MARKED, FOUND],
            )
        release()

    return work


def query(spark, sf_dir: str) -> DataFrame:
    """op10: per document the words hit by benchmark windows, the items, and the verdict."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, array_to_string(w, ' ') AS win, len(w) AS n FROM b WHERE len(w) BETWEEN 1 AND 12
       UNION ALL SELECT item_id, array_to_string(w[s:s+12], ' '), 13 FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 12)) AS s FROM b WHERE len(w) >= 13)),
sizes AS (SELECT DISTINCT n FROM bw),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s+n-1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, s, dw.n, item_id FROM dw JOIN bw USING (win, n)),
h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS i FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
