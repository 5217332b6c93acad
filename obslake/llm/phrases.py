"""Phrase collocations, mined level by level over direct-address tiles.

Texts are lower-cased (A-Z), split at `[.,;:!?\\x0A-\\x0D]` into pieces and those into words `[^\\x20\\x09]+`; all counts
are exact and per language.

* **Streams.** A text slice of one language becomes a stream of its own word numbers, with a break after each piece,
  beside a list of its distinct words. Word counts over all slices give the frequent words; these are numbered by
  (language, frequency), and the streams are rewritten in those numbers, infrequent words turned to breaks.
* **Tiles.** Pairs of neighbours in a stream are counted per task: the plane of (left, right) numbers is cut into tiles
  of TILE x TILE. Because numbers are ranks of frequency, hits crowd into few tiles; those are counted by direct
  address (numpy bincount), all other pairs as coordinates, sorted by tile and address. Spark adds up the counts of
  all tasks by pair, so a frequent pair costs a row for each task's buffer, whatever it occurs.
* **Recursion.** Frequent pairs are numbered by (language, frequency) in their turn, and the streams are rewritten in
  pair numbers: neighbours in that stream overlap, so a pair of pairs is a phrase of three words, and so on. A
  phrase is only counted where both phrases inside it are frequent, which a frequent phrase's parts always are.

Numbers go to all tasks while they are 32 MB at most. Beyond that they reach the slices by joins on words or pairs.

Edge cases: null, empty and separator-only texts have no words; a null language is `und`, the same as a language of that
name; repeated rows count each time; very long texts are a slice of their own; ties in score go by count, then phrase;
extra columns are ignored; an empty table gives an empty result. Words are told apart inside a slice by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import numbered
from .common import Scratch, release
from .text import BYTE_LOWER, Words, chunks, column_bytes

#: bytes of text in a slice, side of a tile, positions in a counting buffer
SLICE, TILE, BUFFER = 4 << 20, 1024, 1 << 20
#: tiles on a side among which dense ones are looked for; hits that make a tile dense
CORNER, DENSE = 64, TILE * TILE // 16
#: bytes of a table of numbers that is sent to all tasks at most, and what its row weighs besides texts
SMALL, ROW = 32 << 20, 64
#: fixed values: what ends a piece, and what ends a word
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~ENDS
WORD[[0x20, 0x09]] = False
BREAK = -1

SLICED = "slice long, lang string, stream binary, words array<string>, counts array<bigint>"
STREAM = "slice long, lang string, stream binary"
PAIRS = "l long, r long, n long"


def _encoded(x: np.ndarray) -> bytes:
    """Numbers in 4 bytes where they fit, 8 otherwise; the first byte tells."""
    small = not len(x) or int(x.max()) < 1 << 31
    return (b"\4" if small else b"\x08") + x.astype("<i4" if small else "<i8").tobytes()


def _decoded(raw) -> np.ndarray:
    raw = raw.as_py() if isinstance(raw, pa.Scalar) else raw
    return np.frombuffer(raw, "<i4" if raw[0] == 4 else "<i8", offset=1).astype(np.int64)


def _slices(batch: pa.RecordBatch, text: str, lang: str):
    """(language, bytes, offsets) of runs of texts of one language, of about SLICE bytes."""
    langs = pc.fill_null(batch.column(lang), "und")
    for name in pc.unique(langs).to_pylist():
        buf, off = column_bytes(batch.column(text).filter(pc.equal(langs, name)))
        for a, b in chunks(off, SLICE):
            yield name, buf[off[a] : off[b]], off[a : b + 1] - off[a]


def _stream(buf: np.ndarray, offsets: np.ndarray):
    """(stream, distinct words, their counts) of a slice: numbers of the words, a break between pieces."""
    words = Words(buf, offsets, WORD, BYTE_LOWER)
    if not len(words):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    _, at, number, counts = np.unique(words.hashes, return_index=True, return_inverse=True, return_counts=True)
    names = [bytes(buf[words.starts[k] : words.ends[k]]).lower().decode() for k in at.tolist()]  # bytes.lower() is A-Z only
    ends = np.concatenate([[0], np.cumsum(ENDS[buf])])
    piece = ends[words.starts]
    new = np.concatenate([[False], piece[1:] != piece[:-1]])
    new[words.offsets[(words.offsets > 0) & (words.offsets < len(words))]] = True
    out = np.full(len(words) + int(new.sum()), BREAK, np.int64)
    out[np.arange(len(words)) + np.cumsum(new)] = number
    return out, names, counts


def sliced(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Streams of the texts with their distinct words and counts, a row for each slice and language."""

    def work(batches):
        for batch in batches:
            for lang, buf, off in _slices(batch, "t", "g"):
                stream, names, counts = _stream(buf, off)
                if len(names):
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([lang]), pa.array([_encoded(stream)], pa.binary()), pa.array([names], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], names=["slice", "lang", "stream", "words", "counts"])
            release()

    made = docs.select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("g")).mapInArrow(work, SLICED)
    return made.withColumn("slice", F.monotonically_increasing_id())


def _runs(keys: np.ndarray, counts: np.ndarray | None = None):
    """Distinct sorted keys with how often each occurs."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.concatenate([first, [len(keys)]]))


def tile_counts(left: np.ndarray, right: np.ndarray, base: int):
    """(left, right, count) of the distinct pairs: dense tiles by direct address, the others as sorted coordinates.

    base: a number that none is below; numbers near it are the frequent ones.
    """
    x, y = left - base, right - base
    row, col = x // TILE, y // TILE
    inner = (row < CORNER) & (col < CORNER)
    tile = np.where(inner, row * CORNER + col, CORNER * CORNER)
    dense = np.flatnonzero(np.bincount(tile, minlength=CORNER * CORNER + 1)[:-1] >= DENSE)
    outs, rest = [], np.ones(len(x), bool)
    for t in dense.tolist():
        here = tile == t
        rest &= ~here
        x0, y0 = t // CORNER * TILE, t % CORNER * TILE
        table = np.bincount((x[here] - x0) * TILE + y[here] - y0, minlength=TILE * TILE)
        address = np.flatnonzero(table)
        outs.append((address // TILE + x0, address % TILE + y0, table[address]))
    if rest.any():
        x, y = x[rest], y[rest]
        tiles = int(y.max()) // TILE + 1  # of a row of tiles
        if (int(x.max()) // TILE + 1) * tiles < 1 << 43:
            key, n = _runs((x // TILE * tiles + y // TILE) * (TILE * TILE) + x % TILE * TILE + y % TILE)
            tile, address = key // (TILE * TILE), key % (TILE * TILE)
            outs.append((tile // tiles * TILE + address // TILE, tile % tiles * TILE + address % TILE, n))
        else:  # the address of a tile passes 64 bits
            both, n = np.unique(np.stack([x, y], 1), axis=0, return_counts=True)
            outs.append((both[:, 0], both[:, 1], n))
    cat = lambda k: np.concatenate([o[k] for o in outs]) if outs else np.zeros(0, np.int64)
    return cat(0) + base, cat(1) + base, cat(2)


def neighbours(stream: np.ndarray):
    """Starts of the pairs of neighbours in a stream."""
    return np.flatnonzero((stream[:-1] >= 0) & (stream[1:] >= 0))


def pair_counts(streams: DataFrame) -> DataFrame:
    """(l, r, n) of neighbours in the streams, counted over buffers of one language in a task; a pair has a row for each buffer."""

    def work(batches):
        waiting, size = defaultdict(list), defaultdict(int)

        def flush(lang):
            both = [np.concatenate(x) for x in zip(*waiting.pop(lang))]
            size.pop(lang)
            l, r, n = tile_counts(*both, int(min(both[0].min(), both[1].min())))  # noqa: E741
            for a in range(0, len(l), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(v[a : a + (1 << 18)], pa.int64()) for v in (l, r, n)], names=["l", "r", "n"])

        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("stream")):
                x = _decoded(raw)
                at = neighbours(x)
                for a in range(0, len(at), BUFFER):
                    part = at[a : a + BUFFER]
                    waiting[lang].append((x[part], x[part + 1]))
                    size[lang] += len(part)
                    if size[lang] >= BUFFER:
                        yield from flush(lang)
                if sum(size.values()) >= 2 * BUFFER:
                    for k in [*waiting]:
                        yield from flush(k)
        for k in [*waiting]:
            yield from flush(k)
        release()

    return streams.select("lang", "stream").mapInArrow(work, PAIRS)


def distinct_pairs(streams: DataFrame) -> DataFrame:
    """(slice, l, r): each slice's distinct pairs of neighbours."""

    def work(batches):
        for batch in batches:
            for k, raw in zip(batch.column("slice").to_pylist(), batch.column("stream")):
                x = _decoded(raw)
                at = neighbours(x)
                if len(at):
                    l, r, _ = tile_counts(x[at], x[at + 1], int(x[x >= 0].min()))  # noqa: E741
                    for a in range(0, len(l), 1 << 18):
                        part = slice(a, a + (1 << 18))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(l[part]), k), pa.int64()), pa.array(l[part], pa.int64()), pa.array(r[part], pa.int64())], names=["slice", "l", "r"])
        release()

    return streams.select("slice", "stream").mapInArrow(work, "slice long, l long, r long")


def compacted(x: np.ndarray) -> np.ndarray:
    """A stream without what has no neighbour, one break where there were several."""
    good = x >= 0
    near = np.zeros(len(x), bool)
    near[1:] |= good[:-1]
    near[:-1] |= good[1:]
    x = np.where(good & near, x, BREAK)
    keep = (x >= 0) | np.concatenate([[False], x[:-1] >= 0])
    return x[keep]


def _rewritten(lang, k: int, stream: np.ndarray) -> pa.Table:
    out = compacted(stream)
    rows = [(k, lang, _encoded(out))] if len(out) else []
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary()))], names=["slice", "lang", "stream"])


class Known:
    """Frequent pairs with their numbers, for looking up."""

    def __init__(self, left: np.ndarray, right: np.ndarray, ids: np.ndarray):
        self.parts = np.unique(np.concatenate([left, right]))
        key = np.searchsorted(self.parts, left) * len(self.parts) + np.searchsorted(self.parts, right)
        order = np.argsort(key)
        self.key, self.ids = key[order], ids[order]

    def rewritten(self, x: np.ndarray) -> np.ndarray:
        """The stream in the numbers of its pairs, each at its first phrase's place, all else a break."""
        out = np.full(len(x), BREAK, np.int64)
        at = neighbours(x)
        if len(self.key) and len(at):
            place = [np.minimum(np.searchsorted(self.parts, v), len(self.parts) - 1) for v in (x[at], x[at + 1])]
            mine = place[0] * len(self.parts) + place[1]
            got = np.minimum(np.searchsorted(self.key, mine), len(self.key) - 1)
            there = (self.parts[place[0]] == x[at]) & (self.parts[place[1]] == x[at + 1]) & (self.key[got] == mine)
            out[at[there]] = self.ids[got[there]]
        return out


def _mapped(streams: DataFrame, columns: list[str], rewrite) -> DataFrame:
    """Streams rewritten row by row; rewrite(row of Arrow scalars) gives the new stream."""

    def work(batches):
        for batch in batches:
            for row in zip(*[batch.column(c) for c in columns]):
                yield from _rewritten(row[1].as_py(), row[0].as_py(), rewrite(*row)).to_batches()
        release()

    return streams.select(*columns).mapInArrow(work, STREAM)


def _sent(numbers: DataFrame, text: Column | None = None):
    """numbers as a broadcast Arrow table where it has SMALL bytes at most, else None: then they go by a join."""
    size = numbers.agg(F.sum(F.lit(ROW) + (F.lit(0) if text is None else text))).first()[0] or 0
    return numbers.sparkSession.sparkContext.broadcast(numbers.toArrow()) if size <= SMALL else None


def in_word_numbers(slices: DataFrame, level: DataFrame, words: DataFrame, scratch: Scratch) -> DataFrame:
    """The streams in the numbers of the frequent words of level(lang, phrase, id). words(slice, lang, k, phrase): k is a slice's own number."""
    level = level.select("lang", "phrase", "id")
    sent = _sent(level, F.octet_length("lang") + F.octet_length("phrase"))
    if sent is not None:

        def rewrite(k, lang, stream, names):
            table = sent.value.filter(pc.equal(sent.value.column("lang"), lang.as_py()))
            place = pc.index_in(names.values.cast(table.schema.field("phrase").type), table.column("phrase"))
            ids = np.append(table.column("id").to_numpy(), BREAK)
            to = np.append(ids[pc.fill_null(place, -1).to_numpy(zero_copy_only=False)], BREAK)  # the last stands for breaks
            return to[_decoded(stream)]

        out = scratch.keep(_mapped(slices, ["slice", "lang", "stream", "words"], rewrite))
        sent.destroy()
        return out
    numbers = words.join(level, ["lang", "phrase"], "left").select(F.col("slice").alias("s"), "k", F.coalesce("id", F.lit(BREAK)).alias("id"))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return _rewritten("", 0, np.zeros(0, np.int64))
        x, own, ids = _decoded(left.column("stream")[0]), right.column("k").to_numpy(), right.column("id").to_numpy()
        to = np.full(int(own.max()) + 2, BREAK, np.int64)
        to[own] = ids
        return _rewritten(left.column("lang")[0].as_py(), left.column("slice")[0].as_py(), to[x])

    return scratch.keep(slices.select("slice", "lang", "stream").groupBy("slice").cogroup(numbers.groupBy("s")).applyInArrow(work, STREAM))


def in_pair_numbers(streams: DataFrame, level: DataFrame, scratch: Scratch) -> DataFrame:
    """The streams in the numbers of the frequent pairs of level(l, r, id), each at its first phrase's place."""
    level = level.select("l", "r", "id")
    sent = _sent(level)
    if sent is not None:
        made: list[Known] = []

        def rewrite(k, lang, stream):
            if not made:
                made.append(Known(*[sent.value.column(c).to_numpy() for c in ("l", "r", "id")]))
            return made[0].rewritten(_decoded(stream))

        out = scratch.keep(_mapped(streams, ["slice", "lang", "stream"], rewrite))
        sent.destroy()
        return out
    numbers = distinct_pairs(streams).join(level, ["l", "r"]).select(F.col("slice").alias("s"), "l", "r", "id")

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _rewritten("", 0, np.zeros(0, np.int64))
        known = Known(*[right.column(c).to_numpy() for c in ("l", "r", "id")])
        return _rewritten(left.column("lang")[0].as_py(), left.column("slice")[0].as_py(), known.rewritten(_decoded(left.column("stream")[0])))

    return scratch.keep(streams.groupBy("slice").cogroup(numbers.groupBy("s")).applyInArrow(work, STREAM))


def _ranked(df: DataFrame) -> DataFrame:
    """df(lang, phrase, last, f, ...) with `id`: the languages' phrases by frequency, one language after the other."""
    return numbered(df, [], ["lang", F.desc("f"), "phrase"], "id")


def phrase_counts(docs: DataFrame, text_col: str, lang_col: str, least: int, longest: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(totals, phrases): (lang, n) over all words, and (lang, phrase, m, f) of all phrases of up to `longest` words that occur `least` times or more."""
    slices = scratch.keep(sliced(docs, text_col, lang_col))
    words = slices.select("slice", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("k", "w")).select("slice", "lang", "k", F.col("w.words").alias("phrase"), F.col("w.counts").alias("c"))
    totals = scratch.keep(slices.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("c")).groupBy("lang").agg(F.sum("c").alias("n")))
    counted = words.groupBy("lang", "phrase").agg(F.sum("c").alias("f")).where(F.col("f") >= least)
    level = scratch.keep(_ranked(counted.withColumn("last", F.col("phrase"))))
    streams = in_word_numbers(slices, level, words, scratch)
    phrases = [level.select("lang", "phrase", F.lit(1).alias("m"), "f")]
    for m in range(2, longest + 1):
        pairs = scratch.keep(pair_counts(streams).groupBy("l", "r").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
        first = level.select(F.col("id").alias("l"), "lang", F.col("phrase").alias("p"))
        second = level.select(F.col("id").alias("r"), F.col("last").alias("w"))
        named = pairs.join(first, "l").join(second, "r").select("lang", F.concat_ws(" ", "p", "w").alias("phrase"), F.col("w").alias("last"), "l", "r", "f")
        level = scratch.keep(_ranked(named))
        phrases.append(level.select("lang", "phrase", F.lit(m).alias("m"), "f"))
        if m < longest:
            before, streams = streams, in_pair_numbers(streams, level, scratch)
            scratch.drop(before)
    out = phrases[0]
    for p in phrases[1:]:
        out = out.unionByName(p)
    return totals, out


def scored(totals: DataFrame, phrases: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, score) of each phrase of two words and more, by its lowest-scoring cut (ties: the earliest)."""
    words = F.split("phrase", " ")
    cuts = phrases.where("m > 1").withColumn("w", words).select("lang", "phrase", "m", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "m", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.col("m")), " ").alias("rest"))
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(1000 * cast(a AS decimal(38,0)) * cast(n AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r", "a", "n", "m"))
    return cuts.groupBy("lang", "phrase").agg(best.alias("b")).select("lang", "phrase", "b.m", "b.a", "b.l", "b.r", "b.n", "b.score")


def maximal(phrases: DataFrame, candidates: DataFrame, share: int = 100) -> DataFrame:
    """candidates that no longer candidate holds which occurs in at least share % of their occurrences.

    A phrase's count is at least that of any phrase around it, so if a far longer one passes the share, the
    one a word longer on its side passes too: looking one word further is enough.
    """
    w = F.split("phrase", " ")
    longer = phrases.where("m > 2").select("lang", w.alias("w"), F.col("m").alias("of"), F.col("f").alias("longer"))
    ends = F.explode(F.array(F.array_join(F.slice("w", 1, F.col("of") - 1), " "), F.array_join(F.slice("w", 2, F.col("of") - 1), " ")))
    around = longer.select("lang", ends.alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    out = candidates.join(around, ["lang", "phrase"], "left")
    return out.where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first `most` phrases by score, then count, then phrase."""
    with Scratch(docs.sparkSession, "phrases") as scratch:
        totals, phrases = phrase_counts(docs, text_col, lang_col, least, longest, scratch)
        left = scratch.keep(maximal(phrases, scored(totals, phrases)))
        ranked = numbered(left, ["lang"], [F.desc("score"), F.desc("a"), "phrase"], "rank").where(F.col("rank") <= most)
        return scratch.result(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: each language's 2,000 best phrases of 2 to 5 words."""
    from .common import table

    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
t AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, m, array_to_string(w[s:s+m-1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(generate_series(1, len(w) - m + 1)) AS s FROM w, range(1, 6) k(m) WHERE len(w) >= m)),
f AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS w, count(*)::HUGEINT AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 100),
c AS (SELECT lang, phrase, m, k, f AS a, array_to_string(w[1:k], ' ') AS first, array_to_string(w[k+1:m], ' ') AS rest FROM (SELECT *, unnest(generate_series(1, m - 1)) AS k FROM f WHERE m >= 2)),
s AS (SELECT c.lang, c.phrase, c.m, c.k, c.a, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score FROM c JOIN f x ON x.lang = c.lang AND x.phrase = first JOIN f y ON y.lang = c.lang AND y.phrase = rest JOIN t ON t.lang = c.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM s) WHERE o = 1),
o AS (SELECT lang, m, f, unnest(generate_series(2, m - 1)) AS z, w FROM f WHERE m >= 3),
i AS (SELECT lang, array_to_string(w[j:j+z-1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(generate_series(1, m - z + 1)) AS j FROM o) GROUP BY 1, 2),
d AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE C) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM d) WHERE rank <= 2000
"""
