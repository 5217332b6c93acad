"""Copies of documents so that sources get given shares of the words, by pivotal dependent rounding.

A source's target is its weight's part of all words that the mix takes, at most `most` times its own size; what it can't
take is shared out again by weight until no source is above. Then each of its documents is wanted target / size times:
a whole number of copies and a fraction. Fractions are rounded together, not one by one:

* two open documents meet, and words move between them at random, up or down, as far as one of them becomes whole;
  the odds are such that each keeps its expected number of copies, and the words of both together stay what they were;
* the open one meets the next document. Documents come from large to small, so that what stays open is small;
* a source's documents are dealt into leaves of about LEAF by a hash. A leaf settles all but one document and its
  RESERVE smallest, which meet those of FAN leaves at the next node, and so on up a tree to one node a source;
* at the top, the one that is still open and the TOP smallest are rounded in turn, from large to small, each with all that are
  smaller than it: what it gains or loses is spread over them in proportion. Of documents with one fraction, this too keeps
  each one's expectation, as long as those after it have words enough. The very last is rounded to the nearer number, so a source's words miss its target by at most half
  of its smallest open document, unless a large one that is still open there outweighs the TOP smallest: then by half of that.

Which documents meet, and what chance says, depends on ids, texts and the seed only, never on partitions or on the order of
rows: a second run, or a task run again, gives the same mix.

Edge cases: a null or blank text has no words; its copies are drawn by its fraction alone and take nothing; a null source is a
source of its own, the last; a source without words, or an empty table, has target 0; null ids are told apart by their
texts; rows with one id and text are each rounded, share a leaf, and may get unlike numbers of copies; very long
texts are counted whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.numbering import numbered
from .common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
LEAF, RESERVE, FAN, TOP = 1024, 16, 32, 64
#: sources with more than a HOT-th of the documents, fewer than HOT, go to all tasks if their names have at most NAME bytes: 10 MB at most
HOT, NAME = 10_000, 1024
NEAR = 1e-9
ROW = "doc_id long, size long, tie long, source_no long, source_size long, target double, leaves long, leaf long, whole int, part double"
OUT = f"{ROW}, copies int"
KEYS = ["source_no", "leaf"]


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, size, tie, source): a few bytes a document; tie tells texts of one id apart."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("tie"), F.col(source_col).cast("string").alias("source"))


def targets(rows: DataFrame, weights: tuple[int, ...], share: tuple[int, int], most: int, scratch: Scratch) -> DataFrame:
    """(source, source_no, source_size, documents, target) of rows(source, size).

    All that isn't at its limit gets a level times its weight. The level is found from below: with the sources that
    are above their limit at the last level taken out, it rises until no more sources pass theirs. Each turn is a sum over the table of sources.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    named = numbered(sums, [], [F.asc_nulls_last("source")], "source_no")
    weight = F.get(F.array(*[F.lit(w) for w in weights]), ((F.col("source_no") - 1) % len(weights)).cast("int")).cast("long")
    named = scratch.keep(named.withColumn("weight", weight))
    whole = named.agg(F.sum("source_size"), F.sum("weight")).first()
    total, (up, down) = whole[0] or 0, share
    limit = most * F.col("source_size")
    level, by, full = share[0] * total, down * (whole[1] or 1), None  # the level is level / by
    while True:
        at = (F.col("weight") * F.lit(level).cast("decimal(38,0)") >= limit * F.lit(by).cast("decimal(38,0)")) if total else F.lit(True)
        got = named.agg(F.sum(F.when(at, limit)).alias("full"), F.sum(F.when(~at, F.col("weight"))).alias("weight")).first()
        if got["full"] == full or not got["weight"]:
            break
        full, level, by = got["full"], up * total - down * (got["full"] or 0), down * got["weight"]
    target = F.when(at, limit.cast("double")).otherwise((F.col("weight") * F.lit(level).cast("decimal(38,0)")).cast("double") / F.lit(float(by)))
    return scratch.keep(named.select("source", "source_no", "source_size", "documents", target.alias("target")))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with their source's figures: sources of many documents, of which there can only be few, are sent to all tasks; no other source is large enough to weigh in a shuffle."""
    every = sources.agg(F.sum("documents")).first()[0] or 0
    is_hot = (F.col("documents") * HOT > every) & (F.coalesce(F.octet_length("source"), F.lit(0)) <= NAME)
    hot, cold = sources.where(is_hot), sources.where(~is_hot)
    same = F.col("r.source").eqNullSafe(F.col("s.source"))
    columns = ["r.doc_id", "r.size", "r.tie", "s.source_no", "s.source_size", "s.target", "s.documents"]
    out = rows.alias("r").join(F.broadcast(hot.alias("s")), same).select(*columns)
    if cold.isEmpty():
        return out
    left = rows.alias("r").join(F.broadcast(hot.select("source").alias("s")), same, "left_anti")
    return out.unionByName(left.alias("r").join(cold.alias("s"), same).select(*columns))


def chance(*keys: int) -> float:
    """A number in [0, 1) that the keys fix."""
    x = 0x9E3779B97F4A7C15
    for k in keys:
        x = (x ^ k) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 29
        x = x * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
    return (x >> 11) / (1 << 53)


def meet(a: tuple[int, float], b: tuple[int, float], draw: float) -> tuple[float, float]:
    """New fractions of two documents (size, fraction): one becomes whole, the words of both together and each one's expectation stay."""
    (s, p), (t, q) = a, b
    up, down = min(s * (1 - p), t * q), min(s * p, t * (1 - q))
    if draw * (up + down) < down:  # words go from b to a
        p, q = (1.0, q - up / t) if s * (1 - p) <= t * q else (p + up / s, 0.0)
    else:
        p, q = (0.0, q + down / t) if s * p <= t * (1 - q) else (p - down / s, 1.0)
    return p, q


def in_turn(parts: list[tuple[int, float]], draws: list[float]) -> list[int]:
    """0 or 1 for each (size, fraction), in the order given: each is rounded at random, and those after it take the difference."""
    sizes, p, out = [s for s, _ in parts], [q for _, q in parts], []
    for i, draw in enumerate(draws):
        rest = range(i + 1, len(p))
        low, high = sum(sizes[j] * p[j] for j in rest), sum(sizes[j] * (1 - p[j]) for j in rest)  # what the rest can give, and take
        need = sizes[i] * (1 - p[i]), sizes[i] * p[i]
        short = need[0] - low, need[1] - high
        up = draw < p[i] if max(short) <= 0 else short[0] < short[1]
        for j in rest:
            p[j] = p[j] * (1 - min(1.0, need[0] / low)) if up and low else p[j] + (1 - p[j]) * min(1.0, need[1] / high) if not up and high else p[j]
        out.append(int(up))
    return out


def _settled(p: float) -> int | None:
    return 0 if p <= NEAR else 1 if p >= 1 - NEAR else None


class Node:
    """The open documents of one source at one node of its tree, from large to small."""

    def __init__(self, last: bool, seed: int, out):
        self.last, self.seed, self.out = last, seed, out
        self.waiting: deque = deque()
        self.open = None

    def add(self, row: list) -> None:
        if _settled(row[-1]) is not None:
            self.out(row, _settled(row[-1]))
        elif not row[1]:
            self.out(row, int(chance(self.seed, row[0] or 0, row[2]) < row[-1]))
        else:
            self.waiting.append(row)
            if len(self.waiting) > (TOP if self.last else RESERVE):
                self._next(self.waiting.popleft())

    def _next(self, row: list) -> None:
        if self.open is None:
            self.open = row
            return
        a = self.open
        a[-1], row[-1] = meet((a[1], a[-1]), (row[1], row[-1]), chance(self.seed, a[0] or 0, a[2], row[0] or 0, row[2]))
        self.open = None
        for x in (a, row):
            done = _settled(x[-1])
            if done is None:
                self.open = x
            else:
                self.out(x, done)

    def end(self) -> None:
        """What is left goes up the tree, or is rounded at its top."""
        left = [row for row in [self.open, *self.waiting] if row is not None]
        left.sort(key=lambda row: -row[1])
        if self.last:
            draws = [chance(self.seed, row[0] or 0, row[2]) for row in left]
            for row, more in zip(left, in_turn([(row[1], row[-1]) for row in left], draws)):
                self.out(row, more)
        else:
            for row in left:
                self.out(row, None)


def _rounded(rows: DataFrame, seed: int) -> DataFrame:
    """One level of the tree: rows with copies, null where they go on."""
    dealt = rows.repartition(*KEYS).sortWithinPartitions(*KEYS, F.desc("size"), "doc_id", "tie", "part")
    names, kinds = [c.split()[0] for c in OUT.split(", ")], [c.split()[1] for c in OUT.split(", ")]
    arrow = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}

    def work(batches):
        done: list = []
        node, key = None, None

        def batch():
            cols = list(zip(*done)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, k in zip(cols, kinds)], names=names)

        def out(row, more):
            done.append((*row, None if more is None else row[-2] + more))

        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in names[:-1]]):
                if key != (row[3], row[7]):
                    if node:
                        node.end()
                    key, node = (row[3], row[7]), Node(row[6] == 1, seed, out)
                node.add(list(row))
            yield batch()
        if node:
            node.end()
        yield batch()

    return dealt.select(*names[:-1]).mapInArrow(work, OUT)


def copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, tie, size, source_size, target, copies, taken) of each row of docs.

    weights repeat over the sources in the order of their names; the mix takes share[0] / share[1] times all words; no source takes more than `most` times its own.
    """
    with Scratch(docs.sparkSession, "mix") as scratch:
        rows = scratch.keep(sized(docs, id_col, text_col, source_col))
        known = scratch.keep(_with_source(rows, targets(rows, weights, share, most, scratch)))
        wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        leaves = F.ceil(F.col("documents") / LEAF)
        leaf = F.pmod(F.xxhash64("doc_id", "tie", F.lit(seed)), leaves)
        whole = F.floor(wanted + NEAR)
        level = known.select("doc_id", "size", "tie", "source_no", "source_size", "target", leaves.alias("leaves"), leaf.alias("leaf"), whole.cast("int").alias("whole"), F.greatest(wanted - whole, F.lit(0.0)).alias("part"))
        most_leaves = level.agg(F.max("leaves")).first()[0] or 1
        parts = []
        while True:
            got = scratch.keep(_rounded(level, seed))
            parts.append(got.where("copies IS NOT NULL"))
            if most_leaves == 1:
                break
            most_leaves = math.ceil(most_leaves / FAN)
            up = got.where("copies IS NULL").drop("copies")
            level = up.withColumns({"leaf": F.floor(F.col("leaf") / FAN), "leaves": F.ceil(F.col("leaves") / FAN)})
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return scratch.result(out.select("doc_id", "tie", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mixed(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken. Ids must tell rows apart and not be null."""
    taken = copies(docs, id_col=id_col, **options)
    if not taken.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").isEmpty():
        raise ValueError("a mix needs an id of its own for each row")
    times: Column = F.explode(F.sequence(F.lit(1), F.col("n")))
    wanted = taken.where("copies > 0").select(F.col("doc_id").alias("i"), F.col("copies").alias("n"))
    return docs.join(wanted, F.col(id_col) == F.col("i")).withColumn("n", times).select(docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: what the mix takes of each document."""
    from .common import table

    return copies(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def targets_query(spark, sf_dir: str) -> DataFrame:
    """Each source's target, whether the words taken come within 1 % of it, and whether all documents keep to twice their size."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    by = copies(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "source_size", "target")
    near = F.abs(F.sum("taken") - F.col("target")) <= F.lit(0.01) * F.col("target")
    return by.agg(F.count(F.lit(1)).alias("documents"), near.alias("near"), (F.max(F.col("taken") - 2 * F.col("size")) <= 0).alias("within"))


#: taken is random, so SQL has the rest: targets, and that the words taken come near them
TARGETS_ORACLE = r"""
WITH s AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS documents FROM s GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY source_size * 1.0 / weight, source) AS k, coalesce(sum(2 * source_size) OVER (ORDER BY source_size * 1.0 / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(weight) OVER (ORDER BY source_size * 1.0 / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left, sum(source_size) OVER () AS total FROM w),
l AS (SELECT (3 * total - 2 * full_before) AS level, 2 * weight_left AS per FROM o WHERE weight * (3 * total - 2 * full_before) <= 2 * source_size * 2 * weight_left ORDER BY k LIMIT 1)
SELECT source, source_size, CASE WHEN weight * level >= 2 * source_size * per THEN 2.0 * source_size ELSE (weight * level)::DOUBLE / per END AS target, documents, true AS near, true AS within FROM o, l
"""
