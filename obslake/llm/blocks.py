"""Documents in blocks, and packed exchanges between blocks and hash buckets.

Several operators ask one question of each of many small keys (a shingle, an
anchor, a word): where else in the corpus is it?  A row a key would cost tens of
bytes of shuffle for six bytes of information, so the keys travel packed:

* documents are dealt into blocks, ranges of the identifier of a few megabytes,
  by one shuffle that later rounds use again;
* each block sends its distinct keys, packed by hash bucket (a key occurs once a
  block, so a hot key costs one entry a block, not one a document);
* each bucket answers with packed entry numbers, grouped by block;
* blocks and answers meet in a cogroup.

Block order is identifier order: (block, position) compares as (id, position).
All work of a block or bucket is recomputed alike after the loss of an executor.
"""

from __future__ import annotations

import inspect
import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import release

BLOCK, BUCKET = "__ob_block", "__ob_bucket"
BLOCK_BYTES, MOST_BYTES, MOST_RANGES = 4 << 20, 16 << 20, 4096
#: text that one task, and one bucket, of an exchange stands for at most, whatever spark.sql.shuffle.partitions says
TASK_BYTES, BUCKET_BYTES = 128 << 20, 16 << 20
ENTRY = f"{BUCKET} int, {BLOCK} int, a binary, b binary, c binary"
ANSWER = f"{BLOCK} int, bucket int, a binary, b binary, c binary"


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


class Buckets(int):
    """A number of buckets, and the tasks that they are dealt to."""

    tasks: int

    def __new__(cls, n: int, tasks: int):
        made = super().__new__(cls, n)
        made.tasks = tasks
        return made

    def __reduce__(self):
        return Buckets, (int(self), self.tasks)


def _spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash() of ints (Murmur3, seed 42), by which rows are dealt to partitions."""
    turn = lambda v, r: v << np.uint32(r) | v >> np.uint32(32 - r)
    h = np.uint32(42) ^ (turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593))
    h = turn(h, 13) * np.uint32(5) + np.uint32(0xE6546B64) ^ np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


@cache
def _labels(n: int, tasks: int) -> np.ndarray:
    """Labels of n buckets, ascending, of which Spark's hash puts as many as can be alike into each task: a few bytes for BUCKET_BYTES of text."""
    each, size = -(-n // tasks), 4 * n + 64
    while True:
        slot = _spark_hash(np.arange(size)).astype(np.int64) % tasks
        order = np.argsort(slot, kind="stable")
        first = np.searchsorted(slot[order], np.arange(tasks))
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size) - first[slot[order]]
        good = np.flatnonzero(rank < each)
        if len(good) >= min(n, each * tasks):
            return good[:n].astype(np.int32)
        size *= 2


def labels_of(n: Buckets) -> np.ndarray:
    return _labels(int(n), n.tasks)


def number_of(table: pa.Table, n: Buckets) -> int:
    """The number of the bucket that the rows are for."""
    return int(np.searchsorted(labels_of(n), table.column(BUCKET)[0].as_py()))


@dataclass(frozen=True)
class Cuts:
    """Ranges of ids (edges: least id, cut points, greatest id), each parted evenly into `parts` blocks; and the tasks and buckets that the measured text needs."""

    edges: tuple[float, ...]
    parts: int
    tasks: int = 1
    buckets: Buckets = Buckets(2, 1)


def cut_points(df: DataFrame, id_col: str, text_col: str, block_bytes: int | None = None) -> Cuts:
    """Ids that part df into blocks. One scan measures the bytes, one finds the cut points.

    A block has BLOCK_BYTES, up to MOST_BYTES on inputs of many blocks a partition; block_bytes sets it. At most
    MOST_RANGES quantiles are asked for; past that the ranges between them are parted by arithmetic.
    """
    n = partitions(df)
    seen = df.agg(F.sum(F.octet_length(text_col).cast("long")).alias("b"), F.min(id_col).cast("double").alias("low"), F.max(id_col).cast("double").alias("high")).first()
    total = seen["b"] or 0
    size = block_bytes or min(MOST_BYTES, max(BLOCK_BYTES, total // (8 * n)))
    want = max(n, math.ceil(total / size))
    tasks = max(n, math.ceil(total / TASK_BYTES))
    buckets = Buckets(max(2 * tasks, math.ceil(total / BUCKET_BYTES)), tasks)
    if want == 1 or seen["low"] is None:
        return Cuts((), 1, tasks, buckets)
    ranges = min(want, MOST_RANGES)
    cuts = df.agg(F.percentile_approx(id_col, [i / ranges for i in range(1, ranges)], max(10_000, 20 * ranges)).alias("c")).first()["c"]
    return Cuts(tuple(sorted({seen["low"], *map(float, cuts), seen["high"] + 1})), math.ceil(want / ranges), tasks, buckets)


def with_block(df: DataFrame, id_col: str, cuts: Cuts) -> DataFrame:
    """df with its block, a range of ids in the order of the ids; a null id comes before all others, and rows with one id share a block."""
    inner = cuts.edges[1:-1]
    if not inner and cuts.parts == 1:
        return df.withColumn(BLOCK, F.lit(0))
    from pyspark.ml.feature import Bucketizer  # on the driver only: Python workers import this module too

    at, key = "__ob_at", "__ob_key"
    out = df.withColumn(key, F.coalesce(F.col(id_col).cast("double"), F.lit(-1.7e308)))
    if inner:
        out = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol=key, outputCol=at).transform(out)
    else:
        out = out.withColumn(at, F.lit(0.0))
    block = F.col(at).cast("int")
    if cuts.parts > 1:
        edges = F.array(*[F.lit(e) for e in cuts.edges])
        low, high = F.get(edges, block), F.get(edges, block + 1)
        part = (F.col(key) - low) / (high - low) * cuts.parts
        block = block * cuts.parts + F.least(F.greatest(part, F.lit(0.0)), F.lit(cuts.parts - 1.0)).cast("int")
    return out.withColumn(BLOCK, block).drop(at, key)


def dealt(df: DataFrame, id_col: str, cuts: Cuts) -> DataFrame:
    """df with its block, dealt out by it."""
    return with_block(df, id_col, cuts).repartition(cuts.tasks, BLOCK)


def ordered(table: pa.Table, id_col: str, text_col: str) -> pa.Table:
    """A block's rows by id, then text: the one order that all rounds use."""
    keys = pa.table({"i": pc.fill_null(table.column(id_col).cast(pa.int64()), -(1 << 63)), "r": pa.array(np.arange(len(table)))})
    ids = keys.column("i").to_numpy()
    if len(ids) > 1 and (np.sort(ids)[1:] == np.sort(ids)[:-1]).any():  # rows with one id: by text
        texts = pc.fill_null(table.column(text_col), "").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        return table.take(pa.array(order))
    return table.take(pa.array(np.argsort(ids, kind="stable")))


def ids_of(table: pa.Table, id_col: str) -> np.ndarray:
    return pc.fill_null(table.column(id_col).cast(pa.int64()), -(1 << 63)).to_numpy()


def low48(x: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each hash, six bytes each."""
    return np.ascontiguousarray((x >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def from48(raw) -> np.ndarray:
    six = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view("<u8").reshape(-1)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys & np.uint64(0xFFFF_FFFF)).astype(np.int64) % n


def scatter(block: int, buckets: np.ndarray, n: Buckets, *parts: np.ndarray) -> pa.Table:
    """Entry rows of one block: the parts (arrays of fixed-width items) packed by bucket, order kept within each."""
    order = np.argsort(buckets, kind="stable")
    bounds = np.searchsorted(buckets[order], np.arange(n + 1))
    used = np.flatnonzero(np.diff(bounds))
    cols = []
    for p in parts:
        raw = np.ascontiguousarray(p[order])
        width = raw.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
        cols.append(_packed(raw.view(np.uint8).reshape(-1), bounds * width, used))
    none = pa.nulls(len(used), pa.binary())
    return pa.table([pa.array(labels_of(n)[used]), pa.array(np.full(len(used), block, np.int32)), *cols, *[none] * (3 - len(cols))], names=[BUCKET, BLOCK, "a", "b", "c"])


def scatter_each(block: int, n: Buckets, *parts: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """Entry rows of one block from parts of (bucket of each item, items) with unlike numbers of items."""
    sizes = [np.bincount(buckets, minlength=n) for buckets, _ in parts]
    used = np.flatnonzero(sum(sizes))
    cols = []
    for (buckets, items), size in zip(parts, sizes):
        raw = np.ascontiguousarray(items[np.argsort(buckets, kind="stable")])
        width = raw.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
        cols.append(_packed(raw.view(np.uint8).reshape(-1), width * np.concatenate([[0], np.cumsum(size)]), used))
    none = pa.nulls(len(used), pa.binary())
    return pa.table([pa.array(labels_of(n)[used]), pa.array(np.full(len(used), block, np.int32)), *cols, *[none] * (3 - len(cols))], schema=ENTRY_ARROW)


def _packed(raw, bounds, used):
    ends = np.concatenate([bounds[used], bounds[-1:]]).astype(np.int32)  # unused buckets are empty, so the used ones stand end to end
    return pa.Array.from_buffers(pa.binary(), len(used), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])


def blob(table: pa.Table, name: str) -> tuple[bytes | memoryview, np.ndarray]:
    """All bytes of a binary column end to end, and the bytes of each row."""
    col = table.column(name)
    arrays = [c for c in col.chunks if len(c)]
    if not arrays:
        return b"", np.zeros(0, np.int64)
    data, lens = [], []
    for c in arrays:
        d, o = column_of(c)
        data.append(d), lens.append(np.diff(o))
    return np.concatenate(data), np.concatenate(lens)


def column_of(c):
    if c.null_count:
        c = pc.fill_null(c, b"")
    _, off, data = c.buffers()
    o = np.frombuffer(off, np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


ENTRY_ARROW = pa.schema([(BUCKET, pa.int32()), (BLOCK, pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
ANSWER_ARROW = pa.schema([(BLOCK, pa.int32()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def answers(bucket: int, blocks: np.ndarray, *parts: np.ndarray) -> pa.Table:
    """Answer rows of one bucket: the parts packed by block."""
    if not len(blocks):
        return empty(ANSWER_ARROW)
    order = np.argsort(blocks, kind="stable")
    b = blocks[order]
    first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    bounds = np.concatenate([first, [len(b)]])
    cols = []
    for p in parts:
        raw = np.ascontiguousarray(p[order])
        width = raw.itemsize * (raw.shape[1] if raw.ndim > 1 else 1)
        cols.append(_packed(raw.view(np.uint8).reshape(-1), bounds * width, np.arange(len(first))))
    none = pa.nulls(len(first), pa.binary())
    return pa.table([pa.array(b[first].astype(np.int32)), pa.array(np.full(len(first), bucket, np.int32)), *cols, *[none] * (3 - len(cols))], schema=ANSWER_ARROW)


def entry_index(keys: np.ndarray, buckets: np.ndarray, n: int):
    """For the answers of each bucket: the block's keys in the order in which scatter() sent them."""
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(n + 1))


def answered(table: pa.Table, order: np.ndarray, bounds: np.ndarray, dtypes: dict) -> list[np.ndarray]:
    """Indices of the block's keys that have an answer, and the other answered parts, by column."""
    got = {k: [] for k in dtypes}
    if len(table):
        buckets = table.column("bucket").to_numpy()
        raw = {k: blob(table, k) for k in dtypes}
        at = {k: 0 for k in dtypes}
        for i, bucket in enumerate(buckets):
            for k, t in dtypes.items():
                d, lens = raw[k]
                part = np.frombuffer(d[at[k] : at[k] + lens[i]].tobytes(), t)
                at[k] += lens[i]
                got[k].append(order[bounds[bucket] + part] if k == "a" else part)
    return [np.concatenate(v) if v else np.zeros(0, np.int64 if k == "a" else dtypes[k]) for k, v in got.items()]


def _tidy(work):
    """work, after what the group before it has freed went back to the system."""

    def one(table):
        release()
        return work(table)

    def two(left, right):
        release()
        return work(left, right)

    return one if len(inspect.signature(work).parameters) == 1 else two


def by_bucket(entries: DataFrame, cuts: Cuts, decide, schema: str = ANSWER) -> DataFrame:
    return entries.repartition(cuts.tasks, BUCKET).groupBy(BUCKET).applyInArrow(_tidy(decide), schema)


def per_block(blocked: DataFrame, work, schema) -> DataFrame:
    return blocked.groupBy(BLOCK).applyInArrow(_tidy(work), schema)


def with_answers(blocked: DataFrame, replies: DataFrame, work, schema) -> DataFrame:
    """work(documents of a block, answers to it); a block without documents is skipped."""
    return blocked.groupBy(BLOCK).cogroup(replies.groupBy(BLOCK)).applyInArrow(_tidy(work), schema)
