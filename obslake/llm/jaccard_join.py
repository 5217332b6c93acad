"""N-gram Jaccard join: near-duplicate documents and their groups, by a prefix-tree join.

A document's set holds its distinct shingles of `shingle` words (A-Z lower-cased);
a shorter text is one shingle, an empty one has none and links with nothing.  Two
documents link when 100 * |intersection| >= percent * |union|; groups are the
connected components of the links.

Method.
1. Documents with equal sets are one class; only its least id goes on.
2. Two global orders of shingles, rare ones before common ones; their frequencies
   are counted over all documents by a packed exchange.  In an order a set can be
   linked only to sets that share one of its first n - ceil(percent n / 100) + 1
   shingles.  Sets of up to SHORT shingles, and those that can be linked to them,
   count all their shingles.  Longer sets count a fixed share of the hash space, which
   comes first; the rest after it (a set of over SHORT has enough in the counted part
   but for chance).  Sets between the two stand in both orders.  So no short text
   meets others at a common shingle as long as it has a rarer one.  A set whose first
   shingles are all its own has no links and is done.
3. Sets that share such a shingle meet at the least id among its holders.  A
   meeting of more than `chunk` sets is dealt into chunks, each with the hub.
4. In a chunk the sets stand in a compressed trie in hash order.  Every set is run
   against the trie of those before it: a node's overlap is counted once for all
   sets below it, and a subtree is left when its overlap so far plus what can
   remain on either side is under what its shortest set needs.  Sets that are
   already connected are not compared again.
5. Sets of a chunked meeting that are not connected with its hub are run against
   the other chunks too, in blocks; those connected with it need not be, as their
   component is settled.  So no pair of unequal components goes unseen, and no
   group is gathered in one task.
6. Components of the links, by alternating stars over the edge table.

Shingles are compared by 48 bits of their hashes, sets found equal by two 64-bit sums
of the hashes and the size.

Edge cases: null or blank text has the empty set; a null id stands for the least
id; rows with one id are one node of the graph (each row keeps its n_shingles), so
repeated rows are too; ties for the least id cannot be; very long texts are read
whole; columns other than the id and the text take no part and aren't returned,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .common import checkpointed, release
from .components import components
from .text import BYTE_LOWER, WORD, Words, column_bytes, mix, window_hash

SAMPLED, SHORT = 0.3, 128
SALT = np.uint64(0x8CB92BA72F3D8DD7)
LEAST_ID = -(1 << 63)


def shingles(buf, off, size: int) -> list[np.ndarray]:
    """Each document's sorted distinct shingle hashes."""
    words = Words(buf, off, WORD, BYTE_LOWER)
    full = window_hash(words.hashes, size)
    o = words.offsets.tolist()
    out = []
    for a, z in zip(o, o[1:]):
        if z - a >= size:
            out.append(np.unique(full[a : z - size + 1]))
        else:
            out.append(window_hash(words.hashes[a:z], z - a, seed=z - a) if z > a else np.zeros(0, np.uint64))
    return out


def fingerprints(sets):
    """Two 64-bit sums of each set."""
    n = len(sets)
    one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            one[i], two[i] = np.add.reduce(s), np.add.reduce(mix(s))
    return one.view(np.int64), two.view(np.int64)


def needed(n: int, percent: int) -> int:
    """Least overlap that a set of n can have with a set it is linked to."""
    return -(-percent * n // 100)


class Node:
    __slots__ = ("tokens", "children", "sets", "low", "high")

    def __init__(self, tokens, n):
        self.tokens, self.children, self.sets, self.low, self.high = tokens, {}, [], n, n


class Trie:
    """Sorted sets in a compressed prefix tree, with the sizes of the sets below each node."""

    def __init__(self, percent: int):
        self.root, self.percent = Node(np.zeros(0, np.int64), 0), percent
        self.root.low = 1 << 60

    def add(self, s, name) -> None:
        node, at, n = self.root, 0, len(s)
        while True:
            node.low, node.high = min(node.low, n), max(node.high, n)
            if at == n:
                node.sets.append(name)
                return
            child = node.children.get(int(s[at]))
            if child is None:
                leaf = Node(s[at:], n)
                leaf.sets.append(name)
                node.children[int(s[at])] = leaf
                return
            t = child.tokens
            m = min(len(t), n - at)
            differ = np.flatnonzero(t[:m] != s[at : at + m])
            same = int(differ[0]) if len(differ) else m
            if same < len(t):  # split the edge
                upper = Node(t[:same], child.low)
                upper.low, upper.high = child.low, child.high
                child.tokens = t[same:]
                upper.children[int(child.tokens[0])] = child
                node.children[int(t[0])] = upper
                child = upper
            node, at = child, at + same

    def linked(self, s, settled):
        """Names of sets linked to s; settled(name) tells those that need no look."""
        n, percent = len(s), self.percent
        todo = [(c, 0, 0) for c in self.root.children.values()]
        while todo:
            node, overlap, depth = todo.pop()
            if percent * node.low > 100 * n or 100 * node.high < percent * n:
                continue
            if not node.children and all(settled(x) for x in node.sets):
                continue
            t = node.tokens
            at = np.searchsorted(s, t)
            overlap += int(np.count_nonzero(s[np.minimum(at, n - 1)] == t))
            depth += len(t)
            rest = min(n - int(np.searchsorted(s, t[-1], "right")), node.high - depth)
            if (100 + percent) * (overlap + rest) < percent * (n + node.low):
                continue
            if node.sets and (100 + percent) * overlap >= percent * (n + depth):
                yield from (x for x in node.sets if not settled(x))
            todo.extend((c, overlap, depth) for c in node.children.values())


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i, k):
        i, k = self.find(i), self.find(k)
        if i == k:
            return False
        self.up[max(i, k)] = min(i, k)
        return True


def trie_join(sets, percent, roles=None):
    """Links [(i, k)] that connect all that is linked among the sets; with roles, only pairs of unlike roles are looked at."""
    known, links = Union(len(sets)), []
    if roles is None:
        tries = {None: Trie(percent)}
    else:
        tries = {r: Trie(percent) for r in set(roles)}
    for i in sorted(range(len(sets)), key=lambda k: len(sets[k])):
        s = sets[i]
        if not len(s):
            continue
        for role, trie in tries.items():
            if roles is not None and role == roles[i]:
                continue
            for k in trie.linked(s, lambda x: known.find(x) == known.find(i)):
                if known.join(i, k):
                    links.append((i, k))
        tries[None if roles is None else roles[i]].add(s, i)
    return links, known


def _sets(table):
    raw, lens = B.blob(table, "set")
    return np.split(B.from48(raw).astype(np.int64), np.cumsum(lens // 6)[:-1]) if len(lens) else []


MET = "hub long, u long, v long, rest boolean"


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, percent: int = 85, chunk: int = 512, block_bytes: int | None = None) -> DataFrame:
    """(id_col, n_shingles, class_id, component_id), a row for each row of df."""
    texts = df.select(id_col, text_col)
    ID, FP = "__ob_id", "__ob_fp"

    def sign(batches):
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                sets = shingles(*column_bytes(part.column(text_col)), shingle)
                one, two = fingerprints(sets)
                yield pa.RecordBatch.from_arrays([part.column(id_col).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two)], names=["id", "n", "f", "g"])
        release()

    signed = texts.mapInArrow(sign, "id long, n long, f long, g long").withColumn(ID, F.coalesce("id", F.lit(LEAST_ID)))
    signed = checkpointed(signed)
    classes = signed.where("n > 0").groupBy("n", "f", "g").agg(F.min(ID).alias("class"))
    member = signed.join(classes, ["n", "f", "g"], "left").withColumn("class", F.coalesce("class", F.col(ID)))
    cuts = B.cut_points(texts, id_col, text_col, block_bytes)
    n = cuts.buckets
    blocked = B.dealt(texts, id_col, cuts)
    # rows of a class but its least id, told to their blocks
    eight = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    copies = B.with_block(member.where(F.col("class") != F.col(ID)), "id", cuts).select(B.BLOCK, F.lit(-1).alias("bucket"), eight(F.col(ID)).alias("a"), eight(F.col("f")).alias("b"), F.lit(None).cast("binary").alias("c"))

    def unique_sets(table, told):
        """The block's sets that stand for their classes, with their ids."""
        table = B.ordered(table, id_col, text_col)
        sets = shingles(*column_bytes(table.column(text_col)), shingle)
        ids = B.ids_of(table, id_col)
        gone = set()
        if len(told):
            told = told.filter(pc.equal(told.column("bucket"), -1))
            gone = set(zip(np.frombuffer(bytes(B.blob(told, "a")[0]), ">i8").tolist(), np.frombuffer(bytes(B.blob(told, "b")[0]), ">i8").tolist()))
        marks = zip(ids.tolist(), fingerprints(sets)[0].tolist())
        keep = [i for i, m in enumerate(marks) if len(sets[i]) and m not in gone]
        return [sets[i] for i in keep], ids[keep]

    edge = np.uint64(int(SAMPLED * 2**64))

    def orders(s):
        """(keys in order, how many of the first are counted) of a set in each order that it stands in."""
        if percent * len(s) <= 100 * SHORT:
            mine = np.sort(mix(s ^ SALT))
            yield mine, len(mine)
        if len(s) > SHORT:
            yield s, int(np.searchsorted(s, edge))

    def counted(sets):
        every = [keys[:k] for s in sets for keys, k in orders(s)]
        return np.unique(np.concatenate(every) if every else np.zeros(0, np.uint64), return_counts=True)

    def send(table, told):
        if not len(table):
            return B.empty(B.ENTRY_ARROW)
        keys, counts = counted(unique_sets(table, told)[0])
        return B.scatter(table.column(B.BLOCK)[0].as_py(), B.bucket_of(keys, n), n, B.low48(keys), np.minimum(counts, 65535).astype("<u2")).cast(B.ENTRY_ARROW)

    def frequent(table):
        bucket = B.number_of(table, n)
        raw, lens = B.blob(table, "a")
        keys, sizes = B.from48(raw), lens // 6
        counts = np.frombuffer(bytes(B.blob(table, "b")[0]), "<u2").astype(np.int64)
        block = np.repeat(table.column(B.BLOCK).to_numpy(), sizes)
        place = np.arange(len(keys)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if not len(keys):
            return B.empty(B.ANSWER_ARROW)
        order = np.argsort(keys)
        starts = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]]))
        total = np.empty(len(keys), np.int64)
        total[order] = np.repeat(np.add.reduceat(counts[order], starts), np.diff(np.concatenate([starts, [len(keys)]])))
        told = total > 1
        return B.answers(bucket, block[told], place[told].astype("<u4"), np.minimum(total[told], 2**32 - 1).astype("<u4"))

    FOUND = pa.schema([("id", pa.int64()), ("first", pa.list_(pa.int64())), ("set", pa.binary())])

    def candidates(table, told):
        if not len(table):
            return FOUND.empty_table()
        sets, ids = unique_sets(table, told)
        keys, _ = counted(sets)
        order, bounds = B.entry_index(keys, B.bucket_of(keys, n), n)
        at, total = B.answered(told.filter(pc.greater_equal(told.column("bucket"), 0)), order, bounds, {"a": np.uint32, "b": np.uint32})
        times = np.ones(len(keys), np.int64)
        times[at] = total
        got = []
        for i, s in zip(ids.tolist(), sets):
            spare, first = len(s) - needed(len(s), percent), []
            for mine, k in orders(s):
                often = times[np.searchsorted(keys, mine[:k])]
                if int(np.count_nonzero(often == 1)) > spare:
                    continue  # more shingles of its own than a link allows
                rank = np.argsort(often, kind="stable")[: spare + 1]
                first.append(mine[:k][rank[often[rank] > 1]])
                if k < spare + 1:
                    first.append(mine[k : spare + 1])
            first = np.concatenate(first) if first else np.zeros(0, np.uint64)
            if len(first):
                got.append({"id": i, "first": (first >> np.uint64(16)).astype(np.int64), "set": B.low48(s).tobytes()})
        return pa.Table.from_pylist(got, schema=FOUND)

    told = B.by_bucket(B.with_answers(blocked, copies, send, B.ENTRY), cuts, frequent)
    found = checkpointed(B.with_answers(blocked, told.unionByName(copies), candidates, "id long, first array<bigint>, set binary"))

    holders = found.select(F.explode("first").alias("t"), "id")
    hubs = holders.groupBy("t").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").drop("last")
    met = checkpointed(holders.join(hubs, "t").where("id <> hub").select("hub", "id").distinct())
    sizes = met.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    dealt = met.join(sizes, "hub").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    every_hub = sizes.select("hub", F.col("hub").alias("id"), "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    sets = found.select("id", "set")
    seats = dealt.select("hub", "id", "chunks", "chunk").unionByName(every_hub)

    def meet(table):
        ids, hub, many = table.column("id").to_numpy(), table.column("hub")[0].as_py(), table.column("chunks")[0].as_py() > 1
        links, known = trie_join(_sets(table), percent)
        rows = [{"hub": hub, "u": int(ids[i]), "v": int(ids[k]), "rest": False} for i, k in links]
        if many:
            home = known.find(int(np.flatnonzero(ids == hub)[0]))
            rows += [{"hub": hub, "u": int(ids[i]), "v": int(ids[i]), "rest": True} for i in range(len(ids)) if known.find(i) != home]
        return pa.Table.from_pylist(rows, schema=pa.schema([("hub", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("rest", pa.bool_())]))

    # meetings are small in bytes and large in work: dealt out by count, not gathered by size
    spread = cuts.tasks
    first = checkpointed(seats.join(sets, "id").repartition(spread, "hub", "chunk").groupBy("hub", "chunk").applyInArrow(meet, MET))

    # sets that a chunked meeting left unconnected with its hub, against its other chunks
    rest = first.where("rest").select("hub", F.col("u").alias("id"))
    parts = rest.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("parts"))
    left = rest.join(parts, "hub").join(sizes, "hub").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    left = left.select("hub", "id", "part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"))
    right = dealt.join(parts, "hub").select("hub", "id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "chunk", F.lit(0).alias("role"))

    def cross(table):
        ids, hub = table.column("id").to_numpy(), table.column("hub")[0].as_py()
        links, _ = trie_join(_sets(table), percent, table.column("role").to_pylist())
        rows = [{"hub": hub, "u": int(ids[i]), "v": int(ids[k]), "rest": False} for i, k in links if ids[i] != ids[k]]
        return pa.Table.from_pylist(rows, schema=pa.schema([("hub", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("rest", pa.bool_())]))

    second = left.unionByName(right).join(sets, "id").repartition(spread, "hub", "chunk", "part").groupBy("hub", "chunk", "part").applyInArrow(cross, MET)
    grouped = components(first.where("not rest").select("u", "v").unionByName(second.select("u", "v")))
    out = member.join(grouped.withColumnRenamed("node", "class"), "class", "left")
    own = lambda c: F.when(F.col("id").isNull() & (F.col(c) == LEAST_ID), None).otherwise(F.col(c))
    return out.withColumn("component", F.coalesce("component", "class")).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own("class").alias("class_id"), own("component").alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: per document the size of its set and its component."""
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT DISTINCT u AS doc_id, u AS c FROM e UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.doc_id WHERE r.c < e.v)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce((SELECT min(c) FROM r WHERE r.doc_id = d.doc_id), d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id)
"""
