"""Language-model scoring with a log-frequency Bloom filter.

Tokens are the words of a text, A-Z lower-cased, and one end token a document.
Training tokens are those of documents whose crc32 of the id (as text) modulo
`folds` isn't 0; the others are held out.

Method.  Blocks of documents send their distinct n-grams of 1 to `order` tokens,
packed by hash bucket, with the training counts of each; a bucket sums the counts,
builds its slice of the filter, probes it for all that it was sent, and answers the
blocks.  Counts are quantised to levels 1 + floor(log2 c), and an n-gram of level q
enters the filter as (n-gram, 1) ... (n-gram, q).  A count is read back by probing
(n-gram, 1), (n-gram, 2), ... until a miss, as the middle of its level.

The score's estimates go from short to long contexts.  p1(w) = (c(w)+0.1)/(N+0.1(V+1)).
Without a discount, pk(w|u) = weight c(u,w)/c(u) + (1-weight) p(k-1)(w).  With a
discount d, absolute discounting: pk(w|u) = max(c(u,w)-d, 0)/c(u) + d c(u)^(spread-1)
p(k-1)(w), at most 1, where c(u)^spread estimates how many tokens follow u (exactly
one where c(u) = 1); a context never seen leaves p(k-1).  The first tokens of a
document have the estimates that fit into it.  With quantised counts the estimates
of a context add up to 1 only about.

The filter holds all n-grams, those seen once too, at `bits` bits an insertion (a
false hit of one in fifty at 10 bits and 4 probes; errors are one-sided).  No slice
is broadcast and none is cut: buckets grow in number with the text, and there are as
many more as keep a slice's share of the bound on all insertions within max_bytes.
The number of buckets changes no count.  Longer n-grams travel as 32 bits of their
hashes beside the bucket's number, as differences of sorted neighbours in bytes of
seven bits: two of them are taken for one far more seldom than the filter errs.

base_score is exact: the buckets answer with the counts of all words too.  N and V
are summed over the buckets, from the answers in the shared folder.

Edge cases: null or blank text has the end token alone; a null id counts as the
text "", which is held out; without training tokens N and V are 0; rows with one
id, and repeated rows, are each scored and each learned from; equal texts have equal
scores; very long texts are scored whole (a block holds at least one text); an empty
table gives an empty table; extra columns pass through; a result column replaces an
input column of its name.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import blocks as B
from .common import extended, none_of, shared_dir, with_columns
from .text import BYTE_LOWER, WORD, Words, column_bytes, mix

HELD = "__ob_held"
END = np.uint64(0x5BF03635DCD6A5E1)
PROBES, LEVELS = 4, 48
PROBED = 1 << 20
#: marks the 32-bit keys of longer n-grams, so that none is a word's
GRAM = np.uint64(1 << 60)
#: the query's model
ORDER, DISCOUNT = 3, 0.75
TALLY = f"{B.ANSWER}, n long, v long"
_TALLY = pa.schema([*B.ANSWER_ARROW, ("n", pa.int64()), ("v", pa.int64())])


def tokens(buf, off):
    """Token hashes with the end tokens put in, and the n+1 token offsets of the documents."""
    words = Words(buf, off, WORD, BYTE_LOWER)
    at = words.offsets[1:]
    return np.insert(words.hashes, at, END), words.offsets + np.arange(len(off))


def longer(grams, h):
    """Hash of each token with the n-gram that ends before it (that of the first has no meaning)."""
    out = np.zeros(len(h), np.uint64)
    out[1:] = mix(grams[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] + np.uint64(1))
    return out


def _six(keys):
    return keys >> np.uint64(16)


def shrunk(keys: np.ndarray, starts: np.ndarray):
    """Keys (32 bits each) as differences, anew from each start, seven bits a byte; and the first byte of each key and of the end."""
    x = keys.astype(np.uint32)
    before = np.concatenate([np.zeros(1, np.uint32), x[:-1]])[: len(x)]
    before[starts[starts < len(x)]] = 0
    d = x - before
    n = 1 + sum((d >= np.uint32(1 << k)).astype(np.int64) for k in (7, 14, 21, 28))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        has = np.flatnonzero(n > k)
        out[at[has] + k] = ((d[has] >> np.uint32(7 * k)) & np.uint32(127)).astype(np.uint8) | (n[has] > k + 1).astype(np.uint8) << 7
    return out, at


def grown(raw: np.ndarray, row_bytes: np.ndarray):
    """The keys that shrunk() packed, of rows of some bytes each, and the number of keys in each row."""
    raw = np.frombuffer(bytes(raw), np.uint8)
    ends = np.flatnonzero(raw < 128)
    first = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    n, d = ends - first + 1, np.zeros(len(ends), np.uint64)
    for k in range(5):
        has = np.flatnonzero(n > k)
        d[has] |= (raw[first[has] + k] & 127).astype(np.uint64) << np.uint64(7 * k)
    bounds = np.searchsorted(ends, np.concatenate([[0], np.cumsum(row_bytes)]))
    total, counts = np.concatenate([[0], np.cumsum(d)]).astype(np.uint64), np.diff(bounds)
    return (total[1:] - np.repeat(total[bounds[:-1]], counts)) & np.uint64(0xFFFF_FFFF), counts


def level(counts):
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def _bits(keys, j, size):
    """Bit places of (key, j) in a slice of `size` bits."""
    salts = [np.uint64((j * 0x9E3779B97F4A7C15 + i * 0xD6E8FEB86659FD93) & 0xFFFF_FFFF_FFFF_FFFF) for i in range(1, PROBES + 1)]
    return [(mix(keys + salt) % np.uint64(size)).astype(np.int64) for salt in salts]


class Filter:
    """Slices of `size` bits, one a bucket; keys are 48-bit hashes."""

    def __init__(self, raw: np.ndarray, size: int, buckets: int):
        self.raw, self.size, self.buckets = raw, size, buckets

    def levels(self, keys, base=None):
        """The highest level reached by each 48-bit key, 0 where (key, 1) is missing; base: where its slice begins."""
        q, left = np.zeros(len(keys), np.uint8), np.arange(len(keys))
        for j in range(1, LEVELS + 1):
            if not len(left):
                break
            ok = np.ones(len(left), bool)
            for at in _bits(keys[left], j, self.size):
                at = at if base is None else at + base[left]
                ok &= (self.raw[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            left = left[ok]
            q[left] = j
        return q

    def counts(self, hashes):
        """Estimated counts: 0 where (key, 1) is missing, else the middle of the highest level reached."""
        return middle(self.levels(_six(hashes), B.bucket_of(hashes, self.buckets) * self.size))


def middle(levels):
    q = levels.astype(np.int64)
    return np.where(q > 0, (np.exp2(q) + np.exp2(q - 1.0) - 1) / 2, 0)


def slice_of(held, bits: int) -> np.ndarray:
    """A bucket's slice with all of the (48-bit keys, levels) held, at `bits` bits an insertion."""
    size = max(64, -(-sum(int(q.sum(dtype=np.int64)) for _, q in held) * bits // 64) * 64)
    marks = np.zeros(size, bool)
    for keys, q in held:
        for j in range(1, int(q.max(initial=0)) + 1):
            for at in _bits(keys[q >= j], j, size):
                marks[at] = True
    return np.packbits(marks, bitorder="little")


def buckets(df: DataFrame, text_col: str, order: int, bits: int, max_bytes: int, least: int) -> int:
    """As many buckets as the text needs. A text has at most (bytes + 2) / 2 tokens, and a level is at most its count."""
    seen = df.agg(F.sum(F.octet_length(text_col).cast("long")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    most = order * ((seen["b"] or 0) / 2 + seen["n"])
    return max(least, math.ceil(most * bits / 8 / max_bytes))


def score(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, weight: float = 0.7, bits: int = 10, max_bytes: int = 256 << 20, block_bytes: int | None = None,
    order: int = 2, discount: float = 0.0, spread: float = 0.8,
) -> DataFrame:
    """df with held_out, n_tokens, n_known, train_tokens, base_score and score."""
    cuts = B.cut_points(df, id_col, text_col, block_bytes)
    n = B.Buckets(buckets(df, text_col, order, bits, max_bytes, cuts.buckets), cuts.tasks)
    df = df.withColumn(HELD, F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0)

    blocked = B.dealt(df, id_col, cuts)

    def read(table):
        """The block's rows, its token hashes and offsets, and for each length from 2 the places where its n-grams end."""
        table = B.ordered(table, id_col, text_col)
        h, o = tokens(*column_bytes(table.column(text_col)))
        within = np.arange(len(h)) - np.repeat(o[:-1], np.diff(o))
        return table, h, o, [np.flatnonzero(within >= k - 1) for k in range(2, order + 1)]

    def distinct_of(table, h, o, places):
        """(keys, training counts, the key of each token) of the words, then of the longer n-grams, length by length; keys by count, so that equal counts pack to nothing."""
        train = np.repeat(~table.column(HELD).to_numpy(), np.diff(o))
        grams, every = h, []
        for at in places:
            grams = longer(grams, h)
            every.append(grams[at])
        inner = np.concatenate([train[at] for at in places]) if places else train[:0]
        for x, t in ((h, train), (np.concatenate(every) if every else h[:0], inner)):
            keys, which = np.unique(x, return_inverse=True)
            counts = np.bincount(which[t], minlength=len(keys))
            order_ = np.argsort(counts, kind="stable")
            place = np.empty(len(order_), np.int64)
            place[order_] = np.arange(len(order_))
            yield keys[order_], counts[order_], place[which]

    def send(table):
        """A row a bucket: the block's words (a), its longer n-grams (b), the counts of the words and then of the others (c)."""
        block = table.column(B.BLOCK)[0].as_py()
        (words, c, _), (pairs, g, _) = distinct_of(*read(table))
        to = [B.bucket_of(words, n), B.bucket_of(pairs, n)]
        (one, ones), (two, twos) = B.entry_index(words, to[0], n), B.entry_index(pairs, to[1], n)
        both = np.argsort(np.concatenate(to), kind="stable")
        used = np.flatnonzero(np.diff(ones + twos))
        small, at = shrunk(pairs[two] >> np.uint64(32), twos[:-1])
        cols = ((words[one].astype("<u8"), 8 * ones), (small, at[twos]), (np.concatenate([c, g])[both].astype("<u4"), 4 * (ones + twos)))
        return pa.table([pa.array(B.labels_of(n)[used]), pa.array(np.full(len(used), block, np.int32)), *[B._packed(x.view(np.uint8).reshape(-1), bounds, used) for x, bounds in cols]], schema=B.ENTRY_ARROW)

    def tally(table):
        """For each row sent, in its order: counts (a) and levels (b) of the words, levels (c) of the longer n-grams; and a row with the bucket's part of N and V."""
        bucket = B.number_of(table, n)
        (words, w), (grams, b), (raw, _) = (B.blob(table, k) for k in "abc")
        w, (grams, b) = w // 8, grown(grams, b)
        counts = np.frombuffer(bytes(raw), "<u4")
        of_word = np.arange(len(counts)) - np.repeat(np.cumsum(w + b) - w - b, w + b) < np.repeat(w, w + b)
        words, c, word_of = _summed(np.frombuffer(bytes(words), "<u8"), counts[of_word])
        grams, g, gram_of = _summed(grams | GRAM, counts[~of_word])
        raw = slice_of([(_six(words[c > 0]), level(c[c > 0])), (grams[g > 0], level(g[g > 0]))], bits)
        filter_ = Filter(raw, 8 * len(raw), 1)
        probed = lambda keys: np.concatenate([filter_.levels(keys[i : i + PROBED]) for i in range(0, max(1, len(keys)), PROBED)])
        ends = lambda lens, width: width * np.concatenate([[0], np.cumsum(lens)])
        packed = [B._packed(x.view(np.uint8), bounds, np.arange(len(table))) for x, bounds in ((c[word_of], ends(w, 8)), (probed(_six(words))[word_of], ends(w, 1)), (probed(grams)[gram_of], ends(b, 1)))]
        told = pa.table([table.column(B.BLOCK), pa.array(np.full(len(table), bucket, np.int32)), *packed, pa.nulls(len(table), pa.int64()), pa.nulls(len(table), pa.int64())], schema=_TALLY)
        return pa.concat_tables([told, pa.table([[None], [bucket], [None], [None], [None], [int(c.sum())], [int(np.count_nonzero(c))]], schema=_TALLY)])

    def heard(replies, column, kind, keys):
        """The answers in a column, put to the block's keys."""
        order, bounds = B.entry_index(keys, B.bucket_of(keys, n), n)
        got = np.zeros(len(keys), kind)
        for bucket, part in zip(replies.column("bucket").to_pylist(), replies.column(column).to_pylist()):
            got[order[bounds[bucket] : bounds[bucket + 1]]] = np.frombuffer(part, kind)
        return got

    folder = f"{shared_dir(df.sparkSession)}/lm_score-{uuid.uuid4().hex}"
    B.by_bucket(B.per_block(blocked, send, B.ENTRY), cuts, tally, TALLY).write.option("compression", "zstd").parquet(folder)
    told = df.sparkSession.read.schema(TALLY).parquet(folder)
    stats = told.where(F.col(B.BLOCK).isNull()).agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    tokens_all, distinct = stats["n"] or 0, stats["v"] or 0
    base = math.log10(tokens_all + 0.1 * (distinct + 1))

    out = extended(df.drop(HELD).schema, held_out="boolean", n_tokens="long", n_known="long", train_tokens="long", base_score="double", score="double")

    def finish(table, replies):
        if not len(table):
            return none_of(out)
        table, h, o, places = read(table)
        (words, _, which), (grams, _, gram_of) = distinct_of(table, h, o, places)
        exact = heard(replies, "a", np.dtype("<u8"), words).astype(np.float64)
        seen = middle(heard(replies, "b", np.dtype("u1"), words))[which]
        p = (seen + 0.1) / (tokens_all + 0.1 * (distinct + 1))
        longer_seen, start = middle(heard(replies, "c", np.dtype("u1"), grams)), 0
        for at in places:
            now = np.zeros(len(h))
            now[at] = longer_seen[gram_of[start : start + len(at)]]
            start += len(at)
            p[at] = _smoothed(now[at], seen[at - 1], p[at], weight, discount, spread)
            seen = now
        sums = lambda x: np.add.reduceat(x, o[:-1])  # noqa: E731  every document has its end token
        more = {
            "held_out": table.column(HELD), "n_tokens": pa.array(np.diff(o), pa.int64()), "n_known": pa.array(sums((exact > 0).astype(np.int64)[which]), pa.int64()), "train_tokens": pa.array(np.full(len(table), tokens_all), pa.int64()),
            "base_score": pa.array(sums(np.log10(exact + 0.1)[which]) - np.diff(o) * base), "score": pa.array(sums(np.log10(p))),
        }
        return with_columns(table.drop_columns([B.BLOCK, HELD]), **more)

    return B.with_answers(blocked, told.where(F.col(B.BLOCK).isNotNull()).select(B.ANSWER_ARROW.names), finish, out)


def _smoothed(c, context, shorter, weight, discount, spread):
    """Estimates from the counts of n-grams and of their contexts, and the estimates from shorter contexts."""
    context = np.maximum(context, c)
    if discount:
        some = np.maximum(context, 1)
        return np.where(context > 0, np.minimum(1, np.maximum(c - discount, 0) / some + discount * some ** (spread - 1) * shorter), shorter)
    return weight * np.where(c > 0, c / np.maximum(context, 1), 0) + (1 - weight) * shorter


def _summed(keys, counts):
    """The distinct keys, the sums of their counts, and the distinct key of each."""
    each, which = np.unique(keys, return_inverse=True)
    return each, np.bincount(which, weights=counts, minlength=len(each)).astype("<u8"), which


def query(spark, sf_dir: str) -> DataFrame:
    """op9: per document the exact unigram score and the model's score."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, order=ORDER, discount=DISCOUNT).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def base_query(spark, sf_dir: str) -> DataFrame:
    """The exact columns of op9, rounded: what SQL can express of it."""
    from .common import table

    got = score(table(spark, sf_dir, "documents").select("doc_id", "text"), order=1)
    return got.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


#: crc32 in SQL: one table look-up a byte, the bytes being digits of the id
BASE_ORACLE = r"""
WITH RECURSIVE bits AS (SELECT i AS n, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
       UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
look AS (SELECT list(c ORDER BY n) AS l FROM bits WHERE k = 8),
ids AS (SELECT DISTINCT doc_id, doc_id::VARCHAR AS s FROM documents),
crc AS (SELECT doc_id, s, 4294967295::BIGINT AS c, 1 AS i FROM ids
       UNION ALL SELECT doc_id, s, xor(c >> 8, l[(xor(c, ascii(s[i])::BIGINT) & 255) + 1]), i + 1 FROM crc, look WHERE i <= length(s)),
held AS (SELECT doc_id, xor(c, 4294967295) % 10 = 0 AS held_out FROM crc WHERE i = length(s) + 1),
d AS (SELECT doc_id, held_out, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') || [' '] AS w FROM documents JOIN held USING (doc_id)),
t AS (SELECT doc_id, held_out, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY word),
a AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(c.c)::BIGINT AS n_known, any_value(n) AS train_tokens,
       round(sum(log10((coalesce(c.c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 3) AS base_score
FROM t LEFT JOIN c USING (word), a GROUP BY doc_id
"""
