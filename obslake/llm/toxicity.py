"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon (words and word beginnings of 4
to 6 bytes), the strongest and the summed weight of its entries, entries within
five words of a second-person word, rates of capitals, exclamation and question
marks, other punctuation and symbols, obfuscated letters (a digit or symbol
between letters), and the length.  Digits that stand for letters are read as such.

The lexicon is learned: entries whose labelled documents are toxic far more often
than the rest.  The labelled rows (crc32 of the id as text modulo `folds` not 0)
are thinned by a hash of the id to about `rows`, the bound of the fit, and split:
half for the lexicon, a third for the trees, the rest for the calibration.

Edge cases: null or blank text has all features 0 and gets the score those give;
null labels are not learned from; a document with several label rows counts as
toxic if one says so; without both classes the score is the share of toxic rows
(0 without rows); a null id counts as the text "" (held out); extra columns pass
through; a result column replaces an input column of its name; very long texts are
scored whole; equal texts, and so repeated rows, have equal scores; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from .common import checkpointed, extended, with_columns
from .language_id import held_out
from .text import ALNUM, BYTE_LOWER, Words, chunks, column_bytes, covered, span_hash

#: fixed values: second-person words of the languages at hand
SECOND_PERSON = "you your yours yourself u du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: fixed values: digits read as letters
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
PREFIXES = (4, 5, 6)
NEAR = 5

_VALUES = BYTE_LOWER.copy()
for _d, _l in LEET.items():
    _VALUES[ord(_d)] = BYTE_LOWER[ord(_l)]
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_SIGN = np.zeros(256, bool)
_SIGN[0x21:0x30] = _SIGN[0x3A:0x41] = _SIGN[0x5B:0x61] = _SIGN[0x7B:0x7F] = True
_HIDE = _SIGN.copy()
_HIDE[0x30:0x3A] = True
_HIDE[[ord(c) for c in "'-.,:;/&()\""]] = False
FEATURES = 13


def _keys(buf, offsets, kinds=ALNUM):
    """Words and, for each, its hash and the hashes of its beginnings (0 where it is no longer than that)."""
    words = Words(buf, offsets, kinds, _VALUES)
    heads = np.zeros((len(PREFIXES), len(words)), np.uint64)
    for a, b in chunks(offsets):
        lo, hi = offsets[a], offsets[b]
        w0, w1 = words.offsets[a], words.offsets[b]
        s, e = words.starts[w0:w1] - lo, words.ends[w0:w1] - lo
        for k, size in enumerate(PREFIXES):
            ok = np.flatnonzero(e - s > size)
            heads[k, w0 + ok] = span_hash(buf[lo:hi], s[ok], s[ok] + size, _VALUES) ^ np.uint64(size)
    return words, heads


def _hash_words(items):
    raw = " ".join(items).encode()
    return np.unique(Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, _VALUES).hashes)


class Lexicon:
    def __init__(self, keys, weights):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.keys >> np.uint64(48)).astype(np.int64)] = True
        self.you = _hash_words(SECOND_PERSON)

    def weigh(self, hashes):
        out = np.zeros(len(hashes))
        maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(48)).astype(np.int64)])
        if len(self.keys) and len(maybe):
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
            ok = self.keys[at] == hashes[maybe]
            out[maybe[ok]] = self.weights[at[ok]]
        return out

    def features(self, buf, off):
        words, heads = _keys(buf, off)
        o, n = words.offsets, np.maximum(words.counts, 1)
        whole = self.weigh(words.hashes)
        head = np.max([self.weigh(h) for h in heads], axis=0) if len(words) else whole
        best = np.maximum(whole, head)
        you = np.isin(words.hashes, self.you)
        near = covered(you, NEAR + 1) | covered(you[::-1], NEAR + 1)[::-1]
        per_word = lambda x: _sums(x, o)
        size = np.maximum(np.diff(off), 1)
        per_byte = lambda x: _sums(x, off) / size
        letters, signs = _LETTER[buf], _SIGN[buf]
        hidden = np.zeros(len(buf), bool)
        if len(buf) > 2:
            hidden[1:-1] = _HIDE[buf[1:-1]] & letters[:-2] & letters[2:]
        top = np.zeros(len(n))
        full = words.counts > 0
        if full.any():
            top[full] = np.maximum.reduceat(best, o[:-1][full])
        hits = per_word(best > 0)
        return np.stack([
            per_word(whole > 0) / n, per_word(head > 0) / n, np.log1p(hits), top, per_word(best) / n, per_word((best > 0) & near) / n,
            _sums(_UPPER[buf], off) / np.maximum(_sums(letters, off), 1), per_byte(buf == 0x21), per_byte(buf == 0x3F), per_byte(signs), per_byte(hidden), np.log1p(words.counts), per_word(you) / n,
        ], axis=1)


def _sums(x, offsets):
    total = np.zeros(len(x) + 1)
    np.cumsum(x, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def with_features(df: DataFrame, lexicon: Lexicon, text_col: str, out_col: str) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(lexicon)  # `entries` keys at most

    def work(batches):
        for batch in batches:
            for a in range(0, len(batch), 512):
                part = batch.slice(a, 512)
                x = sent.value.features(*column_bytes(part.column(text_col)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * FEATURES), pa.array(x.reshape(-1)))
                yield with_columns(part, **{out_col: lists})

    return df.mapInArrow(work, extended(df.schema, **{out_col: T.ArrayType(T.DoubleType())}))


def _learn_lexicon(rows: DataFrame, entries: int, support: int) -> Lexicon:
    """The entries (by weight) that at least `support` toxic documents have; weight: log odds against the other documents."""

    def count(batches):
        for batch in batches:
            words, heads = _keys(*column_bytes(batch.column("__ob_text")))
            doc = np.repeat(np.arange(len(batch)), words.counts)
            toxic = batch.column("__ob_toxic").to_numpy(zero_copy_only=False)
            pairs = np.concatenate([np.stack([h[h > 0], doc[h > 0].astype(np.uint64)], axis=1) for h in (words.hashes, *heads)])
            pairs = np.unique(pairs, axis=0) if len(pairs) else pairs
            keys, back, n = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
            bad = np.bincount(back, weights=toxic[pairs[:, 1].astype(np.int64)], minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64()), pa.array(bad.astype(np.int64))], names=["k", "n", "bad"])

    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("__ob_toxic").alias("bad")).first()
    clean = max(total["n"] - total["bad"], 1)
    found = rows.select("__ob_text", "__ob_toxic").mapInArrow(count, "k long, n long, bad long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    weight = F.log((F.col("bad") + 0.5) / (total["bad"] + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (clean + 1))
    top = found.where(F.col("bad") >= support).withColumn("w", weight).where("w > 2").orderBy(F.desc("w"), F.desc("bad"), "k").limit(entries).collect()
    return Lexicon(np.array([r["k"] for r in top], np.int64).view(np.uint64), np.array([r["w"] for r in top], float))


class Model:
    def __init__(self, lexicon, trees, steps, share):
        self.lexicon, self.trees, self.steps, self.share = lexicon, trees, steps, share


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 5, rows: int = 12_000, entries: int = 2_000, support: int = 5) -> Model:
    spark = df.sparkSession
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, folds)).groupBy(F.col(id_col).alias("__ob_id")).agg(F.max(label_col).cast("int").alias("__ob_toxic"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.col("__ob_id").cast("string")), F.lit(1_000_003)) / 1_000_003
    chosen = known.withColumn("__ob_draw", draw).where(F.col("__ob_draw") < rows / max(n, 1)).withColumn("__ob_part", F.pmod(F.xxhash64(F.col("__ob_id").cast("string"), F.lit(1)), F.lit(6)))
    texts = df.select(F.col(id_col).alias("__ob_id"), F.col(text_col).alias("__ob_text"))
    sample = checkpointed(texts.join(F.broadcast(chosen.drop("__ob_draw")), "__ob_id").repartition(8, "__ob_id"))  # about `rows` rows
    share = sample.agg(F.avg("__ob_toxic").alias("s")).first()["s"] or 0.0
    if not 0 < share < 1:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, None, float(share))
    lexicon = _learn_lexicon(sample.where("__ob_part < 3"), entries, support)
    ready = with_features(sample.select("__ob_part", "__ob_text", "__ob_toxic"), lexicon, "__ob_text", "f")
    ready = checkpointed(ready.select("__ob_part", F.col("__ob_toxic").cast("double").alias("label"), array_to_vector("f").alias("features")).coalesce(4))
    train = ready.where("__ob_part BETWEEN 3 AND 4")
    if train.agg(F.countDistinct("label")).first()[0] < 2:
        train = ready
    trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.2, maxBins=32, seed=7).fit(train)
    rest = ready.where("__ob_part = 5")
    if rest.agg(F.countDistinct("label")).first()[0] < 2:
        rest = train
    raw = trees.transform(rest).select("label", vector_to_array("probability")[1].alias("p"))
    steps = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="score").fit(raw)
    return Model(lexicon, trees, steps, share)


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 from 0.5 on)."""
    keep = [c for c in df.columns if c not in ("score", "predicted")]
    if model.trees is None:
        out = df.select(*keep, F.lit(model.share).alias("score"))
    else:
        f, v = "__ob_features", "__ob_vector"
        out = with_features(df, model.lexicon, text_col, f).withColumn(v, array_to_vector(f)).drop(f)
        trees = model.trees.copy()
        trees = trees.setFeaturesCol(v).setRawPredictionCol("__ob_raw").setProbabilityCol("__ob_probability").setPredictionCol("__ob_prediction")
        out = trees.transform(out.select(*keep, v)).withColumn("__ob_p", vector_to_array("__ob_probability")[1])
        out = model.steps.copy().setFeaturesCol("__ob_p").setPredictionCol("__ob_score").transform(out)
        out = out.select(*keep, F.least(F.greatest("__ob_score", F.lit(0.0)), F.lit(1.0)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: per document the toxicity score."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs.withColumn("held_out", held_out("doc_id", 5)), model).select("doc_id", "held_out", "score", "predicted")
