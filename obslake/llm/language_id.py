"""Language identification with string kernels, Nystroem landmarks and kernel ridge regression.

Method.  A text is the set of its byte n-grams of 1 to 4 bytes (A-Z lower-cased,
runs of other ASCII non-letters as one space), hashed to `dims` places: a blended
spectrum of presences.  The kernel of two texts is the cosine of their sets.
Landmark texts L give the features K(x, L) K(L, L)^-1/2; one ridge regression a
language is fitted on targets +1 and -1.  All of it folds into one matrix, so a
batch is scored by two matrix products.

The fit uses about `per_language` labelled texts of each language (texts with the
lowest hashes of their ids, a documented bound; whole texts) and at most
`most_languages` of them (more are an error), and only rows whose
crc32 of the id (as text) modulo `folds` isn't 0.  Prediction reads the text only.

Edge cases: null text, text without a letter, or nothing to learn from gives `und`
with score 0; a null id counts as the text "" (crc32 0: held out); rows with null
lang are not learned from; with one language, that is predicted; ties go to the
language that sorts first; extra columns pass through; a result column replaces an
input column of its name; very long texts are read whole (of `dims` places, 20,000
words fill about a sixth); equal texts, and so repeated rows, are predicted alike; an
empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import extended, release, with_columns
from .text import chunks, column_bytes

GRAMS = (1, 2, 3, 4)
#: rows of the sample that the fit unfolds at a time
BLOCK = 256
LETTER = re.compile(r"[^\W\d_]")
_CLASS = np.full(256, 0x20, np.uint8)
_CLASS[0x61:0x7B] = np.arange(0x61, 0x7B)
_CLASS[0x41:0x5B] = np.arange(0x61, 0x7B)
_CLASS[0x80:] = np.arange(0x80, 0x100)


def presence(buf, offsets, dims: int) -> np.ndarray:
    """Rows of 0 and 1: which hashed n-grams each text has."""
    n = len(offsets) - 1
    marks = np.zeros((n, dims), bool)
    flat = marks.reshape(-1)
    for a, b in chunks(offsets, 1 << 19):
        lo, hi = offsets[a], offsets[b]
        x = _CLASS[buf[lo:hi]].astype(np.uint32)
        row = np.repeat(np.arange(a, b), np.diff(offsets[a : b + 1]))
        h = np.zeros(len(x), np.uint32)
        for g in GRAMS:
            if len(x) < g:
                break
            h = h[: len(x) - g + 1] * np.uint32(0x01000193) + x[g - 1 :] + np.uint32(g)
            same = row[: len(h)] == row[g - 1 :]
            at = ((h * np.uint32(0x9E3779B1)) >> np.uint32(8)) % np.uint32(dims)
            flat[row[: len(h)][same] * dims + at[same]] = True
    return marks


def _features(marks):
    x = marks.astype(np.float32)
    size = np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
    return x / size


class Classifier:
    """Languages, landmarks and weights; fit() works on a bounded sample."""

    def __init__(self, langs, landmarks, weights, bias, dims):
        self.langs, self.landmarks, self.weights, self.bias, self.dims = langs, landmarks, weights, bias, dims

    @classmethod
    def fit(cls, packed, labels, landmarks: int, ridge: float):
        """packed: eight marks a byte. Only the landmarks and a block of the sample at a time are unfolded, so that the driver holds little."""
        langs = sorted(set(labels))
        unfolded = lambda rows: _features(np.unpackbits(rows, axis=1))
        y = np.where(np.array(labels)[:, None] == np.array(langs)[None, :], 1.0, -1.0)
        # landmarks: in turn from every language
        turn: dict[str, int] = {}
        turns = [turn[v] for v in labels if not turn.update({v: turn.get(v, 0) + 1})]
        chosen = unfolded(packed[np.argsort(turns, kind="stable")[:landmarks]])
        values, vectors = np.linalg.eigh((chosen @ chosen.T).astype(np.float64))
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.concatenate([(unfolded(packed[a : a + BLOCK]) @ chosen.T).astype(np.float64) for a in range(0, len(packed), BLOCK)]) @ root
        share = (y > 0).mean(axis=0)
        w = (y > 0) @ (1 / np.maximum(share, 1e-9)) / len(langs)  # languages weigh alike
        level = (y * w[:, None]).sum(axis=0) / w.sum()
        mean = (phi * w[:, None]).sum(axis=0) / w.sum()
        p = phi - mean
        solved = np.linalg.solve((p * w[:, None]).T @ p + ridge * np.eye(p.shape[1]), (p * w[:, None]).T @ (y - level))
        return cls(langs, chosen.astype(np.float32), (root @ solved).astype(np.float32), level - mean @ solved, 8 * packed.shape[1])

    def predict(self, buf, offsets):
        """Index of the language and a score from 0 to 1 for each text."""
        best, score = [], []
        for a in range(0, len(offsets) - 1, 256):
            x = _features(presence(buf, offsets[a : a + 257], self.dims))
            margin = (x @ self.landmarks.T) @ self.weights + self.bias
            e = np.exp(3 * (margin - margin.max(axis=1, keepdims=True)))
            best.append(margin.argmax(axis=1))
            score.append(e.max(axis=1) / e.sum(axis=1))
        return np.concatenate(best), np.concatenate(score)


def held_out(id_col: str, folds: int):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == 0


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", folds: int = 5, per_language: int = 400, landmarks: int = 256, ridge: float = 0.1, dims: int = 1 << 15, most_languages: int = 500) -> Classifier | None:
    """A classifier from about per_language texts of each language; None without any."""
    rows = df.where(~held_out(id_col, folds) & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[label_col]: r["count"] for r in rows.groupBy(label_col).count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for k, n in sorted(sizes.items()) for v in (k, per_language / n)])
    low = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) < share[F.col(label_col)] * (1 << 20)

    def featurize(batches):
        for batch in batches:
            marks = presence(*column_bytes(batch.column("t")), dims)
            yield pa.RecordBatch.from_arrays([batch.column("l"), batch.column("i"), pa.array([m.tobytes() for m in np.packbits(marks, axis=1)], pa.binary())], names=["l", "i", "m"])

    got = rows.where(low).select(F.col(label_col).alias("l"), F.xxhash64(F.col(id_col).cast("string")).alias("i"), F.col(text_col).alias("t")).mapInArrow(featurize, "l string, i long, m binary").collect()
    got = sorted(got, key=lambda r: (r["i"], r["l"], r["m"]))
    if not got:
        return None
    packed = np.frombuffer(b"".join(bytes(r["m"]) for r in got), np.uint8).reshape(len(got), -1)
    return Classifier.fit(packed, [r["l"] for r in got], landmarks, ridge)


def identify(df: DataFrame, model: Classifier | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """df with the predicted language and its score."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # landmarks x dims at most, whatever the input

    def work(batches):
        m = sent.value
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                names, score = ["und"] * len(part), np.zeros(len(part))
                if m is not None:
                    best, found = m.predict(*column_bytes(part.column(text_col)))
                    letters = [bool(t) and LETTER.search(t) is not None for t in part.column(text_col).to_pylist()]
                    names = [m.langs[k] if ok else "und" for k, ok in zip(best.tolist(), letters)]
                    score = np.where(letters, found, 0.0).astype(np.float64)
                yield with_columns(part, **{pred_col: pa.array(names, pa.string()), score_col: pa.array(score, pa.float64())})
        release()

    return df.mapInArrow(work, extended(df.schema, **{pred_col: "string", score_col: "double"}))


def query(spark, sf_dir: str) -> DataFrame:
    """op6: per document the predicted language."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    return identify(docs.select("doc_id", "text", held_out("doc_id", 5).alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
