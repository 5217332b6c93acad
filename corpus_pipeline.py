"""A cleaning pipeline over `documents`, built from the training-data operators.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it
kept; run() writes each stage's result as Parquet in the shared folder and reads
it again.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from obslake.llm import decontaminate, jaccard_join, language_id, piece_bpe, substring_dedup
from obslake.llm.common import checkpointed, shared_dir, table

#: a language is only guessed under this score
LEAST_SCORE = 0.3
#: near duplicates share 80 % of their shingles of five words; op1's query has a contract of its own
NEAR_WORDS, NEAR_PERCENT = 5, 80
NODE = "__ob_node"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; `und` and mere guesses go."""
    pred, score = "__ob_pred", "__ob_score"
    out = language_id.identify(docs, language_id.fit(docs), pred_col=pred, score_col=score)
    return out.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def row_nodes(docs: DataFrame) -> tuple[Column, DataFrame]:
    """A long for each distinct row, whatever its id, and the table (node, id, digest) of them.

    The node is a hash of the row; the table shows whether two rows have one, and then another hash is taken.
    """
    row = [c for name in docs.columns for c in (F.col(name), F.col(name).isNull())]
    digest = F.sha2(F.to_json(F.struct(*docs.columns)), 256)
    for salt in range(8):
        node = F.xxhash64(F.lit(salt), *row)
        rows = checkpointed(docs.select(node.alias(NODE), F.col("doc_id").alias("id"), digest.alias("digest")).distinct())
        if rows.groupBy(NODE).count().where("count > 1").isEmpty():
            return node, rows
    raise RuntimeError("rows without a hash of their own")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of the least id, then digest, of each group of near duplicates. Rows of one id or of none are near duplicates by their texts only; one of fully equal rows stays."""
    node, rows = row_nodes(docs)
    keyed = docs.withColumn(NODE, node)
    found = jaccard_join.near_duplicates(keyed, NODE, shingle=NEAR_WORDS, percent=NEAR_PERCENT).select(NODE, "component_id").distinct()
    first = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), "digest", F.col(NODE))
    keep = found.join(rows, NODE).groupBy("component_id").agg(F.min(first).alias("first")).select(F.col(f"first.{NODE}").alias(NODE))
    return keyed.join(keep, NODE, "left_semi").dropDuplicates([NODE]).select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 20 words and more that stand earlier in the corpus; what is left empty goes."""
    out = substring_dedup.dedup(docs.withColumn("__ob_chars", F.col("n_chars")))
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("__ob_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", chars).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by benchmark items, less the few words of them that a benchmark window hits."""
    out = decontaminate.decontaminate(docs.withColumn("__ob_chars", F.col("n_chars")), table(spark, sf_dir, "benchmark")).where(~F.col("contaminated"))
    chars = F.when(F.col("n_hit") > 0, F.char_length("cleaned")).otherwise(F.col("__ob_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", chars).withColumn("text", F.col("cleaned")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    out = piece_bpe.tokenized(docs, piece_bpe.default_path())
    return out.select("doc_id", "lang", "source", "n_tokens", "ids", F.col("decoded").eqNullSafe(F.coalesce("text", F.lit(""))).alias("round_trip"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode),
]
#: language identification is a fitted classifier, which SQL does not express; the stages are tested one by one
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, base = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/corpus_pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{k}_{name}")
            docs = spark.read.parquet(f"{base}/{k}_{name}")
    return docs
