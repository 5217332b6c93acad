"""Row numbers by ranges and prefix sums against a plain count."""

import random

from pyspark.sql import functions as F

from obslake.operators.numbering import numbered
from obslake.sources import segments as S


def test_numbers_of_groups(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(3000)]
    want = {}
    for g, i in sorted(rows, key=lambda x: -x[1]):
        want[i] = 1 + sum(1 for h, j in rows if h == g and j > i)
    got = numbered(spark.createDataFrame(rows, "g string, i int").repartition(7), ["g"], [F.desc("i")])
    assert {x["i"]: x["n"] for x in got.collect()} == want
    assert [x["n"] for x in numbered(spark.createDataFrame(rows, "g string, i int"), [], ["i"]).orderBy("i").collect()] == list(range(1, 3001))
    assert numbered(spark.createDataFrame([], "g string, i int"), ["g"], ["i"]).count() == 0


def test_a_hot_group_spans_many_tasks(spark):
    """A source's day goes over several range partitions, and no plan node windows over it."""
    rows = spark.range(20_000).select(
        F.lit("s").alias("source_id"), F.lit("2024-01-01").alias("day"), F.lit("target").alias("scope"), F.lit("t").alias("target_id"), F.lit("internal").alias("privacy_class"), F.lit("event").alias("record_type"), F.col("id").alias("record_id"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = S.batched(rows, ["record_id"], 100).cache()
        assert got.groupBy("chunk").agg(F.min("sequence").alias("a"), F.max("sequence").alias("z")).where("a <> 1 OR z <> 100").isEmpty()
        assert got.where(F.col("chunk") * 100 + F.col("sequence") - 1 != F.col("record_id")).isEmpty()
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
