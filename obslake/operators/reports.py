"""Reports: freshness, latest states, rollups by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def freshness(records: DataFrame, now) -> DataFrame:
    """(source_id, last_occurred, last_observed, age_seconds)."""
    return records.groupBy("source_id").agg(F.max("occurred_at").alias("last_occurred"), F.max("observed_at").alias("last_observed")).withColumn("age_seconds", F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last_observed"))


def latest(rows: DataFrame, keys: list[str], revision: str, tie: str) -> DataFrame:
    """The row of the highest revision of each key, then of the largest tie."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(revision, tie)).alias("_r")).select(*keys, "_r.*")


def rollup(records: DataFrame, first: str, last: str) -> DataFrame:
    """(day, target_id, name, severity, n, missing): counts by day, target, name and severity with subtotals by day and target, and a row for each day without records.

    A level that a subtotal covers is null.
    """
    r = records.select(F.to_date("occurred_at").alias("day"), "target_id", "name", "severity")
    n = r.groupingSets([["day", "target_id", "name", "severity"], ["day", "target_id"], ["day"], []], "day", "target_id", "name", "severity").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    days = records.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day"))
    none = days.join(r.select("day").distinct(), "day", "left_anti").select("day", *[F.lit(None).cast("string").alias(c) for c in ("target_id", "name", "severity")], F.lit(0).cast("long").alias("n"), F.lit(7).cast("long").alias("level"))
    return n.withColumn("missing", F.lit(False)).unionByName(none.withColumn("missing", F.lit(True)))


#: the levels of calendar_rollup, by the columns that are grouped
LEVELS = {"day/target/name": ("day", "week", "target_id", "name"), "day/target": ("day", "week", "target_id"), "day": ("day", "week"), "week/target/name": ("week", "target_id", "name"), "week/target": ("week", "target_id"), "week": ("week",), "all": ()}


def calendar_rollup(records: DataFrame, first: str, last: str) -> DataFrame:
    """(level, week, day, target_id, name, n, days, missing_days, missing) over each day and ISO week, named by its Monday, from first to last.

    The calendar is dense: each pair of target and name that the records have stands on each day, with 0 where nothing came, so
    that gaps show at each level. missing_days are the days of the group without a record of it; a group is missing where that is all.
    """
    r = records.select(F.to_date("occurred_at").alias("day"), "target_id", "name").where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    counts = r.groupBy("day", "target_id", "name").agg(F.count(F.lit(1)).alias("c"))
    nobody = records.sparkSession.range(1).select(*[F.lit(None).cast("string").alias(c) for c in ("target_id", "name")], F.lit(False).alias("real"))
    pairs = counts.select("target_id", "name").distinct().withColumn("real", F.lit(True)).unionByName(nobody)  # so that a day without any pair is there
    dense = pairs.withColumn("day", F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))))
    same = (F.col("g.day") == F.col("c.day")) & F.col("g.target_id").eqNullSafe(F.col("c.target_id")) & F.col("g.name").eqNullSafe(F.col("c.name")) & F.col("g.real")
    grid = dense.alias("g").join(counts.alias("c"), same, "left").select("g.day", F.to_date(F.date_trunc("week", "g.day")).alias("week"), "g.target_id", "g.name", "real", F.coalesce("c", F.lit(0)).alias("c"))
    cols = ["day", "week", "target_id", "name"]
    flags = {c: F.grouping(c) for c in cols}
    out = grid.groupingSets([list(v) for v in LEVELS.values()], *cols).agg(
        F.sum("c").alias("n"), F.countDistinct("day").alias("_days"), F.countDistinct(F.when(F.col("c") > 0, F.col("day"))).alias("_seen"), F.max("real").alias("_real"), *[f.alias(f"_g_{c}") for c, f in flags.items()])
    level = F.coalesce(*[F.when(sum(((F.col(f"_g_{c}") == (0 if c in v else 1)).cast("int") for c in cols), F.lit(0)) == 4, k) for k, v in LEVELS.items()])
    out = out.withColumn("level", level).where(F.col("_real") | (F.col("_g_target_id") == 1))
    return out.select("level", "week", "day", "target_id", "name", "n", F.col("_days").alias("days"), (F.col("_days") - F.col("_seen")).alias("missing_days"), (F.col("_seen") == 0).alias("missing"))
