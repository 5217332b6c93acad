"""Metrics: aggregates that respect what a series means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def deltas(rows: DataFrame, keys: list[str], at: list[str], value: str) -> DataFrame:
    """rows of a cumulative counter with `delta`; a fall is a reset, the first value counts from 0."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(*at))
    step = F.col(value) - F.coalesce(before, F.lit(0))
    return rows.withColumn("delta", F.when(step < 0, F.col(value)).otherwise(step))


def without_overlaps(rows: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """Windows that start at or after the end of all before them."""
    w = W.partitionBy(*keys).orderBy(start, end, tie).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max(end).over(w)).where(F.col("_m").isNull() | (F.col(start) >= F.col("_m"))).drop("_m")


def aggregate(rows: DataFrame) -> DataFrame:
    """(target_id, name, metric_semantics, n, total, average, last) of rows(target_id, name, metric_semantics, occurred_at, window_start, window_end, value, record_key).

    Gauges have an average and a last value, delta counters and cumulative ones (by their deltas) a total, window
    totals the sum of windows that don't overlap.
    """
    series, m = ["target_id", "name", "metric_semantics"], F.col("metric_semantics")
    gauges = rows.where(m == "gauge").withColumn("_v", F.col("value"))
    counters = rows.where(m == "counter_delta").withColumn("_v", F.col("value"))
    cumulative = deltas(rows.where(m == "cumulative_counter"), series, ["occurred_at", "record_key"], "value").withColumnRenamed("delta", "_v")
    windows = without_overlaps(rows.where(m == "window_total"), series, "window_start", "window_end", "record_key").withColumn("_v", F.col("value"))
    every = gauges.unionByName(counters).unionByName(cumulative).unionByName(windows)
    gauge = m == "gauge"
    return every.groupBy(*series).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(~gauge, F.col("_v"))).alias("total"), F.avg(F.when(gauge, F.col("_v"))).alias("average"), F.max_by(F.when(gauge, F.col("_v")), F.struct("occurred_at", "record_key")).alias("last"))
