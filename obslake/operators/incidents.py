"""Incidents: sessions of a rule group's alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

#: fixed values: severities in their order
ORDER = ("debug", "info", "warning", "error", "critical")


def severity_rank(c):
    return F.array_position(F.array(*[F.lit(s) for s in ORDER]), c)


def sessions(alerts: DataFrame, horizon_seconds: int, keys: tuple = ("group_id", "target")) -> DataFrame:
    """alerts(keys, at, severity, alert_id) with `incident`: a gap over the horizon opens the next."""
    w = W.partitionBy(*keys).orderBy("at", "alert_id")
    at = F.col("at").cast("timestamp")
    gap = F.unix_micros(at) - F.unix_micros(F.lag(at).over(w))
    return alerts.withColumn("_new", F.coalesce((gap > horizon_seconds * 1_000_000).cast("int"), F.lit(1))).withColumn("incident", F.sum("_new").over(w)).drop("_new")


def incidents(alerts: DataFrame, horizon_seconds: int, quiet_seconds: int, now, keys: tuple = ("group_id", "target")) -> DataFrame:
    """(keys, incident, opened_at, last_at, alerts, severity, state, reopened).

    Quiet for less than the window: open; for longer: mitigated, and for twice as long resolved. An incident that
    begins after an earlier one of its group was resolved counts as reopened.
    """
    s = sessions(alerts, horizon_seconds, keys)
    per = s.groupBy(*keys, "incident").agg(F.min(F.col("at").cast("timestamp")).alias("opened_at"), F.max(F.col("at").cast("timestamp")).alias("last_at"), F.count(F.lit(1)).alias("alerts"), F.max(severity_rank(F.col("severity"))).alias("_rank"))
    w = W.partitionBy(*keys).orderBy("incident")
    until = F.coalesce(F.lead("opened_at").over(w), F.lit(now).cast("timestamp"))
    quiet = F.unix_micros(until) - F.unix_micros("last_at")
    state = F.when(quiet <= quiet_seconds * 1_000_000, "open").when(quiet <= 2 * quiet_seconds * 1_000_000, "mitigated").otherwise("resolved")
    per = per.withColumn("state", state)
    return per.withColumn("reopened", F.coalesce(F.lag("state").over(w) != "open", F.lit(False))).withColumn("severity", F.element_at(F.array(*[F.lit(x) for x in ORDER]), F.col("_rank").cast("int"))).drop("_rank")
