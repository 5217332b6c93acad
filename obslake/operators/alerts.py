"""Hysteresis alerts over samples, and notification intents.

samples(rule_id, rule_version, target, sampled_at, record_id NULL, outcome); rules
give failures to fire, successes to resolve, and a cooldown in seconds.  Without a
cooldown the transitions are window functions; with one they are a scan over ranges
of samples (see cooldown). fold is the same on one key, as streams need it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from . import cooldown
from ..functions.identity import alert_key, intent_id, transition_id
from ..functions.values import configuration

KEY, EMITTED = cooldown.KEY, cooldown.EMITTED
SUMMARIES = {"firing": "Alert is firing", "resolved": "Alert is resolved"}


def sampled(rules: DataFrame, records: DataFrame) -> DataFrame:
    """Samples of each rule's collector; a rule without samples has no rows. rules is configuration: a small table."""
    return records.join(configuration(rules), "collector")


def with_streaks(samples: DataFrame) -> DataFrame:
    """samples with `revision` (one a sample) and `streak`, how many times the outcome has come in a row."""
    order = W.partitionBy(*KEY).orderBy("sampled_at", "record_id")
    out = samples.withColumn("revision", F.row_number().over(order).cast("long"))
    out = out.withColumn("_g", F.col("revision") - F.row_number().over(W.partitionBy(*KEY, "outcome").orderBy("sampled_at", "record_id")))
    return out.withColumn("streak", F.row_number().over(W.partitionBy(*KEY, "outcome", "_g").orderBy("sampled_at", "record_id"))).drop("_g")


def transitions(samples: DataFrame) -> DataFrame:
    """State changes without a cooldown. samples also has consecutive_failures and consecutive_successes."""
    s = with_streaks(samples)
    signal = F.when(F.col("record_id").isNull(), None).when((F.col("outcome") == "failure") & (F.col("streak") >= F.col("consecutive_failures")), "firing").when((F.col("outcome") == "success") & (F.col("streak") >= F.col("consecutive_successes")), "resolved")
    order = W.partitionBy(*KEY).orderBy("revision")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("state", signal).withColumns({"_prev": F.last("state", ignorenulls=True).over(before), "_seen": F.coalesce(F.max(F.col("state") == "firing").over(before), F.lit(False))})
    changed = F.col("state").isNotNull() & (F.col("_seen") | (F.col("state") == "firing")) & (~F.col("_seen") | (F.col("state") != F.col("_prev")))
    return s.where(changed).select(*KEY, "sampled_at", "record_id", F.when(F.col("_seen"), F.col("_prev")).otherwise("inactive").alias("previous_state"), "state", "revision")


def fold(state: dict | None, samples: Iterator[tuple], failures: int, successes: int, pause: float | int):
    """Folds (time, record_id, outcome) in order into the state; yields (time, record_id, previous, state, revision).

    The state is {state, fails, wins, until, revision}; a fire sets until, and no fire comes before it. pause: seconds as a float,
    or in the unit of times that are whole numbers.
    """
    pause = pd.Timedelta(seconds=pause) if isinstance(pause, float) else pause
    now = state or {"state": "inactive", "fails": 0, "wins": 0, "until": None, "revision": 0}
    out = []
    for at, record, outcome in samples:
        failed = outcome == "failure"
        now["revision"] += 1
        now["fails"], now["wins"] = (now["fails"] + 1, 0) if failed else (0, now["wins"] + 1)
        if record is None:
            continue
        if failed and now["state"] != "firing" and now["fails"] >= failures and (now["until"] is None or at >= now["until"]):
            out.append((at, record, now["state"], "firing", now["revision"]))
            now["state"], now["until"] = "firing", at + pause
        elif not failed and now["state"] == "firing" and now["wins"] >= successes:
            out.append((at, record, "firing", "resolved", now["revision"]))
            now["state"] = "resolved"
    return now, out


def transitions_with_cooldown(samples: DataFrame) -> DataFrame:
    """State changes with a cooldown, over ranges of samples: see cooldown."""
    return cooldown.transitions(samples)


def late_guard(samples: DataFrame, arrival: str) -> DataFrame:
    """samples with `late`: an older one than a sample that had arrived; kept as a record, not folded."""
    seen = F.max("sampled_at").over(W.partitionBy(*KEY).orderBy(arrival, "record_id").rowsBetween(W.unboundedPreceding, -1))
    return samples.withColumn("late", F.coalesce(F.col("sampled_at") < seen, F.lit(False)))


def alert_records(changes: DataFrame, collector: Column | None = None) -> DataFrame:
    """Alert rows of transitions: key and transition id, fixed summary, severity, one year to live. The collector is part of the key: a column of changes, or given."""
    if collector is None:
        if "collector" not in changes.columns:
            raise ValueError("the alert key needs the collector")
        collector = F.col("collector")
    out = changes.withColumn("alert_key", alert_key(F.col("rule_id"), F.col("rule_version"), collector, F.col("target")))
    seen = {"kind": F.lit("alert.sample"), "parts": {"sampled_at": F.date_format("sampled_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")}}
    summary = F.create_map(*[F.lit(x) for kv in SUMMARIES.items() for x in kv])
    return out.withColumns({
        "transition_id": transition_id(F.col("alert_key"), F.col("previous_state"), F.col("state"), seen), "summary": summary[F.col("state")], "severity": F.when(F.col("state") == "firing", "error").otherwise("info"),
        "evidence_ids": F.array("record_id"), "expires_at": F.col("sampled_at") + F.expr("INTERVAL 365 DAY"),
    })


def intents(alerts: DataFrame, channels: DataFrame) -> DataFrame:
    """One intent for each alert and each enabled channel that allows its class. channels is configuration: a small table."""
    on = F.col("enabled") & F.array_contains("allowed_classifications", F.col("privacy_class"))
    return alerts.join(configuration(channels), on).select(
        intent_id(F.col("transition_id"), F.col("channel_id")).alias("intent_id"), "alert_key", "transition_id", "channel_id", *[c for c in ("channel_type",) if c in channels.columns], "severity", "summary", "evidence_ids",
        *[c for c in ("expires_at",) if c in alerts.columns],
    )


def evidence(alerts: DataFrame, records: DataFrame) -> DataFrame:
    """Alerts with the records they cite."""
    return alerts.select("transition_id", F.explode("evidence_ids").alias("record_id")).join(records, "record_id")


def threshold_samples(records: DataFrame, value: Column, limit: float) -> DataFrame:
    """Latency samples: over the limit is a failure."""
    return records.withColumn("outcome", F.when(value > limit, "failure").otherwise("success"))


def staleness(records: DataFrame, keys: list[str], at: str, now, limit_seconds: int) -> DataFrame:
    """A sample a source: a failure where its last record is older than the limit at `now`."""
    age = F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last"))
    return records.groupBy(*keys).agg(F.max(at).alias("last")).withColumn("outcome", F.when(age > limit_seconds, "failure").otherwise("success"))
