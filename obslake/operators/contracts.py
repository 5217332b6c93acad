"""Record contracts: each check adds codes, never the offending value.

check(df, rules) returns df with `errors ARRAY<STRING>` and `accepted`.  A rule is a
condition that must hold; null counts as not holding, so a rule over an optional
field says so itself.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.values import configuration, is_canonical_time

MACHINE_ID = r"^[a-z][a-z0-9_-]{0,63}$"
MACHINE_NAME = r"^(?=.{1,128}$)[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*$"
DIMENSION_KEY = r"^(?=.{1,128}$)[a-z][a-z0-9_.-]*$"
SHA256_HEX = "^[0-9a-f]{64}$"
REDACTION_VERSION = r"^r[1-9][0-9]*-e[1-9][0-9]*$"
#: fixed values: the vocabularies of the record model
SEVERITIES = ("debug", "info", "warning", "error", "critical")
TRUST_LEVELS = ("untrusted", "authenticated", "verified")
PRIVACY_CLASSES = ("public", "internal", "sensitive", "restricted")
RUN_STATUSES = ("success", "failure", "cancelled", "timeout", "partial")
SPAN_STATUSES = ("ok", "error", "cancelled")
METRIC_SEMANTICS = ("gauge", "counter_delta", "window_total", "cumulative_counter")
CHANNEL_TYPES = ("telegram", "github_issues")
SIGNAL_CLASSES = ("canary", "error", "deploy", "workflow", "metric", "agent_summary", "validation")
ALERT_EDGES = (("inactive", "firing"), ("firing", "resolved"), ("resolved", "firing"))
INCIDENT_EDGES = ((None, "opened", "open"), ("open", "mitigated", "mitigated"), ("mitigated", "resolved", "resolved"), ("mitigated", "reopened", "open"), ("resolved", "reopened", "open"))
FEEDBACK_EDGES = (("open", "accepted"), ("open", "rejected"), ("accepted", "open"), ("accepted", "shipped"), ("accepted", "rejected"), ("shipped", "verified"), ("shipped", "regressed"), ("regressed", "accepted"), ("regressed", "rejected"), ("rejected", "open"), ("verified", "regressed"))
RECORD_BYTES, FREE_TEXT_BYTES, TITLE_BYTES = 262_144, 10_240, 255
PREDICATES = ("state_equals", "no_recurrence", "count_at_most", "ratio_at_least", "latency_at_most", "validation_passed")


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    codes = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in rules.items()]))
    return df.withColumn("errors", codes).withColumn("accepted", F.size("errors") == 0)


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, rejected codes): what is rejected keeps its codes alone."""
    return checked.where("accepted").drop("errors", "accepted"), checked.where("not accepted").select("errors")


def code_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.explode("errors").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def one_of(edges, *cols: Column) -> Column:
    """The columns' values are one of the edges (null matches None)."""
    out = F.lit(False)
    for edge in edges:
        same = F.lit(True)
        for c, v in zip(cols, edge):
            same = same & c.eqNullSafe(F.lit(v))
        out = out | same
    return out


def bounded_text(c: Column, most: int, single_line: bool = False) -> Column:
    """1 to `most` bytes without control characters (line break and tab allowed unless single_line)."""
    bad = r"[\p{Cc}]" if single_line else r"[\p{Cc}&&[^\n\t]]"
    return (F.octet_length(c) >= 1) & (F.octet_length(c) <= most) & ~c.rlike(bad)


def or_null(c: Column, ok: Column) -> Column:
    return c.isNull() | ok


def unique_ids(c: Column, least: int = 0, most: int = 100) -> Column:
    return (F.size(c) >= least) & (F.size(c) <= most) & (F.size(F.array_distinct(c)) == F.size(c))


def bounded_dimensions(c: Column) -> Column:
    """A MAP<STRING, STRUCT<t, b, i, d, s>> of typed scalars within the bounds."""
    keys = F.forall(F.map_keys(c), lambda k: k.rlike(DIMENSION_KEY))
    values = F.forall(F.map_values(c), lambda v: F.when(v["t"] == "s", F.octet_length(v["s"]) <= 2048).when(v["t"] == "d", ~F.isnan(v["d"]) & (F.abs(v["d"]) != float("inf"))).when(v["t"] == "i", v["i"].isNotNull()).when(v["t"] == "b", v["b"].isNotNull()).otherwise(F.lit(False)))
    return (F.size(F.map_keys(c)) <= 100) & keys & values


def bounded_counts(c: Column) -> Column:
    return F.forall(F.map_values(c), lambda v: v.isNotNull() & (v >= 0))


def envelope_rules() -> dict[str, Column]:
    col, target = F.col, F.col("target")
    made_by, run = col("collector"), col("collector_run_id")
    provenance = F.when(col("source")["producer"] == "collector", made_by.isNotNull() & run.isNotNull()).otherwise(made_by.isNull() & run.isNull())
    return {
        "OL_TYPE": col("record_type") == col("data")["type"], "OL_TARGET_SCOPE": (col("scope") == "target") == target.isNotNull(), "OL_PROVENANCE": provenance,
        "OL_RESTRICTED": col("privacy_class") != "restricted", "OL_INGESTED_ORDER": col("ingested_at") >= col("observed_at"), "OL_EXPIRY_ORDER": col("expires_at") > col("ingested_at"),
        "OL_TIME_PRECISION": is_canonical_time(col("occurred_at")) & is_canonical_time(col("observed_at")) & is_canonical_time(col("ingested_at")), "OL_SEVERITY": col("severity").isin(*SEVERITIES), "OL_TRUST": col("trust_level").isin(*TRUST_LEVELS),
        "OL_PRIVACY_CLASS": col("privacy_class").isin(*PRIVACY_CLASSES), "OL_NAME": col("name").rlike(MACHINE_NAME), "OL_REDACTION_VERSION": col("redaction_version").rlike(REDACTION_VERSION), "OL_RECORD_BYTES": F.octet_length(F.to_json(F.struct("*"))) <= RECORD_BYTES,
    }


def payload_coupling(**pairs: tuple[Column, Column]) -> dict[str, Column]:
    """Envelope and payload agree: (envelope, payload) of severity (alerts, intents, incidents, feedback items), target, trust, privacy and time (feedback)."""
    return {f"OL_{name.upper()}_MATCH": ours == theirs for name, (ours, theirs) in pairs.items()}


def event_rules(category: Column, status: Column, message: Column) -> dict[str, Column]:
    return {"OL_EVENT_CATEGORY": category.rlike(MACHINE_NAME), "OL_EVENT_STATUS": status.rlike(MACHINE_NAME), "OL_EVENT_MESSAGE": or_null(message, bounded_text(message, 10_240))}


def metric_rules(value: Column, semantics: Column, start: Column, end: Column) -> dict[str, Column]:
    window = start.isNotNull() & end.isNotNull() & (end > start)
    return {"OL_METRIC_VALUE": ~F.isnan(value) & (F.abs(value) != float("inf")), "OL_METRIC_SEMANTICS": semantics.isin(*METRIC_SEMANTICS), "OL_METRIC_WINDOW": F.when(semantics == "window_total", F.coalesce(window, F.lit(False))).otherwise(start.isNull() & end.isNull())}


def span_rules(duration: Column, status: Column) -> dict[str, Column]:
    return {"OL_SPAN_DURATION": duration >= 0, "OL_SPAN_STATUS": status.isin(*SPAN_STATUSES)}


def run_rules(started: Column, ended: Column, status: Column, duration_ms: Column | None = None, counts: Column | None = None) -> dict[str, Column]:
    """duration_ms must be there and not below 0; counts, a MAP<STRING, BIGINT>, has at most 100 machine keys and no count below 0."""
    rules = {"OL_RUN_ORDER": ended >= started, "OL_RUN_STATUS": status.isin(*RUN_STATUSES)}
    if duration_ms is not None:
        rules["OL_RUN_DURATION"] = duration_ms >= 0
    if counts is not None:
        rules["OL_RUN_COUNTS"] = counts.isNull() | ((F.size(F.map_keys(counts)) <= 100) & F.forall(F.map_keys(counts), lambda k: k.rlike(DIMENSION_KEY)) & bounded_counts(counts))
    return rules


def alert_rules(previous: Column, state: Column, evidence: Column) -> dict[str, Column]:
    return {"OL_ALERT_EDGE": one_of(ALERT_EDGES, previous, state), "OL_ALERT_EVIDENCE": unique_ids(evidence, 1)}


def intent_rules(channel_type: Column, evidence: Column) -> dict[str, Column]:
    return {"OL_INTENT_CHANNEL": channel_type.isin(*CHANNEL_TYPES), "OL_INTENT_EVIDENCE": unique_ids(evidence, 1)}


def incident_rules(previous: Column, transition: Column, state: Column, evidence: Column) -> dict[str, Column]:
    return {"OL_INCIDENT_EDGE": one_of(INCIDENT_EDGES, previous, transition, state), "OL_INCIDENT_EVIDENCE": unique_ids(evidence, 1)}


def threshold_ok(predicate: Column, threshold: Column, state: Column) -> Column:
    """A state only where it is compared with one, a count or milliseconds from 0, a ratio from 0 to 1, and none for the others."""
    whole = (threshold >= 0) & (threshold == F.floor(threshold))
    return (
        F.when(predicate == "state_equals", state.rlike(MACHINE_NAME) & threshold.isNull()).when(predicate == "ratio_at_least", threshold.between(0, 1) & state.isNull())
        .when(predicate.isin("count_at_most", "latency_at_most"), whole & state.isNull()).otherwise(threshold.isNull() & state.isNull())
    )


def verification_rules(
    predicate: Column, names: Column, window: Column, lateness: Column, least: Column, signal: Column | None = None, threshold: Column | None = None, state: Column | None = None, deadline: Column | None = None,
) -> dict[str, Column]:
    out = {
        "OL_SPEC_PREDICATE": predicate.isin(*PREDICATES), "OL_SPEC_NAMES": unique_ids(names, 1, 32) & F.forall(names, lambda n: n.rlike(MACHINE_NAME)), "OL_SPEC_WINDOW": window.between(1, 31_536_000),
        "OL_SPEC_LATENESS": lateness.between(0, 2_592_000), "OL_SPEC_MINIMUM": least.between(1, 1_000_000),
    }
    if signal is not None:
        out["OL_SPEC_SIGNAL"] = signal.isin(*SIGNAL_CLASSES)
    if threshold is not None:
        out["OL_SPEC_THRESHOLD"] = threshold_ok(predicate, threshold, F.lit(None).cast("string") if state is None else state)
    if deadline is not None:
        out["OL_SPEC_DEADLINE"] = deadline.isNotNull()
    return out


def item_rules(state: Column, revision: Column, priority: Column, actionability: Column, confidence: Column, evidence: Column, fingerprint: Column | None = None, title: Column | None = None, texts: tuple[Column, ...] = ()) -> dict[str, Column]:
    out = {
        "OL_ITEM_STATE": (state == "open") & (revision == 0), "OL_ITEM_PRIORITY": priority.isin("P0", "P1", "P2", "P3"), "OL_ITEM_ACTIONABILITY": actionability.isin("observe", "investigate", "agent_safe", "needs_approval"),
        "OL_ITEM_CONFIDENCE": confidence.isin("low", "medium", "high"), "OL_ITEM_EVIDENCE": unique_ids(evidence, 1),
    }
    if fingerprint is not None:
        out["OL_ITEM_FINGERPRINT"] = fingerprint.rlike(SHA256_HEX)
    if title is not None:
        out["OL_ITEM_TITLE"] = bounded_text(title, TITLE_BYTES, single_line=True)
    if texts:
        out["OL_ITEM_TEXT"] = functools.reduce(lambda a, b: a & b, [bounded_text(t, FREE_TEXT_BYTES) for t in texts])
    return out


def transition_rules(c: dict[str, Column]) -> dict[str, Column]:
    """c: from_state, to_state, revision, expected_revision, owner, clear_owner, change_reference, validation_evidence, actor_type, evidence."""
    to, verdict = c["to_state"], c["to_state"].isin("verified", "regressed")
    return {
        "OL_TRANSITION_EDGE": one_of(FEEDBACK_EDGES, c["from_state"], to), "OL_TRANSITION_REVISION": c["revision"] == c["expected_revision"] + 1, "OL_TRANSITION_OWNER": (to == "accepted") == c["owner"].isNotNull(),
        "OL_TRANSITION_CLEAR": ~c["clear_owner"] | ((c["from_state"] == "accepted") & (to == "open")), "OL_TRANSITION_SHIPPED": (to != "shipped") | (c["change_reference"].isNotNull() & (F.size(c["validation_evidence"]) > 0)),
        "OL_TRANSITION_VERIFIER": ~verdict | (c["actor_type"] == "verifier"), "OL_TRANSITION_EVIDENCE": ~verdict | (F.size(c["evidence"]) > 0),
    }


def audit_rules(action: Column, resources: Column, outcome: Column) -> dict[str, Column]:
    return {"OL_AUDIT_ACTION": action.rlike(MACHINE_NAME), "OL_AUDIT_RESOURCES": unique_ids(resources), "OL_AUDIT_OUTCOME": outcome.isin("success", "failure", "denied", "noop")}


def reference_violations(references: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(code, value) of values without a row to point at: (code, from table, column, to table, column) each."""
    out = None
    for code, left, a, right, b in references:
        lost = left.where(F.col(a).isNotNull()).join(right.select(F.col(b).alias("_b")), F.col(a) == F.col("_b"), "left_anti").select(F.lit(code).alias("code"), F.col(a).cast("string").alias("value")).distinct()
        out = lost if out is None else out.unionByName(lost)
    return out


def with_target(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows with their target's descriptor; an undeclared target has an error code. targets is configuration: at most CONFIGURED rows."""
    d = targets.select(F.col("target_id"), F.struct(*[c for c in targets.columns]).alias("target"))
    return rows.join(configuration(d), "target_id", "left").withColumn("error", F.when(F.col("target").isNull(), "OL_TARGET_UNDECLARED"))
