"""Tables of operations data as drafts of canonical records."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identity import generation_digest
from ..functions.values import configuration, expires_at, milliseconds

INSTALLATION = "ol_in1_00000000000040008000000000000000"
NAMESPACE = "ol_ns1_00000000000040008000000000000000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def target_of(user: Column) -> Column:
    return F.concat(F.lit("t"), user % 10)


def collector_of(user: Column) -> Column:
    return F.concat(F.lit("c"), user)


def status_of(event_type: Column) -> Column:
    return F.when(event_type == "error", "degraded").otherwise("healthy")


def privacy_of(user: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in ("public", "internal", "sensitive", "restricted")]), (user % 4 + 1).cast("int"))


def event_drafts(events: DataFrame) -> DataFrame:
    """One event draft a row: availability of the target of a user, as its collector saw it."""
    user, at = F.col("user_id"), milliseconds(F.col("ts"))
    second = F.expr("INTERVAL 1 SECOND")
    return events.select(
        F.lit("1.0").alias("schema_version"), F.lit("event").alias("record_type"), F.lit("source.event").alias("name"), at.alias("occurred_at"), (at + second).alias("observed_at"), (at + second + second).alias("ingested_at"),
        expires_at(at + second + second, F.lit("event")).alias("expires_at"), F.col("event_id").cast("string").alias("source_event_id"), F.lit(None).cast("string").alias("source_entity_id"),
        F.lit("operation-1").alias("operation_id"), F.concat(F.lit("run-"), F.date_format(at, "yyyyMMdd")).alias("collector_run_id"), F.lit("target").alias("scope"),
        F.struct(F.lit("events").alias("id"), F.lit("site.canary").alias("type"), F.lit("collector").alias("producer"), F.lit(NAMESPACE).alias("observation_namespace_id"), generation_digest(F.lit("events"), collector_of(user)).alias("source_generation_digest"),
                 F.struct(F.lit("source.event").alias("kind"), F.struct(F.col("event_id")).alias("parts")).alias("observation")).alias("source"),
        F.struct(collector_of(user).alias("id"), F.lit("site.canary").alias("type"), F.lit("1.0").alias("plugin_api_version"), F.lit("1.2.3").alias("implementation_version")).alias("collector"),
        F.struct(target_of(user).alias("id"), F.concat(F.lit("Target "), user % 10).alias("name"), F.lit("web.service").alias("kind"), F.lit("test").alias("environment")).alias("target"),
        F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"), F.lit("authenticated").alias("trust_level"), privacy_of(user).alias("privacy_class"), F.lit("r2-e1").alias("redaction_version"),
        F.struct(F.lit(None).cast("string").alias("trace_id"), F.concat(F.lit("run-"), user).alias("run_id")).alias("correlation"),
        F.struct(F.lit("event").alias("type"), F.lit("availability").alias("category"), status_of(F.col("event_type")).alias("status"), F.col("event_type").alias("message"), F.get_json_object("props", "$.k").cast("long").alias("k")).alias("data"),
    )


def metric_drafts(events: DataFrame) -> DataFrame:
    """The events' values as gauges."""
    at = milliseconds(F.col("ts"))
    return events.select(F.col("event_id").cast("string").alias("record_key"), target_of(F.col("user_id")).alias("target_id"), F.col("event_type").alias("name"), at.alias("occurred_at"), F.col("value"), F.lit("ms").alias("unit"), F.lit("gauge").alias("metric_semantics"))


def run_drafts(orders: DataFrame) -> DataFrame:
    """Orders as runs: status and priority translated."""
    status = F.create_map(*[F.lit(x) for x in ("F", "success", "O", "failure", "P", "partial")])
    return orders.select(
        F.concat(F.lit("run-"), F.col("o_orderkey")).alias("run_id"), F.lit("workflow").alias("run_type"), F.concat(F.lit("t"), F.col("o_custkey") % 10).alias("target_id"), status[F.col("o_orderstatus")].alias("status"), F.col("o_orderdate").alias("started_at"),
        F.concat(F.lit("P"), F.least(F.substring("o_orderpriority", 1, 1).cast("int") - 1, F.lit(3))).alias("priority"),
    )


def availability(probes: DataFrame, targets: DataFrame) -> DataFrame:
    """Probe results classified: an expected status is healthy, another or a failed probe degraded.

    probes(target_id, probed_at, status INT NULL); targets(target_id, expected ARRAY<INT>). A probe of an undeclared target has the error code.
    """
    out = probes.join(configuration(targets), "target_id", "left")  # declared targets: configuration
    failed = F.col("status").isNull()
    healthy = F.array_contains("expected", F.col("status"))
    return out.select(
        "target_id", "probed_at", "status", F.when(failed | ~healthy, "degraded").otherwise("healthy").alias("availability"), failed.cast("int").alias("probe_failed"),
        F.when(F.col("expected").isNull(), "OL_TARGET_UNDECLARED").alias("error"),
    )


def json_source(spark: SparkSession, path: str, schema: str, *, lines: bool, max_bytes: int = 1 << 20) -> DataFrame:
    """Rows of a JSON or JSON-lines source; a document over max_bytes or unreadable keeps only its code."""
    raw = spark.read.text(path, wholetext=not lines)
    parsed = F.from_json("value", f"{schema}, _bad STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    code = F.when(F.octet_length("value") > max_bytes, "OL_SOURCE_LARGE").when(parsed["_bad"].isNotNull() | parsed.isNull(), "OL_SOURCE_JSON")
    return raw.select(code.alias("error"), F.when(code.isNull(), parsed).alias("row")).select("error", "row.*").drop("_bad")


def mapped(rows: DataFrame, column: str, aliases: dict[str, str], out: str) -> DataFrame:
    """rows with `out`, the alias of a column's value; an undeclared value has the error code."""
    look_up = F.create_map(*[F.lit(x) for kv in sorted(aliases.items()) for x in kv])
    return rows.withColumn(out, look_up[F.col(column)]).withColumn("error", F.when(F.col(out).isNull(), "OL_SOURCE_ALIAS"))


def pointer_mapping(docs: DataFrame, body: str, pointers: dict[str, str]) -> DataFrame:
    """Fields of JSON documents by JSON pointers ({field: pointer})."""

    def path(pointer: str) -> str:
        steps = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
        return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)

    return docs.withColumns({k: F.get_json_object(body, path(p)) for k, p in sorted(pointers.items())})


def latest_windows(metrics: DataFrame, keys: list[str], revision: str) -> DataFrame:
    """Of overlapping fetches, the last revision of each metric window."""
    others = [c for c in metrics.columns if c not in keys]
    best = metrics.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(revision)).alias("_b"))
    return best.select(*keys, "_b.*")


def run_filter(runs: DataFrame, workflows: list[str], since, until, column: str = "run_type", at: str = "started_at") -> DataFrame:
    return runs.where(F.col(column).isin(workflows) & (F.col(at) >= F.lit(since)) & (F.col(at) < F.lit(until)))


def category_counts(traces: DataFrame, session: str, category: str) -> DataFrame:
    """Counts of each session's trace categories, never content."""
    return traces.groupBy(session, category).agg(F.count(F.lit(1)).alias("n"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, in spark.checkpoint.dir. Where that is unset, local mode makes one; a cluster must name it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        context.setCheckpointDir(folder)
    return f"{context.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
