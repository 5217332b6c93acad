"""Collectors and exporters as data sources, over events that Spark hands to them, with SQL of what must arrive."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ..sources import protocols as P
from ..sources.adapters import shared_folder, table
from ..sources.registry import Registry
from ..streaming import streams as ST

col = F.col


def _spool(spark, d):
    """The events as a folder of JSON lines, some of them broken; the collector of that folder, registered; and a folder for drafts."""
    base = shared_folder(spark, "spool")
    e = table(spark, d, "events")
    line = F.when(col("event_id") % 50 == 0, "{broken").when(col("event_id") % 51 == 0, "[1]").otherwise(F.to_json(F.struct(col("event_id").alias("id"), col("event_type").alias("kind"))))
    e.select(line.alias("value")).write.text(f"{base}/lines")
    registry = Registry()
    return registry, P.register(spark, registry, P.JsonLinesCollector(f"{base}/lines")), f"{base}/drafts"


def _diagnostics():
    return {"failures": F.count("error"), "purchases": F.count(F.when(col("kind") == "purchase", 1))}


def collected_drafts(spark, d):
    """Drafts of a collector that reads a file a task; broken lines are drafts with a code."""
    drafts, _ = P.collect(spark, *_spool(spark, d), _diagnostics(), P.MOST_INT)
    return drafts.groupBy("kind", "error").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("draft_id").alias("ids"))


def collector_diagnostics(spark, d):
    """The counts that were observed while the drafts were written."""
    _, seen = P.collect(spark, *_spool(spark, d), _diagnostics(), P.MOST_INT)
    return spark.createDataFrame([(k, v) for k, v in seen.items()], "diagnostic string, n bigint")


def collector_configurations(spark, d):
    """Configured collectors against the registered ones: unknown types are refused with a code, and so is a second one of a name."""
    registry = Registry()
    for name in ("site_canary", "json_lines", "site_canary"):
        try:
            registry.register(name, dict)
        except ValueError as refused:
            again = str(refused)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("site_canary", "json_lines", "gone")]), (col("n_nationkey") % 3 + 1).cast("int"))
    outcome = F.when(kind.isin(registry.names()), "resolved").otherwise("OL_REGISTRY_UNKNOWN")
    return table(spark, d, "nation").select("n_name", kind.alias("type"), outcome.alias("outcome"), F.lit(again).alias("second"))


@dataclass
class Refusing(P.FolderExporter):
    """Fails in the tasks that meet an error event, after it has written."""

    def deliver(self, rows, delivery, task):
        def checked():
            for batch in rows:
                yield batch
                if pc.any(pc.equal(batch.column("event_type"), "error")).as_py():
                    raise RuntimeError("OL_EXPORT_REFUSED")

        return super().deliver(checked(), delivery, task)


def exported_events(spark, d):
    """Deliveries through an exporter: a batch and a stream, each made twice, and one whose tasks fail. stray: rows in parts that no manifest names."""
    base, registry = shared_folder(spark, "exports"), Registry()
    e = table(spark, d, "events").select("event_id", "event_type")
    to = P.FolderExporter("folder", f"{base}/to")
    folder, refusing = P.register(spark, registry, to), P.register(spark, registry, Refusing("refusing", f"{base}/to"))
    e.write.parquet(f"{base}/in")
    for k in range(2):
        P.export(registry, folder, e, "batch")
        P.export_stream(registry, folder, ST.files(spark, f"{base}/in", e.schema, per_trigger=2**31 - 1), "stream", f"{base}/state{k}")
    try:
        P.export(registry, refusing, e, "refused")
    except PySparkException:  # the tasks' failure; what is left of it is counted below
        pass
    got = to.published(spark)
    stray = spark.read.parquet(f"{to.root}/parts").agg(F.count(F.lit(1)).alias("written")).join(got.agg(F.count(F.lit(1)).alias("kept"))).select((col("written") - col("kept")).alias("stray"))
    return got.groupBy("delivery", "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids")).join(stray)


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "Refusing"}
_DRAFTS = """WITH x AS (SELECT CASE WHEN event_id % 50 = 0 THEN 'OL_SOURCE_JSON' WHEN event_id % 51 = 0 THEN 'OL_SOURCE_SHAPE' END AS error, * FROM events),
    x2 AS (SELECT error, CASE WHEN error IS NULL THEN event_type END AS kind, CASE WHEN error IS NULL THEN event_id END AS id FROM x) """
ORACLES = {
    "collected_drafts": _DRAFTS + "SELECT kind, error, count(*) AS n, count(DISTINCT id) AS ids FROM x2 GROUP BY 1, 2",
    "collector_diagnostics": _DRAFTS
    + """SELECT 'drafts' AS diagnostic, count(*) AS n FROM x2 UNION ALL SELECT 'failures', count(error) FROM x2
        UNION ALL SELECT 'purchases', count(*) FILTER (kind = 'purchase') FROM x2""",
    "collector_configurations": """SELECT n_name, t AS type, CASE WHEN t = 'gone' THEN 'OL_REGISTRY_UNKNOWN' ELSE 'resolved' END AS outcome, 'OL_REGISTRY_DUPLICATE' AS second
        FROM (SELECT n_name, (['site_canary', 'json_lines', 'gone'])[n_nationkey % 3 + 1] AS t FROM nation)""",
    "exported_events": "SELECT delivery, event_type, count(*) AS n, count(*) AS ids, 0::BIGINT AS stray FROM events, (VALUES ('batch'), ('stream-0')) v(delivery) GROUP BY 1, 2",
}
