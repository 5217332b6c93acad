"""Warehouse queries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity as I
from ..functions.values import timestamp_text
from ..operators import warehouse as WH
from ..sources.adapters import INSTALLATION, event_drafts, target_of, table

NOW = "2024-02-15 00:00:00"


def versions(spark, d):
    """The events as warehouse rows; every third came again an hour later, every fifth of those changed."""
    e = table(spark, d, "events")
    rows = e.select(
        target_of(F.col("user_id")).alias("target_id"), F.lit("event").alias("record_type"), F.concat(F.lit("r"), F.col("event_id")).alias("record_id"), F.col("event_type").alias("name"), F.when(F.col("event_type") == "error", "error").otherwise("info").alias("severity"),
        F.lit("internal").alias("privacy_class"), F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("content_hash"), F.date_trunc("MILLISECOND", "ts").alias("occurred_at"),
    )
    rows = rows.withColumn("ingested_at", F.col("occurred_at") + F.expr("INTERVAL 2 SECOND"))
    n = F.substring("record_id", 2, 20).cast("long")
    again = rows.where(n % 3 == 0).withColumn("ingested_at", F.col("ingested_at") + F.expr("INTERVAL 1 HOUR")).withColumn("content_hash", F.when(n % 15 == 0, F.sha2(F.concat("record_id", F.lit("!")), 256)).otherwise(F.col("content_hash")))
    return rows.unionByName(again).withColumn("expires_at", F.col("ingested_at") + F.expr("INTERVAL 30 DAY"))


VERSIONS = """
r AS (SELECT 't' || (user_id % 10) AS target_id, 'event' AS record_type, 'r' || event_id AS record_id, event_id, event_type AS name, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, 'internal' AS privacy_class,
             sha256(event_id || '|' || event_type) AS content_hash, date_trunc('millisecond', ts) AS occurred_at, date_trunc('millisecond', ts) + INTERVAL 2 SECOND AS ingested_at FROM events),
v0 AS (SELECT * FROM r UNION ALL SELECT target_id, record_type, record_id, event_id, name, severity, privacy_class, CASE WHEN event_id % 15 = 0 THEN sha256(record_id || '!') ELSE content_hash END, occurred_at, ingested_at + INTERVAL 1 HOUR FROM r WHERE event_id % 3 = 0),
v AS (SELECT *, ingested_at + INTERVAL 30 DAY AS expires_at FROM v0),
cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target_id, record_type, record_id ORDER BY ingested_at DESC, content_hash DESC) AS k FROM v) WHERE k = 1)
"""


def _ts(c, name=None):
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ') AS {name or c}"


def transitions(spark, d):
    """Order lines as feedback transitions (repeats kept)."""
    li = table(spark, d, "lineitem")
    states = F.create_map(*[F.lit(x) for x in ("A", "accepted", "N", "shipped", "R", "rejected")])
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return li.select(F.concat(F.lit("i"), F.col("l_orderkey")).alias("item_id"), key.alias("transition_id"), F.col("l_linenumber").cast("long").alias("revision"), states[F.col("l_returnflag")].alias("to_state"), F.when(F.col("l_linestatus") == "F", "open").otherwise("accepted").alias("from_state"), F.col("l_shipdate").alias("occurred_at"))


TRANSITIONS = """
t AS (SELECT 'i' || l_orderkey AS item_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS transition_id, l_linenumber::BIGINT AS revision,
             CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'shipped' WHEN 'R' THEN 'rejected' END AS to_state, CASE WHEN l_linestatus = 'F' THEN 'open' ELSE 'accepted' END AS from_state, l_shipdate AS occurred_at FROM lineitem)
"""

META = ["record_id", "record_type", "target_id", "name", "severity", "privacy_class", "occurred_at", "ingested_at", "expires_at"]
_META_SQL = "record_id, record_type, target_id, name, severity, privacy_class, " + ", ".join(_ts(c) for c in META[6:])


def current_records(spark, d):
    return WH.listing(WH.current_records(versions(spark, d), NOW))


def current_records_of_target(spark, d):
    return WH.listing(WH.current_records(versions(spark, d), NOW, "t3"))


def records_page(spark, d):
    rows = WH.current_records(versions(spark, d), NOW).select("record_id", timestamp_text(F.col("ingested_at")).alias("ingested_at"))
    return WH.page(rows, [("ingested_at", True), ("record_id", False)], ("2024-01-25T00:00:00.000Z", ""), 50)


def newest_items(spark, d):
    o = table(spark, d, "orders")
    items = o.select(F.concat(F.lit("t"), F.col("o_custkey") % 10).alias("target_id"), F.concat(F.lit("i"), F.col("o_custkey")).alias("item_id"), F.col("o_orderdate").alias("created_at"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("fingerprint"))
    return WH.current_items(items).withColumn("created_at", timestamp_text(F.col("created_at")))


def distinct_transitions(spark, d):
    twice = transitions(spark, d).select("item_id", "transition_id")
    return WH.distinct_transitions(twice.unionByName(twice)).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def current_feedback(spark, d):
    return WH.current_feedback(transitions(spark, d)).withColumn("updated_at", timestamp_text(F.col("updated_at"))).orderBy("item_id")


def feedback_with_open(spark, d):
    items = table(spark, d, "orders").select(F.concat(F.lit("i"), F.col("o_orderkey")).alias("item_id"))
    return WH.current_feedback(transitions(spark, d), items).select("item_id", "state", "revision")


def content_conflicts(spark, d):
    return WH.content_conflicts(versions(spark, d))


def snapshot(spark, d):
    return WH.snapshot(versions(spark, d))


def restored_equal(spark, d):
    v = versions(spark, d)
    return WH.restored_equal(v, v.where("name <> 'signup'"))


def delivered_missing(spark, d):
    v = versions(spark, d)
    return WH.missing_ids(v.where("severity = 'error'"), v.where("target_id <> 't4'"))


def warehouse_rows(spark, d):
    """The export: restricted records are held back before it, as an export refuses them."""
    drafts = event_drafts(table(spark, d, "events")).where("privacy_class <> 'restricted'")
    tables, _ = WH.export(I.finalize(drafts, INSTALLATION))
    return tables["records"].select("target_id", "record_type", "name", "severity", "privacy_class", "source_id", "scope", "payload", F.length("record_id").alias("id_length"), timestamp_text(F.col("expires_at")).alias("expires_at"))


def export_counts(spark, d):
    drafts = event_drafts(table(spark, d, "events")).where("privacy_class <> 'restricted'")
    return WH.export(I.finalize(drafts, INSTALLATION))[1]


def cas_cursors(spark, d):
    """Orders propose to advance their customers' cursors; a customer's nation is its revision."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").cast("long").alias("revision"), F.col("c_name").alias("value"))
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 25).alias("expected_revision"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("request_id"))
    return WH.cas_advance(c, p, "source")[0]


def cas_conflicts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").cast("long").alias("revision"), F.col("c_name").alias("value"))
    p = table(spark, d, "orders").select(F.col("o_custkey").alias("source"), (F.col("o_orderkey") % 25).alias("expected_revision"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("request_id"))
    return WH.cas_advance(c, p, "source")[1]


_CAS = """
c AS (SELECT c_custkey AS source, c_nationkey::BIGINT AS revision, c_name AS value FROM customer),
p AS (SELECT o_custkey AS source, o_orderkey % 25 AS expected_revision, o_orderpriority AS value, o_orderkey AS request_id FROM orders),
a AS (SELECT p.*, coalesce(c.revision, 0) AS now_ FROM p LEFT JOIN c USING (source)),
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY expected_revision = now_ DESC, request_id) = 1 AND expected_revision = now_ AS won FROM a)
"""


def invalid_chains(spark, d):
    return WH.invalid_chains(WH.distinct_transitions(transitions(spark, d))).select("item_id", "transition_id", "revision", "from_state", "to_state")


QUERIES = {
    "current_records": current_records, "current_records_of_target": current_records_of_target, "records_page": records_page, "newest_items": newest_items, "distinct_transitions": distinct_transitions, "current_feedback": current_feedback,
    "feedback_with_open": feedback_with_open, "content_conflicts": content_conflicts, "snapshot_ids": snapshot, "restored_equal": restored_equal, "delivered_missing": delivered_missing, "warehouse_rows": warehouse_rows, "export_counts": export_counts,
    "cas_cursors": cas_cursors, "cas_conflicts": cas_conflicts, "invalid_chains": invalid_chains,
}
_EVENT_ROWS = "e AS (SELECT *, date_trunc('millisecond', ts) AS at_, ['public', 'internal', 'sensitive', 'restricted'][user_id % 4 + 1] AS privacy_class FROM events)"
ORACLES = {
    "current_records": f"WITH {VERSIONS} SELECT {_META_SQL} FROM cur WHERE expires_at > TIMESTAMP '{NOW}'",
    "current_records_of_target": f"WITH {VERSIONS} SELECT {_META_SQL} FROM cur WHERE expires_at > TIMESTAMP '{NOW}' AND target_id = 't3'",
    "records_page": f"WITH {VERSIONS} SELECT record_id, {_ts('ingested_at')}, (SELECT count(*) > 50 FROM cur WHERE expires_at > TIMESTAMP '{NOW}' AND ingested_at < TIMESTAMP '2024-01-25') AS truncated FROM cur WHERE expires_at > TIMESTAMP '{NOW}' AND ingested_at < TIMESTAMP '2024-01-25' ORDER BY cur.ingested_at DESC, record_id LIMIT 50",
    "newest_items": f"SELECT target_id, item_id, {_ts('created_at')}, fingerprint FROM (SELECT *, row_number() OVER (PARTITION BY target_id, item_id ORDER BY created_at DESC, fingerprint DESC) AS k FROM (SELECT 't' || (o_custkey % 10) AS target_id, 'i' || o_custkey AS item_id, o_orderdate AS created_at, sha256(o_orderkey::VARCHAR) AS fingerprint FROM orders)) WHERE k = 1",
    "distinct_transitions": f"WITH {TRANSITIONS} SELECT item_id, count(DISTINCT transition_id) AS n FROM t GROUP BY 1",
    "current_feedback": f"WITH {TRANSITIONS} SELECT item_id, arg_max(to_state, (revision, occurred_at, transition_id)) AS state, max(revision) AS revision, strftime(max(occurred_at), '%Y-%m-%dT%H:%M:%S.%gZ') AS updated_at FROM t GROUP BY 1",
    "feedback_with_open": f"WITH {TRANSITIONS}, s AS (SELECT item_id, arg_max(to_state, (revision, occurred_at, transition_id)) AS state, max(revision) AS revision FROM t GROUP BY 1) SELECT 'i' || o_orderkey AS item_id, coalesce(state, 'open') AS state, coalesce(revision, 0) AS revision FROM orders LEFT JOIN s ON s.item_id = 'i' || o_orderkey",
    "content_conflicts": f"WITH {VERSIONS} SELECT record_id, count(*) AS copies FROM v GROUP BY 1 HAVING count(DISTINCT content_hash) > 1",
    "snapshot_ids": f"WITH {VERSIONS} SELECT DISTINCT record_id FROM v",
    "restored_equal": "SELECT count(*) FILTER (event_type = 'signup') AS missing, 0::BIGINT AS added, count(*) FILTER (event_type = 'signup') = 0 AS equal FROM events",
    "delivered_missing": "SELECT DISTINCT 'r' || event_id AS record_id FROM events WHERE event_type = 'error' AND user_id % 10 = 4",
    "warehouse_rows": f"""WITH {_EVENT_ROWS} SELECT 't' || (user_id % 10) AS target_id, 'event' AS record_type, 'source.event' AS name, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, privacy_class, 'events' AS source_id, 'target' AS scope,
        '{{"type":"event","category":"availability","status":"' || CASE WHEN event_type = 'error' THEN 'degraded' ELSE 'healthy' END || '","message":"' || event_type || '","k":' || (props->>'$.k') || '}}' AS payload, 55::INTEGER AS id_length,
        strftime(at_ + INTERVAL 2 SECOND + INTERVAL 30 DAY, '%Y-%m-%dT%H:%M:%S.%gZ') AS expires_at FROM e WHERE privacy_class <> 'restricted'""",
    "export_counts": f"WITH {_EVENT_ROWS} SELECT 'records' AS table_name, count(*) AS n_rows FROM e WHERE privacy_class <> 'restricted'",
    "cas_cursors": f"WITH {_CAS} SELECT source, now_ + 1 AS revision, value FROM w WHERE won UNION ALL SELECT * FROM c WHERE source NOT IN (SELECT source FROM w WHERE won)",
    "cas_conflicts": f"WITH {_CAS} SELECT source, expected_revision, now_ AS revision, request_id FROM w WHERE NOT won",
    "invalid_chains": f"WITH {TRANSITIONS}, u AS (SELECT DISTINCT ON (item_id, transition_id) * FROM t ORDER BY item_id, transition_id, revision), z AS (SELECT *, lag(revision, 1, 0) OVER w AS b, lag(to_state, 1, 'open') OVER w AS s FROM u WINDOW w AS (PARTITION BY item_id ORDER BY revision, transition_id)) SELECT item_id, transition_id, revision, from_state, to_state FROM z WHERE revision <> b + 1 OR from_state <> s",
}
