"""Contract checks over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import duration_seconds, known_code, retention_days, safe_resource_id, sample_outcome, timestamp_text
from ..operators import contracts as C
from ..sources import adapters as A
from ..sources.adapters import table

col = F.col


def envelope_errors(spark, d):
    """Some drafts lack the collector or its run; some name a collector although an importer produced them."""
    n = col("source_event_id").cast("long")
    e = A.event_drafts(table(spark, d, "events"))
    e = e.withColumn("source", col("source").withField("producer", F.when(n % 5 == 0, "importer").otherwise(col("source")["producer"])))
    e = e.withColumns({"collector_run_id": F.when(n % 3 > 0, col("collector_run_id")), "collector": F.when(n % 7 > 0, col("collector"))})
    return C.code_counts(C.check(e, C.envelope_rules()))


def item_envelope_errors(spark, d):
    """Envelope and payload of feedback items, some of which disagree."""
    o = table(spark, d, "orders")
    n, time = col("o_orderkey"), col("o_orderdate")
    other = lambda k, a, b: F.when(n % k == 0, F.lit(b)).otherwise(F.lit(a))
    pairs = {
        "severity": (F.lit("error"), other(3, "error", "info")), "target": (F.when(n % 11 > 0, "t1"), other(5, "t1", "t2")), "trust": (F.lit("verified"), other(7, "verified", "untrusted")),
        "privacy": (F.lit("internal"), other(2, "internal", "public")), "time": (time, F.when(n % 13 == 0, time + F.expr("INTERVAL 1 SECOND")).otherwise(time)),
    }
    return C.code_counts(C.check(o, C.payload_coupling(**pairs)))


def event_errors(spark, d):
    e = table(spark, d, "events").withColumn("status", F.when(col("user_id") % 11 == 0, "Not OK").otherwise("ok"))
    return C.code_counts(C.check(e, C.event_rules(F.lit("availability"), col("status"), F.when(col("event_type") == "view", "").otherwise(col("event_type")))))


def metric_errors(spark, d):
    li = table(spark, d, "lineitem")
    kind = F.when(col("l_returnflag") == "A", "gauge").when(col("l_returnflag") == "N", "window_total").when(col("l_suppkey") % 2 == 0, "cumulative_counter").otherwise("total")
    end = F.when(col("l_linestatus") == "F", col("l_shipdate") + F.expr("INTERVAL 1 DAY"))
    return C.code_counts(C.check(li, C.metric_rules(F.when(col("l_quantity") == 13, F.lit(float("nan"))).otherwise(col("l_quantity")), kind, F.when(col("l_linestatus") == "F", col("l_shipdate")), end)))


def span_errors(spark, d):
    li = table(spark, d, "lineitem")
    return C.code_counts(C.check(li, C.span_rules(col("l_quantity") - 5, _pick(("ok", "error", "cancelled", "unset"), col("l_suppkey")))))


def run_measure_errors(spark, d):
    """Runs with durations and counts, each beyond its bounds in some."""
    runs = table(spark, d, "orders")
    k = col("o_orderkey")
    duration = F.when(k % 5 == 0, F.lit(None).cast("long")).when(k % 5 == 1, -k).otherwise(k)
    counts = F.when(k % 4 == 0, F.create_map(F.lit("files_seen"), k)).when(k % 4 == 1, F.create_map(F.lit("Bad key!"), k)).when(k % 4 == 2, F.create_map(F.lit("files_seen"), -k))
    return C.code_counts(C.check(runs, C.run_rules(col("o_orderdate"), col("o_orderdate"), F.lit("success"), duration, counts)))


def run_errors(spark, d):
    o = table(spark, d, "orders")
    runs = o.withColumn("ended", F.when(col("o_orderkey") % 7 == 0, col("o_orderdate") - F.expr("INTERVAL 1 HOUR")).when(col("o_orderkey") % 7 == 1, col("o_orderdate")))
    status = _pick(("success", "failure", "cancelled", "timeout", "partial", "unknown"), col("o_custkey"))
    return C.code_counts(C.check(runs, C.run_rules(col("o_orderdate"), col("ended"), status)))


_STATES = ("inactive", "firing", "resolved")


def _pick(values, n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def alert_errors(spark, d):
    o = table(spark, d, "orders")
    evidence = F.when(col("o_orderkey") % 5 == 0, F.array().cast("array<string>")).when(col("o_orderkey") % 5 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    return C.code_counts(C.check(o, C.alert_rules(_pick(_STATES, col("o_orderkey")), _pick(_STATES, col("o_custkey")), evidence)))


def intent_errors(spark, d):
    o = table(spark, d, "orders")
    kind = _pick(("local_log", "telegram", "pager", "github_issues"), col("o_orderkey"))
    return C.code_counts(C.check(o, C.intent_rules(kind, F.array(col("o_orderpriority")))))


def incident_errors(spark, d):
    o = table(spark, d, "orders")
    return C.code_counts(C.check(o, C.incident_rules(_pick((None, "open", "mitigated", "resolved"), col("o_orderkey")), _pick(("opened", "mitigated", "resolved", "reopened"), col("o_custkey")), _pick(("open", "mitigated", "resolved"), col("o_orderkey") + col("o_custkey")), F.array(F.lit("e")))))


def verification_errors(spark, d):
    p = table(spark, d, "part")
    names, kind = F.split("p_name", " "), _pick((*C.PREDICATES, "other"), col("p_partkey"))
    threshold = F.when(col("p_partkey") % 5 > 0, (col("p_size") - 3) / F.lit(20.0))
    return C.code_counts(C.check(p, C.verification_rules(
        kind, names, col("p_size") * 900_000, col("p_partkey") * 2_000, col("p_size") - 3, _pick((*C.SIGNAL_CLASSES, "log"), col("p_size")), threshold,
        F.when(col("p_partkey") % 3 == 0, "healthy"), F.when(col("p_partkey") % 4 > 0, F.lit("2026-01-01").cast("timestamp")),
    )))


def item_errors(spark, d):
    o = table(spark, d, "orders")
    priority = F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return C.code_counts(C.check(o, C.item_rules(F.when(col("o_orderstatus") == "P", "accepted").otherwise("open"), F.lit(0), priority, _pick(("observe", "investigate", "agent_safe", "other"), col("o_orderkey")), _pick(("low", "high", "sure"), col("o_custkey")), F.array(F.lit("e")),
        F.when(col("o_orderkey") % 6 > 0, F.sha2("o_orderstatus", 256)).otherwise("no digest"), F.repeat("o_orderpriority", F.when(col("o_orderkey") % 9 == 0, 60).otherwise(1)), (col("o_orderstatus"), F.when(col("o_orderkey") % 10 > 0, col("o_orderpriority")).otherwise("")))))


def transition_errors(spark, d):
    li = table(spark, d, "lineitem")
    states = ("open", "accepted", "shipped", "verified", "regressed", "rejected")
    to = _pick(states, col("l_linenumber") + col("l_suppkey"))
    some = F.when(col("l_partkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("e")))
    c = {"from_state": _pick(states, col("l_orderkey")), "to_state": to, "revision": col("l_linenumber"), "expected_revision": col("l_suppkey") % 8, "owner": F.when(col("l_partkey") % 2 == 0, "me"), "clear_owner": col("l_suppkey") % 5 == 0, "change_reference": F.when(col("l_orderkey") % 2 == 0, "c"), "validation_evidence": some, "actor_type": _pick(("human", "verifier"), col("l_partkey")), "evidence": some}
    return C.code_counts(C.check(li, C.transition_rules(c)))


def audit_errors(spark, d):
    s = table(spark, d, "supplier")
    return C.code_counts(C.check(s, C.audit_rules(F.lower("s_name"), F.array(F.lit("a"), (col("s_suppkey") % 2).cast("string"), F.lit("0")), _pick(("success", "noop", "maybe"), col("s_suppkey")))))


def dimension_errors(spark, d):
    """Typed dimension maps: keys from event types, values of four kinds, some out of bounds."""
    e = table(spark, d, "events")
    kind = _pick(("s", "i", "d", "b"), col("event_id"))
    none = {"b": F.lit(None).cast("boolean"), "i": F.lit(None).cast("bigint"), "d": F.lit(None).cast("double"), "s": F.lit(None).cast("string")}
    value = F.struct(kind.alias("t"), F.when(col("event_id") % 8 == 3, True).otherwise(none["b"]).alias("b"), F.when(kind == "i", col("user_id")).alias("i"), F.when(col("event_id") % 12 == 2, F.lit(float("inf"))).otherwise(col("value")).alias("d"), F.repeat(col("event_type"), F.when(col("event_id") % 16 == 0, 500).otherwise(1)).alias("s"))
    key = F.when(col("user_id") % 13 == 0, F.upper("event_type")).otherwise(col("event_type"))
    return C.code_counts(C.check(e.select(F.create_map(key, value).alias("m"), F.create_map(col("event_type"), col("user_id") - 3).alias("n")), {"OL_DIMENSIONS": C.bounded_dimensions(col("m")), "OL_COUNTS": C.bounded_counts(col("n"))}))


def text_errors(spark, d):
    t = table(spark, d, "documents")
    return C.code_counts(C.check(t, {"OL_TEXT_FREE": C.bounded_text(col("text"), 10_240), "OL_TEXT_TITLE": C.bounded_text(col("text"), 255), "OL_TEXT_LINE": C.bounded_text(col("text"), 1 << 20, single_line=True)}))


def reference_errors(spark, d):
    o, c, n, s = (table(spark, d, x) for x in ("orders", "customer", "nation", "supplier"))
    return C.reference_violations([("OL_REF_TARGET", o, "o_custkey", c.where("c_custkey % 17 <> 0"), "c_custkey"), ("OL_REF_ENVIRONMENT", c, "c_nationkey", n.where("n_nationkey < 20"), "n_nationkey"), ("OL_REF_PROVIDER", s, "s_nationkey", n, "n_nationkey")])


def target_descriptors(spark, d):
    n = table(spark, d, "nation").where("n_nationkey <> 7").select(col("n_nationkey").alias("target_id"), col("n_name").alias("name"))
    s = table(spark, d, "supplier").select("s_suppkey", col("s_nationkey").alias("target_id"))
    return C.with_target(s, n).select("s_suppkey", "target_id", col("target")["name"].alias("target_name"), "error")


def probe_availability(spark, d):
    probes = table(spark, d, "events").select(A.target_of(col("user_id")).alias("target_id"), col("event_id"), col("ts").alias("probed_at"), F.when(col("event_type") == "error", None).when(col("event_type") == "signup", 503).when(col("event_type") == "view", 204).otherwise(200).alias("status"))
    targets = table(spark, d, "region").select(F.concat(F.lit("t"), col("r_regionkey")).alias("target_id"), F.array(F.lit(200), F.when(col("r_regionkey") % 2 == 0, 204).otherwise(201)).alias("expected"))
    got = A.availability(probes, targets)
    return got.groupBy("target_id", "availability", "probe_failed", "error").agg(F.count(F.lit(1)).alias("n"), F.count(sample_outcome(col("availability"))).alias("samples"))


def run_records(spark, d):
    return A.run_drafts(table(spark, d, "orders")).withColumn("started_at", timestamp_text(col("started_at"))).withColumn("days", retention_days(F.lit("run")))


def recent_runs(spark, d):
    return A.run_filter(A.run_drafts(table(spark, d, "orders")), ["workflow", "deploy"], "1997-01-01", "1998-01-01").groupBy("target_id", "status").agg(F.count(F.lit(1)).alias("n"))


def latest_windows(spark, d):
    m = table(spark, d, "lineitem").select(col("l_suppkey").alias("metric"), col("l_shipdate").alias("window_start"), col("l_quantity").alias("value"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").alias("revision"))
    return A.latest_windows(m, ["metric", "window_start"], "revision").select("metric", timestamp_text(col("window_start")).alias("window_start"), "value")


def session_categories(spark, d):
    return A.category_counts(table(spark, d, "conversations"), "conv_id", "role")


def pointer_fields(spark, d):
    return A.pointer_mapping(table(spark, d, "events"), "props", {"k": "/k", "missing": "/a/0"}).select("event_id", "k", "missing")


def aliased_runs(spark, d):
    return A.mapped(table(spark, d, "orders"), "o_orderpriority", {"1-URGENT": "p0", "2-HIGH": "p1", "5-LOW": "p4"}, "priority").groupBy("priority", "error").agg(F.count(F.lit(1)).alias("n"))


def durations(spark, d):
    p = table(spark, d, "part").withColumn("text", F.concat(col("p_size"), _pick(("s", "m", "h", "d", "w"), col("p_partkey"))))
    return p.select("p_partkey", "text", duration_seconds(col("text")).alias("seconds"))


def codes_and_ids(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", known_code(col("p_type"), ["ECONOMY", "SMALL"]).alias("code"), safe_resource_id(F.when(col("p_size") % 3 == 0, col("p_name")).otherwise(F.replace("p_name", F.lit(" "), F.lit("-")))).alias("id"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}


def _codes(rows, **tests):
    """SQL of the counts of failed tests over rows."""
    return " UNION ALL ".join(f"SELECT '{code}' AS code, count(*) AS n FROM {rows} WHERE NOT coalesce({ok}, false) HAVING count(*) > 0" for code, ok in tests.items())


def _sql_pick(values, n):
    return f"([{', '.join('NULL' if v is None else repr(v) for v in values)}])[({n}) % {len(values)} + 1]"


def _sql_edges(edges, *cols):
    return " OR ".join("(" + " AND ".join(f"{c} IS NOT DISTINCT FROM {'NULL' if v is None else repr(v)}" for c, v in zip(cols, e)) + ")" for e in edges)


_CC = r"[\x00-\x1F\x7F-\x9F]"
_F = "([{}])[({}) % {} + 1]"
_FS = ("open", "accepted", "shipped", "verified", "regressed", "rejected")
ORACLES = {
    "envelope_errors": _codes("events", OL_RESTRICTED="user_id % 4 <> 3", OL_PROVENANCE="CASE WHEN event_id % 5 > 0 THEN event_id % 3 > 0 AND event_id % 7 > 0 ELSE event_id % 3 = 0 AND event_id % 7 = 0 END"),
    "item_envelope_errors": _codes("orders", OL_SEVERITY_MATCH="o_orderkey % 3 > 0", OL_TARGET_MATCH="o_orderkey % 11 > 0 AND o_orderkey % 5 > 0", OL_TRUST_MATCH="o_orderkey % 7 > 0", OL_PRIVACY_MATCH="o_orderkey % 2 > 0", OL_TIME_MATCH="o_orderkey % 13 > 0"),
    "event_errors": _codes("events", OL_EVENT_STATUS="user_id % 11 <> 0", OL_EVENT_MESSAGE="event_type <> 'view'"),
    "metric_errors": _codes("lineitem", OL_METRIC_VALUE="l_quantity <> 13", OL_METRIC_SEMANTICS="l_returnflag IN ('A', 'N') OR l_suppkey % 2 = 0", OL_METRIC_WINDOW="(l_returnflag = 'N') = (l_linestatus = 'F')"),
    "span_errors": _codes("lineitem", OL_SPAN_DURATION="l_quantity >= 5", OL_SPAN_STATUS="l_suppkey % 4 < 3"),
    "run_measure_errors": _codes("orders", OL_RUN_DURATION="o_orderkey % 5 > 1", OL_RUN_COUNTS="o_orderkey % 4 IN (0, 3)"),
    "run_errors": _codes("orders", OL_RUN_ORDER="o_orderkey % 7 = 1", OL_RUN_STATUS="o_custkey % 6 < 5"),
    "alert_errors": _codes(f"(SELECT *, {_sql_pick(_STATES, 'o_orderkey')} AS a, {_sql_pick(_STATES, 'o_custkey')} AS b FROM orders)", OL_ALERT_EDGE=_sql_edges(C.ALERT_EDGES, "a", "b"), OL_ALERT_EVIDENCE="o_orderkey % 5 > 1"),
    "intent_errors": _codes("orders", OL_INTENT_CHANNEL="o_orderkey % 2 = 1"),
    "incident_errors": _codes(f"(SELECT {_sql_pick((None, 'open', 'mitigated', 'resolved'), 'o_orderkey')} AS a, {_sql_pick(('opened', 'mitigated', 'resolved', 'reopened'), 'o_custkey')} AS b, {_sql_pick(('open', 'mitigated', 'resolved'), 'o_orderkey + o_custkey')} AS c FROM orders)", OL_INCIDENT_EDGE=_sql_edges(C.INCIDENT_EDGES, "a", "b", "c")),
    "verification_errors": _codes("(SELECT *, string_split(p_name, ' ') AS names FROM part)", OL_SPEC_PREDICATE="p_partkey % 7 < 6", OL_SPEC_NAMES="len(names) BETWEEN 1 AND 32 AND len(list_distinct(names)) = len(names) AND list_bool_and(list_transform(names, lambda x: regexp_full_match(x, '[a-z][a-z0-9]*([._-][a-z0-9]+)*')))", OL_SPEC_WINDOW="p_size::BIGINT * 900000 BETWEEN 1 AND 31536000", OL_SPEC_LATENESS="p_partkey * 2000 BETWEEN 0 AND 2592000", OL_SPEC_MINIMUM="p_size - 3 BETWEEN 1 AND 1000000", OL_SPEC_SIGNAL="p_size % 8 < 7", OL_SPEC_DEADLINE="p_partkey % 4 > 0",
        OL_SPEC_THRESHOLD="CASE p_partkey % 7 WHEN 0 THEN p_partkey % 3 = 0 AND p_partkey % 5 = 0 WHEN 3 THEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_size BETWEEN 3 AND 23 WHEN 2 THEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_size >= 3 AND (p_size - 3) % 20 = 0 WHEN 4 THEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 AND p_size >= 3 AND (p_size - 3) % 20 = 0 ELSE p_partkey % 3 > 0 AND p_partkey % 5 = 0 END"),
    "item_errors": _codes("orders", OL_ITEM_STATE="o_orderstatus <> 'P'", OL_ITEM_PRIORITY="substr(o_orderpriority, 1, 1)::INT BETWEEN 1 AND 4", OL_ITEM_ACTIONABILITY="o_orderkey % 4 < 3", OL_ITEM_CONFIDENCE="o_custkey % 3 < 2", OL_ITEM_FINGERPRINT="o_orderkey % 6 > 0", OL_ITEM_TITLE="o_orderkey % 9 > 0", OL_ITEM_TEXT="o_orderkey % 10 > 0"),
    "transition_errors": _codes(
        f"(SELECT *, {_sql_pick(_FS, 'l_orderkey')} AS f, {_sql_pick(_FS, 'l_linenumber + l_suppkey')} AS t FROM lineitem)", OL_TRANSITION_EDGE=_sql_edges(C.FEEDBACK_EDGES, "f", "t"), OL_TRANSITION_REVISION="l_linenumber = l_suppkey % 8 + 1", OL_TRANSITION_OWNER="(t = 'accepted') = (l_partkey % 2 = 0)",
        OL_TRANSITION_CLEAR="l_suppkey % 5 <> 0 OR (f = 'accepted' AND t = 'open')", OL_TRANSITION_SHIPPED="t <> 'shipped' OR (l_orderkey % 2 = 0 AND l_partkey % 3 <> 0)", OL_TRANSITION_VERIFIER="t NOT IN ('verified', 'regressed') OR l_partkey % 2 = 1", OL_TRANSITION_EVIDENCE="t NOT IN ('verified', 'regressed') OR l_partkey % 3 <> 0"),
    "audit_errors": _codes("supplier", OL_AUDIT_ACTION="regexp_full_match(lower(s_name), '[a-z][a-z0-9]*([._-][a-z0-9]+)*')", OL_AUDIT_RESOURCES="s_suppkey % 2 = 1", OL_AUDIT_OUTCOME="s_suppkey % 3 < 2"),
    "dimension_errors": _codes("events", OL_DIMENSIONS="user_id % 13 <> 0 AND CASE event_id % 4 WHEN 0 THEN event_id % 16 <> 0 OR length(event_type) * 500 <= 2048 WHEN 2 THEN event_id % 12 <> 2 WHEN 3 THEN event_id % 8 = 3 ELSE true END", OL_COUNTS="user_id >= 3"),
    "text_errors": _codes("(SELECT text, octet_length(encode(text)) AS n FROM documents)", OL_TEXT_FREE=rf"n BETWEEN 1 AND 10240 AND NOT regexp_matches(text, '[\x00-\x08\x0B-\x1F\x7F-\x9F]')", OL_TEXT_TITLE=r"n BETWEEN 1 AND 255 AND NOT regexp_matches(text, '[\x00-\x08\x0B-\x1F\x7F-\x9F]')", OL_TEXT_LINE=rf"n BETWEEN 1 AND 1048576 AND NOT regexp_matches(text, '{_CC}')"),
    "reference_errors": "SELECT DISTINCT 'OL_REF_TARGET' AS code, o_custkey::VARCHAR AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 17 <> 0) UNION ALL SELECT DISTINCT 'OL_REF_ENVIRONMENT', c_nationkey::VARCHAR FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) UNION ALL SELECT DISTINCT 'OL_REF_PROVIDER', s_nationkey::VARCHAR FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation)",
    "target_descriptors": "SELECT s_suppkey, s_nationkey AS target_id, n_name AS target_name, CASE WHEN n_name IS NULL THEN 'OL_TARGET_UNDECLARED' END AS error FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey <> 7) ON n_nationkey = s_nationkey",
    "probe_availability": """WITH p AS (SELECT user_id % 10 AS k, CASE event_type WHEN 'error' THEN NULL WHEN 'signup' THEN 503 WHEN 'view' THEN 204 ELSE 200 END AS status FROM events), q AS (SELECT k, status, r_regionkey IS NOT NULL AS known, status = 200 OR (status = 204 AND k % 2 = 0) OR (status = 201 AND k % 2 = 1) AS good FROM p LEFT JOIN region ON r_regionkey = k),
        a AS (SELECT 't' || k AS target_id, CASE WHEN status IS NULL OR (known AND NOT good) THEN 'degraded' ELSE 'healthy' END AS availability, (status IS NULL)::INTEGER AS probe_failed, CASE WHEN NOT known THEN 'OL_TARGET_UNDECLARED' END AS error FROM q) SELECT *, count(*) AS n, count(*) AS samples FROM a GROUP BY ALL""",
    "run_records": "SELECT 'run-' || o_orderkey AS run_id, 'workflow' AS run_type, 't' || (o_custkey % 10) AS target_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' ELSE 'partial' END AS status, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS started_at, 'P' || least(substr(o_orderpriority, 1, 1)::INT - 1, 3) AS priority, 180::INTEGER AS days FROM orders",
    "recent_runs": "SELECT 't' || (o_custkey % 10) AS target_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'failure' ELSE 'partial' END AS status, count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY ALL",
    "latest_windows": "SELECT l_suppkey AS metric, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS window_start, arg_max(l_quantity, (l_orderkey, l_linenumber, l_partkey, l_quantity)) AS value FROM lineitem GROUP BY l_suppkey, l_shipdate",
    "session_categories": "SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL",
    "pointer_fields": "SELECT event_id, props->>'$.k' AS k, NULL::VARCHAR AS missing FROM events",
    "aliased_runs": "SELECT priority, CASE WHEN priority IS NULL THEN 'OL_SOURCE_ALIAS' END AS error, count(*) AS n FROM (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'p0' WHEN '2-HIGH' THEN 'p1' WHEN '5-LOW' THEN 'p4' END AS priority FROM orders) GROUP BY ALL",
    "durations": "SELECT p_partkey, text, CASE WHEN p_size > 0 THEN p_size::BIGINT * CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 60 WHEN 2 THEN 3600 WHEN 3 THEN 86400 END END AS seconds FROM (SELECT *, p_size || (['s', 'm', 'h', 'd', 'w'])[p_partkey % 5 + 1] AS text FROM part)",
    "codes_and_ids": "SELECT p_partkey, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN p_type ELSE 'OL_UNEXPECTED' END AS code, CASE WHEN p_size % 3 <> 0 THEN replace(p_name, ' ', '-') END AS id FROM part",
}
