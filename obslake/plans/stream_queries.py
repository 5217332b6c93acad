"""Streams over the driver's tables, run to their end and read back, with SQL of the same over tables."""

from __future__ import annotations

import datetime as dt
from functools import partial

from pyspark.sql import functions as F

from ..functions.values import configuration
from ..sources.adapters import collector_of, shared_folder, table, target_of
from ..operators import alerts as A
from ..streaming import expiry as X, freshness as FR, streams as ST
from .ledger_queries import _TR

col = F.col
_END = "2100-01-01 00:00:00"


def _parts(spark, d, base, n=3, end=None):
    """A stream over folders of later and later events, and writers of the n folders, to be called one after the other.

    The folders are even ranges of time over all rows; the last one is open, and events without a time come first.
    end: how long after the last event a marker comes, an event of type `~end` in a folder of its own, which takes the watermark past all events.
    """
    e = table(spark, d, "events").withColumn("ts", col("ts").cast("timestamp"))
    at = F.unix_micros("ts")
    ends = e.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    width = max(1, -(-((ends["high"] or 0) - (ends["low"] or 0)) // n))
    part = F.coalesce(F.least(F.floor((at - F.lit(ends["low"])) / width), F.lit(n - 1)), F.lit(0)) if ends["low"] is not None else F.lit(0)

    def write(k):
        e.where(part == k).write.parquet(f"{base}/in{k}")

    def mark():
        late = F.timestamp_micros(F.lit(ends["high"] or 0)) + F.lit(end)
        marker = {"ts": late, "event_type": F.lit("~end")}
        spark.range(1).select(*[marker.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in e.schema]).write.parquet(f"{base}/in{n}")

    spark.createDataFrame([], e.schema).write.parquet(f"{base}/in")  # a folder to begin with
    return ST.files(spark, f"{base}/in*", e.schema, per_trigger=2**31 - 1), [*[partial(write, k) for k in range(n)], *([] if end is None else [mark])]


def _run(stream, parts, state, sink):
    """Runs the stream over one folder after the other."""
    for write in parts:
        write()
        ST.run(stream, state, sink)


def streamed_ingest(spark, d):
    """Two runs over the same input: the second adds nothing."""
    base = shared_folder(spark, "stream")
    stream, parts = _parts(spark, d, base)
    stream = stream.select("event_id", "event_type")
    _run(stream, parts, f"{base}/state", f"{base}/out")
    ST.run(stream, f"{base}/state", f"{base}/out")
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def streamed_dedup(spark, d):
    base = shared_folder(spark, "stream")
    stream, parts = _parts(spark, d, base, 1)
    e = stream.select(F.concat(F.lit("r"), col("event_id")).alias("record_id"), "ts")
    twice = e.unionByName(e)
    _run(ST.deduplicated(twice, "ts", "30 days"), parts, f"{base}/state", f"{base}/out")
    return spark.read.parquet(f"{base}/out").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("record_id").alias("ids"))


def streamed_alerts(spark, d):
    """The alert state carried over three runs equals one fold."""
    base = shared_folder(spark, "stream")
    rules = table(spark, d, "nation").withColumnRenamed("n_nationkey", "rule_no").where("rule_no < 20").select(F.concat(F.lit("rule-"), col("rule_no")).alias("rule_id"), F.lit(1).alias("rule_version"), collector_of(col("rule_no")).alias("collector"), (col("rule_no") % 3 + 1).cast("int").alias("consecutive_failures"), (col("rule_no") % 2 + 1).cast("int").alias("consecutive_successes"), F.lit(0).alias("cooldown_seconds"))
    stream, parts = _parts(spark, d, base)
    s = stream.select(collector_of(col("user_id") % 20).alias("collector"), target_of(col("user_id")).alias("target"), col("ts").alias("sampled_at"), F.when(col("event_id") % 9 > 0, F.concat(F.lit("r"), F.lpad(col("event_id").cast("string"), 12, "0"))).alias("record_id"), F.when(col("event_type").isin("error", "view"), "failure").otherwise("success").alias("outcome"))
    _run(ST.alert_transitions(s.join(configuration(rules), "collector")), parts, f"{base}/state", f"{base}/out")
    return spark.read.parquet(f"{base}/out").select("rule_id", "target", "record_id", "previous_state", "state", "revision")


def streamed_windows(spark, d):
    """Daily counts by event type; a marker two days after the last event closes the last windows."""
    base = shared_folder(spark, "stream")
    stream, parts = _parts(spark, d, base, end=dt.timedelta(days=2))
    _run(ST.windowed_counts(stream, "ts", ["event_type"], "1 hour", "1 day"), parts, f"{base}/state", f"{base}/out")
    return spark.read.parquet(f"{base}/out").where("event_type <> '~end'").select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def streamed_sessions(spark, d):
    """Error sessions of each target; a marker a day after the last event closes the last ones."""
    base = shared_folder(spark, "stream")
    stream, parts = _parts(spark, d, base, end=dt.timedelta(days=1))
    e = stream.where("event_type IN ('error', '~end')").withColumn("target", F.when(col("event_type") == "~end", "~end").otherwise(target_of(col("user_id"))))
    _run(ST.incident_sessions(e, "ts", ["target"], "1 hour", "2 hours"), parts, f"{base}/state", f"{base}/out")
    return spark.read.parquet(f"{base}/out").where("target <> '~end'").agg(F.sum("alerts").alias("alerts"), F.count(F.lit(1)).alias("sessions"))


def streamed_exports(spark, d):
    """An idempotent sink, run twice from the start: the ledger holds back the second."""
    base = shared_folder(spark, "stream")
    stream, parts = _parts(spark, d, base, 1)
    e = ST.isolated(stream, {"OL_USER": col("user_id") % 7 != 0, "OL_VALUE": col("value") < 100}).select("event_id", "error")
    for k in range(2):
        sink = ST.once_per_batch(ST.batch_folders(f"{base}/out"), f"{base}/ledger")
        _run(e, parts if k == 0 else [lambda: None], f"{base}/state{k}", sink)
    return spark.read.parquet(f"{base}/out").groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def streamed_unexpired(spark, d):
    base = shared_folder(spark, "stream")
    stream, parts = _parts(spark, d, base, 1)
    e = stream.withColumn("expires_at", col("ts") + F.expr("INTERVAL 5 DAY"))
    _run(ST.unexpired(e, "2024-01-20 00:00:00").select("event_id"), parts, f"{base}/state", f"{base}/out")
    return spark.read.parquet(f"{base}/out")


def _frames(spark, d):
    """Events as frames of day and target segments. A seventh of them expires early; some headers promise a frame more than comes."""
    e = table(spark, d, "events")
    batch = F.concat(F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("none")), F.lit("-"), target_of(col("user_id")))
    f = e.select(batch.alias("batch_id"), col("event_id").alias("sequence"), F.concat(F.lit("r"), "event_id").alias("record_id"), (col("ts") + F.expr("make_dt_interval(if(event_id % 7 = 0, 5, 9))")).alias("expires_at"))
    sizes = f.groupBy("batch_id").agg((F.count(F.lit(1)) + (F.count(F.lit(1)) % 5 == 0).cast("long")).alias("expected"))
    return f.join(sizes, "batch_id")


_NOW = "2024-01-18 12:00:00"


def streamed_segments(spark, d):
    """Segments whose frames come in three folders: whole and unexpired ones leave in the batch that completes them, all others in none."""
    base = shared_folder(spark, "stream")
    at = lambda k: F.timestamp_seconds(F.lit((k + 1) * 3600))
    frames = _frames(spark, d).withColumn("arrived_at", at(0))
    frames.limit(0).write.parquet(f"{base}/in")
    stream = ST.files(spark, f"{base}/in*", frames.schema, per_trigger=2**31 - 1)
    third = lambda k: lambda: frames.where(F.pmod(col("sequence"), F.lit(3)) == k).withColumn("arrived_at", at(k)).write.parquet(f"{base}/in{k}")
    late = lambda k: lambda: spark.range(1).select(*[{"arrived_at": at(k * 1000), "batch_id": F.lit("~end"), "expected": F.lit(2)}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in frames.schema]).write.parquet(f"{base}/in{k}")
    with X.with_rocksdb(spark):
        _run(X.whole_segments(stream, _NOW, "1 DAY"), [*[third(k) for k in range(3)], late(8)], f"{base}/state", f"{base}/out")
    out = spark.read.parquet(f"{base}/out").where("batch_id <> '~end'")
    return out.groupBy("batch_id", "verdict").agg(F.count("sequence").alias("frames"))


def segment_verdicts(spark, d):
    """The same verdicts over the table."""
    return X.segment_verdicts(_frames(spark, d), F.lit(_NOW).cast("timestamp"))


_SILENT = 10 * 3600


def _freshness_rules(spark, d):
    r = table(spark, d, "region")
    return r.select(col("r_regionkey").cast("long").alias("rule_no"), F.concat(F.lit("fresh-"), "r_regionkey").alias("rule_id"), F.lit(1).alias("rule_version"), (col("r_regionkey") % 3 + 1).cast("int").alias("consecutive_failures"), (col("r_regionkey") % 2 + 1).cast("int").alias("consecutive_successes"), (col("r_regionkey") * 86_400.0).alias("cooldown_seconds"))


def _freshness_alerts(rules, samples, fold):
    """Each source has the rule of its number modulo five."""
    s = samples.withColumns({"target": F.concat(F.lit("s"), col("source_id")), "rule_no": F.pmod(col("source_id").cast("long"), F.lit(5))})
    return fold(s.join(configuration(rules), "rule_no")).select("rule_id", "target", "sampled_at", "record_id", "previous_state", "state", "revision")


def _record():
    return F.concat(F.lit("r"), F.lpad(col("event_id").cast("string"), 12, "0"))


def freshness_alerts(spark, d):
    """Users that fall silent for ten hours and more: silence as samples, samples as alert states with a cooldown."""
    e = table(spark, d, "events").withColumn("ts", col("ts").cast("timestamp"))
    until = F.lit(e.agg(F.max("ts")).first()[0])
    samples = FR.silence_in_table(e, col("user_id"), col("ts"), _record(), until, _SILENT)
    return _freshness_alerts(_freshness_rules(spark, d), samples, A.transitions_with_cooldown)


def streamed_freshness(spark, d):
    """The same in two streams, the second over the samples of the first; the marker takes the watermark to the last event."""
    base = shared_folder(spark, "stream")
    stream, parts = _parts(spark, d, base, end=dt.timedelta(minutes=1))
    stream = stream.withColumn("source", F.when(col("event_type") == "~end", "~end").otherwise(col("user_id").cast("string")))
    samples = FR.silence(stream, col("source"), col("ts"), _record(), "1 minute", _SILENT).where("source_id <> '~end'")
    rules = _freshness_rules(spark, d)
    for write in parts:
        _run(samples, [write], f"{base}/silence", f"{base}/samples")
        seen = ST.files(spark, f"{base}/samples", samples.schema, per_trigger=2**31 - 1)
        ST.run(_freshness_alerts(rules, seen, FR.alerts), f"{base}/state", f"{base}/out")
    return spark.read.parquet(f"{base}/out")


def latency_alerts(spark, d):
    """Values over 80 as failures of their target, through the same states."""
    e = table(spark, d, "events").withColumn("ts", col("ts").cast("timestamp"))
    samples = A.threshold_samples(e, col("value"), 80.0).select(F.lit("latency").alias("rule_id"), F.lit(1).alias("rule_version"), target_of(col("user_id")).alias("target"), col("ts").alias("sampled_at"), _record().alias("record_id"), "outcome")
    samples = samples.withColumns({"consecutive_failures": F.lit(2), "consecutive_successes": F.lit(2), "cooldown_seconds": F.lit(0.0)})
    return A.transitions_with_cooldown(samples).select("target", "record_id", "previous_state", "state", "revision")


def streamed_heartbeats(spark, d):
    """Users from whom nothing came for 18 hours, as far as later events show it."""
    base = shared_folder(spark, "stream")
    stream, parts = _parts(spark, d, base, 10)
    _run(ST.stale_sources(stream, "user_id", "ts", "1 minute", 64_800), parts, f"{base}/state", f"{base}/out")
    return spark.read.parquet(f"{base}/out").agg(F.countDistinct("source_id").alias("sources"))


def streamed_intents(spark, d):
    """Alerts and their intents written batch by batch."""
    base = shared_folder(spark, "stream")
    stream, parts = _parts(spark, d, base, 2)
    changes = stream.where("event_type = 'error'").select(F.lit("r").alias("rule_id"), F.lit(1).alias("rule_version"), collector_of(col("user_id")).alias("collector"), target_of(col("user_id")).alias("target"), col("ts").alias("sampled_at"), F.concat(F.lit("r"), col("event_id")).alias("record_id"), F.lit("inactive").alias("previous_state"), F.lit("firing").alias("state"), F.lit(1).cast("long").alias("revision"))
    channels = table(spark, d, "region").select(F.concat(F.lit("ch-"), col("r_regionkey")).alias("channel_id"), (col("r_regionkey") != 2).alias("enabled"), F.array(F.lit("internal")).alias("allowed_classifications"))
    _run(changes, parts, f"{base}/state", ST.intents_sink(channels, f"{base}/out"))
    return spark.read.parquet(f"{base}/out/intents").groupBy("channel_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("intent_id").alias("ids"))


#: alert states folded in SQL, sample by sample: s(key, n, at, failed, failures, successes, pause), n from 1 in each key, ordered
_FOLD = """f AS (SELECT key, n, tick, record_id, CASE WHEN failed THEN 1 ELSE 0 END AS fails, CASE WHEN failed THEN 0 ELSE 1 END AS wins, failed AND 1 >= failures AS firing, failed AND 1 >= failures AS seen,
             CASE WHEN failed AND 1 >= failures THEN tick + pause END AS until, CASE WHEN failed AND 1 >= failures THEN 'inactive' END AS turned FROM s WHERE n = 1
        UNION ALL SELECT key, n, tick, record_id, fails, wins, CASE WHEN fire THEN true WHEN resolve THEN false ELSE was END, seen OR fire, CASE WHEN fire THEN tick + pause ELSE until END,
                         CASE WHEN fire THEN CASE WHEN seen THEN 'resolved' ELSE 'inactive' END WHEN resolve THEN 'firing' END
        FROM (SELECT *, NOT was AND failed AND fails >= failures AND (until IS NULL OR tick >= until) AS fire, was AND NOT failed AND wins >= successes AS resolve
              FROM (SELECT s.key, s.n, s.tick, s.record_id, s.failed, s.failures, s.successes, s.pause, f.firing AS was, f.seen, f.until, CASE WHEN failed THEN f.fails + 1 ELSE 0 END AS fails, CASE WHEN failed THEN 0 ELSE f.wins + 1 END AS wins
                    FROM f JOIN s ON s.key = f.key AND s.n = f.n + 1)))"""
_FRESH = f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, 'r' || lpad(event_id::VARCHAR, 12, '0') AS record_id, max(epoch_us(ts) // 1000) OVER () AS stop FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    g AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY ms, record_id) AS next FROM e),
    k AS (SELECT *, unnest(range(0, 1 + greatest(0, CASE WHEN next IS NULL THEN (stop - ms) // {_SILENT * 1000} ELSE (next - ms + {_SILENT * 1000} - 1) // {_SILENT * 1000} - 1 END)::BIGINT)) AS k FROM g),
    r AS (SELECT r_regionkey, 'fresh-' || r_regionkey AS rule_id, r_regionkey % 3 + 1 AS failures, r_regionkey % 2 + 1 AS successes, r_regionkey * 86400000 AS pause FROM region),
    s AS MATERIALIZED (SELECT rule_id || '|' || user_id AS key, row_number() OVER (PARTITION BY rule_id, user_id ORDER BY ms + k * {_SILENT * 1000}, record_id) AS n, ms + k * {_SILENT * 1000} AS tick, record_id, k > 0 AS failed, failures, successes, pause FROM k JOIN r ON user_id % 5 = r_regionkey),
    {_FOLD} SELECT split_part(key, '|', 1) AS rule_id, 's' || split_part(key, '|', 2) AS target, make_timestamp(tick * 1000) AS sampled_at, record_id, turned AS previous_state, CASE WHEN firing THEN 'firing' ELSE 'resolved' END AS state, n AS revision FROM f WHERE turned IS NOT NULL"""
_SEGMENTS = f"""WITH f AS (SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'none') || '-t' || (user_id % 10) AS batch_id, ts + to_days(CASE WHEN event_id % 7 = 0 THEN 5 ELSE 9 END) AS expires_at FROM events),
    g AS (SELECT batch_id, count(*) AS n, bool_or(coalesce(expires_at <= TIMESTAMP '{_NOW}', true)) AS expired FROM f GROUP BY 1) """
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}
ORACLES = {
    "streamed_ingest": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "streamed_dedup": "SELECT count(*) AS n, count(*) AS ids FROM events",
    "streamed_alerts": _TR,
    "streamed_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "streamed_sessions": "WITH a AS (SELECT user_id % 10 AS t, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts)) > 7200000000)::INT, 1) AS new FROM events WHERE event_type = 'error' AND ts IS NOT NULL), s AS (SELECT *, sum(new) OVER (PARTITION BY t ORDER BY ts) AS k FROM a), g AS (SELECT t, k, count(*) AS n, max(ts) + INTERVAL 2 HOUR AS e FROM s GROUP BY ALL) SELECT sum(n)::BIGINT AS alerts, count(*) AS sessions FROM g",
    "streamed_exports": "SELECT CASE WHEN user_id % 7 = 0 THEN 'OL_USER' WHEN NOT value < 100 THEN 'OL_VALUE' END AS error, count(*) AS n FROM events GROUP BY 1",
    "streamed_intents": "SELECT 'ch-' || r_regionkey AS channel_id, count(*) AS n, count(*) AS ids FROM events, region WHERE event_type = 'error' AND r_regionkey <> 2 GROUP BY 1",
    # a source is stale once the watermark, a minute behind the newest event of the folders so far, is past its last event by the limit
    "streamed_heartbeats": """WITH w AS (SELECT *, epoch_us(ts) AS us, min(epoch_us(ts)) OVER () AS low, greatest(1, -(-(max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER ()) // 10)) AS width FROM events WHERE ts IS NOT NULL),
        p AS (SELECT user_id, us, least((us - low) // width, 9) AS part FROM w), l AS (SELECT k.part, user_id, max(us) AS seen FROM p, (SELECT DISTINCT part FROM p) k WHERE p.part <= k.part GROUP BY ALL), m AS (SELECT part, max(seen) AS newest FROM l GROUP BY part)
        SELECT count(DISTINCT user_id) AS sources FROM l JOIN m USING (part) WHERE seen // 1000 + 64800000 <= newest // 1000 - 60000""",
    "segment_verdicts": _SEGMENTS + "SELECT batch_id, CASE WHEN expired THEN 'withheld' WHEN n % 5 = 0 THEN 'incomplete' ELSE 'forwarded' END AS verdict, CASE WHEN expired OR n % 5 = 0 THEN 0 ELSE n END AS frames FROM g",
    "streamed_segments": _SEGMENTS + "SELECT batch_id, CASE WHEN expired THEN 'withheld' WHEN n % 5 = 0 THEN 'incomplete' ELSE 'forwarded' END AS verdict, CASE WHEN expired OR n % 5 = 0 THEN 0 ELSE n END AS frames FROM g",
    "freshness_alerts": _FRESH,
    "streamed_freshness": _FRESH,
    "latency_alerts": f"""WITH RECURSIVE s AS MATERIALIZED (SELECT 't' || (user_id % 10) AS key, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS n, epoch_us(ts) AS tick, 'r' || lpad(event_id::VARCHAR, 12, '0') AS record_id,
                              value > 80 AS failed, 2 AS failures, 2 AS successes, 0 AS pause FROM events), {_FOLD}
        SELECT key AS target, record_id, turned AS previous_state, CASE WHEN firing THEN 'firing' ELSE 'resolved' END AS state, n AS revision FROM f WHERE turned IS NOT NULL""",
    "streamed_unexpired": "SELECT event_id FROM events WHERE ts + INTERVAL 5 DAY > TIMESTAMP '2024-01-20'",
}
