"""The same contracts on streams: ingestion, dedup, alert state, windows, sinks.

Every stream here can run with trigger(availableNow=True): what has come is read,
the checkpoint remembers it, and a run over unchanged input adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.alerts import EMITTED, KEY, fold

STATE = "state string, fails bigint, wins bigint, until timestamp, revision bigint, last timestamp"
#: buckets of keys that share a state; a bucket's state is read and written as a whole, so billions of keys want more
BUCKETS = 256


def bucket_of(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def files(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """A folder of files as a stream; each file is read once for each checkpoint."""
    return spark.readStream.format(form).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def run(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str, mode: str = "append", name: str | None = None):
    """Runs the stream over all that is there. sink: a folder for Parquet, or a function of (batch, id)."""
    w = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    w = w.foreachBatch(sink) if callable(sink) else w.format("parquet").option("path", sink)
    query = (w.queryName(name) if name else w).start()
    query.awaitTermination()
    return query


def once_per_batch(write: Callable[[DataFrame, int], None], ledger: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes a batch, then its ledger row, and skips batches that the ledger has.

    write(batch, number) puts a batch under its number and replaces what stands there, as batch_folders does: a crash between
    the two writes the same batch again, and neither loses nor repeats a row.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = spark.read.schema("batch bigint").parquet(ledger) if _exists(spark, ledger) else None
        if done is not None and not done.where(F.col("batch") == number).isEmpty():
            return
        write(batch, number)
        spark.range(1).select(F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(ledger)

    return sink


def batch_folders(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its own."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def deduplicated(stream: DataFrame, at: str, within: str, key: str = "record_id") -> DataFrame:
    """The first row of each id among rows no further apart than `within`; state goes with the watermark."""
    return stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def unexpired(stream: DataFrame, now) -> DataFrame:
    """Rows that may still be forwarded."""
    return stream.where(F.col("expires_at") > F.lit(now).cast("timestamp"))


def isolated(stream: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """stream with `error`, the first code that fails: a bad row never stops the others."""
    code = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), c) for c, ok in checks.items()])
    return stream.withColumn("error", code)


def _alert_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["sampled_at", "record_id"], na_position="first")
    now, last = None, None
    if state.exists:
        s = state.get
        now = {"state": s[0], "fails": s[1], "wins": s[2], "until": None if pd.isna(s[3]) else pd.Timestamp(s[3]), "revision": s[4]}
        last = pd.Timestamp(s[5])
        rows = rows if pd.isna(last) else rows[rows["sampled_at"] >= last]  # a late sample stays a record; it can't turn newer state
    if not len(rows):
        return
    first = rows.iloc[0]
    it = zip(rows["sampled_at"], rows["record_id"].where(rows["record_id"].notna(), None), rows["outcome"])
    now, out = fold(now, it, int(first["consecutive_failures"]), int(first["consecutive_successes"]), float(first["cooldown_seconds"]))
    state.update((now["state"], now["fails"], now["wins"], now["until"], now["revision"], rows["sampled_at"].iloc[-1]))
    if out:
        yield pd.DataFrame([(*key, *o) for o in out], columns=[c.split()[0] for c in EMITTED.split(", ")])


def alert_transitions(samples: DataFrame) -> DataFrame:
    """State changes of each rule and target, its state kept between batches. Within a batch samples are put in order."""
    cols = [*KEY, "sampled_at", "record_id", "outcome", "consecutive_failures", "consecutive_successes", "cooldown_seconds"]
    return samples.select(*cols).groupBy(*KEY).applyInPandasWithState(_alert_step, EMITTED, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, at: str, keys: list[str], lateness: str, size: str, slide: str | None = None) -> DataFrame:
    """(window_start, keys, n) of observation windows, closed when the allowed lateness is over."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return stream.withWatermark(at, lateness).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def incident_sessions(stream: DataFrame, at: str, keys: list[str], lateness: str, horizon: str) -> DataFrame:
    """(keys, opened_at, closed_at, alerts) of sessions that end after a gap over the horizon, as in batch: one of just the horizon goes on."""
    more = F.expr("INTERVAL 1 MICROSECOND")
    w = F.session_window(at, F.lit(f"{horizon} 1 microsecond"))
    per = stream.withWatermark(at, lateness).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("alerts"))
    return per.select(*keys, F.col("w.start").alias("opened_at"), (F.col("w.end") - more).alias("closed_at"), "alerts")


def _heartbeats(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A bucket of sources. Those without an event in this batch whose time is over leave; the bucket wakes when the next one's is."""
    watermark = max(state.getCurrentWatermarkMs(), 0)
    known, limit, fresh = [], None, []
    if state.exists:
        sources, seen, limit = state.get
        known = [pd.Series(list(seen), index=list(sources), dtype="int64")]
    if not state.hasTimedOut:
        for pdf in batches:
            fresh.append(pdf.groupby("source_id")["us"].max())
            limit = int(pdf["limit_ms"].iloc[0])
    last = pd.concat([*known, *fresh]).groupby(level=0).max()
    due = last // 1000 + limit
    heard = last.index.isin(pd.concat(fresh).index) if fresh else False
    over = (due <= watermark) & ~pd.Series(heard, index=last.index)
    stale, kept = last[over], last[~over]
    if len(kept):
        state.update((kept.index.tolist(), kept.tolist(), limit))
        state.setTimeoutTimestamp(max(int(due[~over].min()) - 1, watermark))  # it wakes once the watermark is past this
    else:
        state.remove()
    if len(stale):
        yield pd.DataFrame({"source_id": stale.index, "us": stale.to_numpy()})


def stale_sources(stream: DataFrame, source: str, at: str, lateness: str, limit_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """(source_id, last_at) of sources from which nothing came for the limit, by event time; an event without a time or a source tells nothing of it.

    State is kept for a bucket of sources, by hash: a batch calls Python once a bucket, however many sources there are.
    """
    s = stream.select(F.col(source).cast("string").alias("source_id"), F.col(at).cast("timestamp").alias("at"), F.lit(limit_seconds * 1000).cast("long").alias("limit_ms")).withColumn("us", F.unix_micros("at"))
    s = s.where("at IS NOT NULL AND source_id IS NOT NULL").withColumn("bucket", bucket_of(F.col("source_id"), buckets)).withWatermark("at", lateness)
    out = s.groupBy("bucket").applyInPandasWithState(_heartbeats, "source_id string, us bigint", "sources array<string>, seen array<bigint>, limit_ms bigint", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("source_id", F.timestamp_micros("us").alias("last_at"))


def intents_sink(channels: DataFrame, path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes a batch's alerts, then the intents derived from them in the same pass, each to the batch's own folder: a repeated batch replaces what it wrote before."""
    from ..operators.alerts import alert_records, intents

    def sink(batch: DataFrame, number: int) -> None:
        alerts = alert_records(batch).withColumn("privacy_class", F.lit("internal")).persist()
        try:
            alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch={number}")
            intents(alerts, channels).write.mode("overwrite").parquet(f"{path}/intents/batch={number}")
        finally:
            alerts.unpersist()

    return sink
