"""Hard expiry of whole segments on a stream.

A segment may leave only when all its frames have come and none of them has reached its expiry: an expired one
holds the others back. Frames wait in the state until then. A segment that can't leave any more keeps no frame, only
the number of those still to come; one that is never completed is given up by a timer. So the state holds frames of open,
unexpired segments only.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME = "sequence bigint, record_id string"
SEEN = "arrived bigint, expected bigint, withheld boolean"
RESULT = "batch_id string, verdict string, sequence bigint, record_id string"


class WholeSegments(StatefulProcessor):
    """now: frames that expire at it or before are expired. patience: milliseconds of event time after which an open segment is given up."""

    def __init__(self, now: pd.Timestamp, patience: int):
        self.now, self.patience = now, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.frames = handle.getListState("frames", FRAME)
        self.seen = handle.getValueState("seen", SEEN)

    def _close(self) -> None:
        self.frames.clear()
        self.seen.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    @staticmethod
    def _rows(batch: str, verdict: str, frames: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(batch, verdict, *f) for f in frames], columns=["batch_id", "verdict", "sequence", "record_id"]).astype({"sequence": "Int64"})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        arrived, expected, withheld = self.seen.get() if self.seen.exists() else (0, 0, False)
        new, latest = [], 0
        for pdf in rows:
            arrived += len(pdf)
            expected = int(pdf["expected"].iloc[0])
            latest = max(latest, int(pdf["arrived_at"].max().timestamp() * 1000))
            withheld = withheld or bool((pdf["expires_at"].isna() | (pdf["expires_at"] <= self.now)).any())
            if not withheld:
                new += zip(pdf["sequence"].tolist(), pdf["record_id"].tolist())
        if withheld and self.frames.exists():
            self.frames.clear()
        if arrived >= expected:
            frames = [] if withheld else [*self.frames.get(), *new]
            self._close()
            yield self._rows(key[0], "withheld", [(None, None)]) if withheld else self._rows(key[0], "forwarded" if arrived == expected else "oversized", frames if arrived == expected else [(None, None)])
            return
        if new and not withheld:
            self.frames.appendList(new)
        self.seen.update((arrived, expected, withheld))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(max(latest, timerValues.getCurrentWatermarkInMs()) + self.patience)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        withheld = self.seen.exists() and self.seen.get()[2]
        self._close()
        yield self._rows(key[0], "withheld" if withheld else "incomplete", [(None, None)])

    def close(self) -> None:
        pass


def whole_segments(frames: DataFrame, now, patience: str, lateness: str = "0 seconds") -> DataFrame:
    """(batch_id, verdict, sequence, record_id): each frame of the segments that leave, and a row for each that doesn't.

    frames(batch_id, sequence, record_id, expires_at, expected, arrived_at); expected is the segment's record count, arrived_at its
    event time. verdict: forwarded; withheld (a frame has expired, or has no expiry); incomplete (given up); oversized.
    """
    seconds = frames.sparkSession.sql(f"SELECT unix_timestamp(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {patience}) - unix_timestamp(TIMESTAMP '1970-01-01 00:00:00')").first()[0]
    cols = ["batch_id", "sequence", "record_id", "expires_at", "expected", "arrived_at"]
    keyed = frames.select(*cols).withWatermark("arrived_at", lateness).groupBy("batch_id")
    return keyed.transformWithStateInPandas(WholeSegments(pd.Timestamp(now), int(seconds) * 1000), RESULT, "append", "EventTime")


def with_rocksdb(spark: SparkSession):
    """For the time of a `with`: streams keep their state in RocksDB, which these processors need."""

    class Setting:
        def __enter__(self):
            self.before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)

        def __exit__(self, *error):
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", self.before)

    return Setting()


def segment_verdicts(frames: DataFrame, now: Column) -> DataFrame:
    """The same over a table: (batch_id, verdict, frames that leave)."""
    expired = F.max(F.coalesce(F.col("expires_at") <= now, F.lit(True)))
    n, expected = F.count(F.lit(1)), F.first("expected")
    verdict = F.when(expired, "withheld").when(n < expected, "incomplete").when(n > expected, "oversized").otherwise("forwarded")
    out = frames.groupBy("batch_id").agg(verdict.alias("verdict"), n.alias("n"))
    return out.select("batch_id", "verdict", F.when(F.col("verdict") == "forwarded", F.col("n")).otherwise(0).alias("frames"))
