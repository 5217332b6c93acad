"""Freshness rules on a stream: silence becomes samples, and samples alert state, in two stateful streams.

The first keeps, for each source, its last event and the events that the watermark hasn't passed. An event that the watermark passes
is a success; each time that the limit has gone by since the last event, without a new one, is a failure. Both come out by
event time, whatever the order of arrival. The second folds them into alert states. A table of samples stands between the two.

Sources share a state by hash, and so do alerts: a batch calls Python once a bucket, however many sources there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import EMITTED, KEY, fold
from .streams import BUCKETS, bucket_of

SAMPLE = "source_id string, sampled_at timestamp, record_id string, outcome string"
#: a bucket's rows as an Arrow table in bytes: arrays of values cost far more on their way between Python and Spark
STATE = "rows binary"
#: what a bucket of sources keeps; failures: how many have come of the silence after an event, -1 for one that the watermark hasn't passed
_WAITING = pa.schema([("source_id", pa.string()), ("ms", pa.int64()), ("record_id", pa.string()), ("failures", pa.int64())])
_EVENT = _WAITING.names
_FOLD = ["state", "fails", "wins", "until", "revision", "last"]
#: what a bucket of alerts keeps; times in microseconds
_FOLDED = pa.schema([("rule_id", pa.string()), ("rule_version", pa.int64()), ("target", pa.string()), ("state", pa.string()), *[(c, pa.int64()) for c in ("fails", "wins", "until", "revision", "last")]])
_CHANGE = [c.split()[0] for c in EMITTED.split(", ")]


def _plain(values: pd.Series) -> list:
    """A list with None for what is missing."""
    return values.astype(object).where(values.notna(), None).tolist()


def _packed(rows: pa.Table) -> tuple[bytes]:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as w:
        w.write_table(rows)
    return (out.getvalue().to_pybytes(),)


def _unpacked(state: tuple) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(state[0]))).read_all()


def _in_order(events: pd.DataFrame) -> pd.DataFrame:
    """Events source by source, in order of time and record."""
    codes, ms = pd.factorize(events["source_id"])[0], events["ms"].to_numpy()
    order = np.lexsort((ms, codes))
    tied = (np.diff(codes[order]) == 0) & (np.diff(ms[order]) == 0)
    if tied.any():  # only then do the records' names matter
        return events.sort_values(["source_id", "ms", "record_id"], na_position="first", ignore_index=True)
    return events.iloc[order].reset_index(drop=True)


def _passed(events: pd.DataFrame, watermark: int, limit: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(samples of all that the watermark has passed, the last event of each source with the failures that have come after it)."""
    e = _in_order(events)
    source, ms, before = e["source_id"].to_numpy(), e["ms"].to_numpy(), e["failures"].to_numpy()
    final = np.append(source[1:] != source[:-1], True) if len(e) else np.zeros(0, bool)
    until = np.append(ms[1:], 0)
    after = np.maximum(np.where(final, (watermark - ms) // limit, -((ms - until) // limit) - 1), np.maximum(before, 0))  # a failure just at the next event is none
    times = after - before  # an event that is new itself is one sample more, as its failures begin with -1
    at = np.repeat(np.arange(len(e)), times)
    k = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + before[at] + 1
    samples = pd.DataFrame({"source_id": source[at], "ms": ms[at] + k * limit, "record_id": e["record_id"].to_numpy()[at], "outcome": np.where(k == 0, "success", "failure")})
    return samples, e.assign(failures=after)[final]


def silence(stream: DataFrame, source: Column, at: Column, record: Column, lateness: str, limit_seconds: int, buckets: int = BUCKETS) -> DataFrame:
    """Samples of each source by event time. Events without a time or a source tell nothing.

    limit_seconds: of event time without an event that make a failure.
    """
    limit = limit_seconds * 1000

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        watermark = max(state.getCurrentWatermarkMs(), 0)
        frames = [_unpacked(state.get).to_pandas()] if state.exists else []
        if not state.hasTimedOut:
            frames += [pdf[_EVENT[:-1]].assign(failures=-1) for pdf in batches]
        events = pd.concat(frames, ignore_index=True).astype({"ms": "int64", "failures": "int64"})
        over = (events["ms"] <= watermark).to_numpy()
        samples, last = _passed(events[over], watermark, limit)
        ahead = events[~over]
        due = np.append(ahead["ms"].to_numpy(), (last["ms"] + (last["failures"] + 1) * limit).to_numpy())
        kept = pd.concat([last, ahead]) if len(last) and len(ahead) else ahead if len(ahead) else last
        state.update(_packed(pa.Table.from_pandas(kept, _WAITING, preserve_index=False)))
        state.setTimeoutTimestamp(max(int(due.min()) - 1, watermark, 1))  # it wakes once the watermark is past this
        if len(samples):
            yield samples

    s = stream.select(source.cast("string").alias("source_id"), F.date_trunc("MILLISECOND", at).alias("at"), F.unix_millis(at).alias("ms"), record.cast("string").alias("record_id"))
    s = s.where("at IS NOT NULL AND source_id IS NOT NULL").withColumn("bucket", bucket_of(F.col("source_id"), buckets)).withWatermark("at", lateness)
    out = s.groupBy("bucket").applyInPandasWithState(step, "source_id string, ms bigint, record_id string, outcome string", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("source_id", F.timestamp_millis("ms").alias("sampled_at"), "record_id", "outcome")


def _alerts(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A bucket of alerts: folds samples in order of time; those older than the last that was folded stay out."""
    known = {k[: len(KEY)]: k[len(KEY) :] for k in zip(*(c.to_pylist() for c in _unpacked(state.get).columns))} if state.exists else {}
    pdf = pd.concat(list(batches), ignore_index=True).sort_values([*KEY, "us", "record_id"], na_position="first", ignore_index=True)
    keys = list(zip(*(pdf[c].tolist() for c in KEY)))
    us, record, outcome = pdf["us"].tolist(), _plain(pdf["record_id"]), pdf["outcome"].tolist()
    rules = list(zip(pdf["consecutive_failures"].tolist(), pdf["consecutive_successes"].tolist(), pdf["pause"].tolist()))
    out, begin = [], 0
    while begin < len(keys):
        k, end = keys[begin], begin + 1
        while end < len(keys) and keys[end] == k:
            end += 1
        now, rule = None, rules[begin]
        if k in known:
            *now, last = known[k]
            now = dict(zip(_FOLD, now))
            while begin < end and us[begin] < last:
                begin += 1
        if begin < end:
            now, changes = fold(now, zip(us[begin:end], record[begin:end], outcome[begin:end]), *rule)
            known[k] = (*(now[c] for c in _FOLD[:-1]), us[end - 1])
            out += [(*k, *c) for c in changes]
        begin = end
    if known:
        state.update(_packed(pa.table([pa.array(c, f.type) for c, f in zip(zip(*(k + v for k, v in known.items())), _FOLDED)], schema=_FOLDED)))
    if out:
        yield pd.DataFrame(out, columns=[{"sampled_at": "us"}.get(c, c) for c in _CHANGE])


def alerts(samples: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """State changes of a stream of samples(KEY, sampled_at, record_id, outcome, consecutive_failures, consecutive_successes, cooldown_seconds).

    Within a batch samples are put in order; a stream of silence has to be read with all of its new files in one batch.
    """
    cols = [*KEY, F.unix_micros(F.col("sampled_at")).alias("us"), "record_id", "outcome", "consecutive_failures", "consecutive_successes", F.round(F.col("cooldown_seconds") * 1_000_000).cast("long").alias("pause")]
    s = samples.select(*cols).withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))
    out = s.groupBy("bucket").applyInPandasWithState(_alerts, EMITTED.replace("sampled_at timestamp", "us bigint"), STATE, "append", GroupStateTimeout.NoTimeout)
    return out.select(*[F.timestamp_micros("us").alias(c) if c == "sampled_at" else c for c in _CHANGE])


def silence_in_table(events: DataFrame, source: Column, at: Column, record: Column, until: Column, limit_seconds: int) -> DataFrame:
    """The same samples over a table, as far as `until`, the end of what was watched.

    Each event stands for itself and for the silence after it: gaps become rows by an array of their failures.
    """
    e = events.select(source.cast("string").alias("source_id"), F.unix_millis(at).alias("ms"), record.alias("record_id")).where("ms IS NOT NULL AND source_id IS NOT NULL")
    following = F.lead("ms").over(W.partitionBy("source_id").orderBy("ms", "record_id"))
    limit = limit_seconds * 1000
    e = e.withColumns({"next": following, "end": F.unix_millis(until)}).where("ms <= end")
    last = F.when(F.col("next") <= F.col("end"), F.ceil((F.col("next") - F.col("ms")) / limit) - 1).otherwise(F.floor((F.col("end") - F.col("ms")) / limit))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long")))
    e = e.withColumn("k", k)
    return e.select("source_id", F.timestamp_millis(F.col("ms") + F.col("k") * limit).alias("sampled_at"), "record_id", F.when(F.col("k") == 0, "success").otherwise("failure").alias("outcome"))
