"""Whole segments and silence on streams, folder by folder."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from obslake.operators import alerts as A
from obslake.streaming import expiry as X, freshness as FR, streams as ST

FRAMES = "batch_id string, sequence long, record_id string, expires_at timestamp, expected long, arrived_at timestamp"
T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_segments_leave_whole_or_not_at_all_and_the_state_shrinks(spark, tmp_path):
    frame = lambda b, s, h, n, at: (b, s, f"{b}{s}", None if h is None else hours(h), n, hours(at))
    folders = [
        [frame("whole", 1, 90, 3, 1), frame("mixed", 1, 90, 2, 1), frame("dead", 1, 5, 2, 1), frame("open", 1, 90, 2, 1), frame("one", 1, 51, 1, 1), frame("many", 1, 90, 1, 1), frame("many", 2, 90, 1, 1)],
        [frame("whole", 3, 90, 3, 2), frame("mixed", 2, 50, 2, 2), frame("dead", 2, 6, 2, 2), frame("timeless", 1, None, 1, 2), frame("dying", 1, 5, 9, 2)],
        [frame("whole", 2, 90, 3, 3)],
        [frame("~end", 1, 90, 1, 300)],
        [frame("~end2", 1, 90, 1, 301)],
    ]
    schema = spark.createDataFrame([], FRAMES).schema
    spark.createDataFrame([], FRAMES).write.parquet(f"{tmp_path}/in")
    stream = X.whole_segments(ST.files(spark, f"{tmp_path}/in*", schema), hours(50), "1 DAY")
    seen, sizes = [], []
    with X.with_rocksdb(spark):
        for k, rows in enumerate(folders):
            spark.createDataFrame(rows, FRAMES).write.parquet(f"{tmp_path}/in{k}")
            got = ST.run(stream, f"{tmp_path}/state", f"{tmp_path}/out")
            sizes.append(got.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
            out = {tuple(r)[:3] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
            seen.append(out - set().union(*seen) if seen else out)
    assert seen[0] == {("one", "forwarded", 1), ("many", "oversized", None)}
    assert seen[1] == {("mixed", "withheld", None), ("dead", "withheld", None), ("timeless", "withheld", None)}
    assert seen[2] == {("whole", "forwarded", k) for k in (1, 2, 3)}
    assert {x for s in seen[3:] for x in s if x[0][0] != "~"} == {("open", "incomplete", None), ("dying", "withheld", None)}
    assert sizes[-1] == 0 and max(sizes) > 0


@pytest.mark.parametrize("order", [(0, 1, 2), (1, 0, 2)])
def test_silence_by_event_time_whatever_the_order_of_arrival(spark, tmp_path, order):
    """Events that come late, but not too late, take their place in time; the table gives the same samples."""
    events = [[("a", hours(0), "r1"), ("a", hours(9), "r3"), ("b", hours(1), "s1")], [("a", hours(4), "r2"), ("b", hours(8), "s2"), ("c", None, "t")], [("~end", hours(30), "z")]]
    schema = "source string, at timestamp, record string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = ST.files(spark, f"{tmp_path}/in*", spark.createDataFrame([], schema).schema)
    samples = FR.silence(stream, F.col("source"), F.col("at"), F.col("record"), "10 hours", 3 * 3600)
    with X.with_rocksdb(spark):
        for k in (*order, 2):
            spark.createDataFrame(events[k], schema).write.mode("append").parquet(f"{tmp_path}/in{k}")
            ST.run(samples, f"{tmp_path}/state", f"{tmp_path}/out")
    got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("source_id <> '~end'").collect()))
    every = spark.createDataFrame([x for part in events for x in part], schema)
    want = FR.silence_in_table(every, F.col("source"), F.col("at"), F.col("record"), F.lit(hours(20)), 3 * 3600).where("source_id <> '~end'")
    assert got == sorted(map(tuple, want.collect()))
    assert [(r[1], r[3]) for r in got if r[0] == "a"] == [(hours(0), "success"), (hours(3), "failure"), (hours(4), "success"), (hours(7), "failure"), (hours(9), "success"), *[(hours(h), "failure") for h in (12, 15, 18)]]


def test_many_sources_share_a_state_from_silence_to_alerts(spark, tmp_path):
    """A batch calls Python once a bucket: the states are as many as buckets, however many the sources; the changes are those of the table."""
    events = [[(f"s{i}", hours(10 * k + (7 * i + k) % 10 + i % 2 / 4), f"r{k}-{i}") for i in range(1_500) if (i + k) % 4] for k in range(3)]
    schema, rule = "source string, at timestamp, record string", {"rule_id": F.lit("r"), "rule_version": F.lit(1), "consecutive_failures": F.lit(2), "consecutive_successes": F.lit(1), "cooldown_seconds": F.lit(7200.0)}
    ruled = lambda s: s.where("source_id <> '~end'").withColumns({**rule, "target": F.col("source_id")})
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = ST.files(spark, f"{tmp_path}/in*", spark.createDataFrame([], schema).schema)
    samples, rows = FR.silence(stream, F.col("source"), F.col("at"), F.col("record"), "1 minute", 3 * 3600), []
    with X.with_rocksdb(spark):
        for k, part in enumerate([*events, [("~end", hours(40) + dt.timedelta(minutes=1), "z")]]):
            spark.createDataFrame(part, schema).write.parquet(f"{tmp_path}/in{k}")
            runs = [ST.run(samples, f"{tmp_path}/silence", f"{tmp_path}/samples")]
            seen = ST.files(spark, f"{tmp_path}/samples", samples.schema, per_trigger=2**31 - 1)
            runs.append(ST.run(FR.alerts(ruled(seen)), f"{tmp_path}/state", f"{tmp_path}/out"))
            rows += [p["stateOperators"][0]["numRowsTotal"] for q in runs for p in q.recentProgress if p["stateOperators"]]
    every = spark.createDataFrame([x for part in events for x in part], schema)
    table = FR.silence_in_table(every, F.col("source"), F.col("at"), F.col("record"), F.lit(hours(40)), 3 * 3600)
    want = sorted(map(tuple, A.transitions_with_cooldown(ruled(table)).collect()))
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want and len(want) > 3_000
    assert 0 < max(rows) <= ST.BUCKETS
