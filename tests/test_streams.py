"""Streamed queries over events of several months, of the 31st and without a time."""

import datetime as dt

import duckdb
import pytest

from obslake.plans import stream_queries as SQ
from obslake.streaming import streams as ST

from .test_queries import plain


@pytest.fixture(scope="module")
def months(spark, sf_dir, tmp_path_factory):
    """Events from October to February, in an order that mixes the months, some without a time."""
    d = tmp_path_factory.mktemp("months")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    start, types = dt.datetime(2023, 10, 25), ["error", "view", "click"]
    rows = [{"event_id": i, "ts": None if i % 97 == 0 else start + dt.timedelta(minutes=250 * i), "user_id": i * 7 % 30, "event_type": types[i % 3], "value": float(i % 150)} for i in range(620)]
    rows = [tuple(r.get(f.name) for f in schema) for r in rows]
    spark.createDataFrame(rows[::2] + rows[1::2], schema).write.parquet(f"{d}/events.parquet")
    for t in ("region", "nation"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["streamed_ingest", "streamed_dedup", "streamed_windows", "streamed_sessions", "streamed_exports", "streamed_unexpired", "streamed_intents"])
def test_no_event_is_left_out(spark, months, name):
    duck = duckdb.connect()
    for t in ("events", "region", "nation"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{months}/{t}.parquet/*.parquet'")
    duck.sql("SET TimeZone = 'UTC'")
    source = SQ.ORACLES[name]
    if name == "streamed_sessions":  # an event without a time is in no session
        source = source.replace("WHERE event_type = 'error'", "WHERE event_type = 'error' AND ts IS NOT NULL")
    got = SQ.QUERIES[name](spark, months).toPandas()
    assert plain(got.convert_dtypes()) == plain(duck.sql(source).df().convert_dtypes())


def test_alerts_and_heartbeats_take_events_without_a_time(spark, months):
    assert SQ.QUERIES["streamed_heartbeats"](spark, months).first()["sources"] > 0
    assert SQ.QUERIES["streamed_alerts"](spark, months).count() > 0


def heartbeats_by_hand(folders, limit, late):
    """(source, last) that leave after each folder: silent for the limit as the watermark shows it, and heard of again only by a new event."""
    seen, out, newest = {}, [], 0
    for events in folders:
        for source, ms in events:
            seen[source] = max(seen.get(source, 0), ms)
            newest = max(newest, ms)
        gone = {s: ms for s, ms in seen.items() if ms + limit <= newest - late}
        out += gone.items()
        seen = {s: ms for s, ms in seen.items() if s not in gone}
    return sorted(out)


def test_many_sources_share_a_state_and_leave_each_at_its_time(spark, tmp_path):
    folders = [[(f"s{i}", k * 100_000 + 1_000 + i) for i in range(4_000) if (i + k) % 3 or i == 7] for k in range(3)]
    stream = ST.files(spark, f"{tmp_path}/in*", "source string, ts timestamp")
    (tmp_path / "in").mkdir()
    rows = 0
    for k, events in enumerate(folders):
        spark.createDataFrame(events, "source string, ms bigint").selectExpr("source", "timestamp_millis(ms) AS ts").write.parquet(f"{tmp_path}/in{k}")
        query = ST.run(ST.stale_sources(stream, "source", "ts", "1 second", 60), f"{tmp_path}/state", f"{tmp_path}/out")
        rows = max([rows, *(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"])])
    got = spark.read.parquet(f"{tmp_path}/out").selectExpr("source_id", "unix_millis(last_at) AS ms").collect()
    want = heartbeats_by_hand(folders, 60_000, 1_000)
    assert sorted(map(tuple, got)) == want and len(want) > 2_000
    assert 0 < rows <= ST.BUCKETS
