"""Purges that are stale, repeated or half done; rollups of nothing; logs that are refused."""

import datetime as dt

import pytest

from obslake.operators import purge as PU
from obslake.operators import reports as RE
from obslake.sources import logs as LG

ROWS = [("r1", "a", "2024-01"), ("r2", "b", "2024-01"), ("r3", "a", "2024-02"), ("r4", "b", "2024-03"), ("r5", None, "2024-03")]


def stored(spark, root):
    spark.createDataFrame(ROWS, "record_id string, target_id string, month string").write.partitionBy("month").parquet(f"{root}/t")
    return PU.digest_of(PU.manifest({"t": PU._table(spark, f"{root}/t", "month")}, "a", "month"))


def left(spark, root):
    return sorted(tuple(r) for r in PU._table(spark, f"{root}/t", "month").select("record_id", "target_id", "month").collect())


def test_a_purge_removes_one_target_and_its_empty_partitions(spark, tmp_path):
    root = str(tmp_path)
    digest = stored(spark, root)
    with pytest.raises(ValueError, match="OL_PURGE_STALE"):
        PU.purge(spark, root, ["t"], "a", "0-0-0", "month")
    assert len(left(spark, root)) == 5
    (audit,) = PU.purge(spark, root, ["t"], "a", digest, "month").collect()
    assert left(spark, root) == sorted([ROWS[1], ROWS[3], ROWS[4]]) and not (tmp_path / "t/month=2024-02").exists()
    assert (audit["n_rows"], audit["n_partitions"], audit["n_left"], audit["outcome"]) == (2, 2, 0, "success")
    assert "a" not in (audit["resource"], audit["actor"]) and not [p for p in tmp_path.iterdir() if p.name.startswith("purge-")]


def test_a_purge_that_stopped_half_way_is_made_good(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    digest = stored(spark, root)
    remove = PU._remove

    def stops(session, folder):
        if "month=" in folder:
            raise RuntimeError("lost")
        remove(session, folder)

    monkeypatch.setattr(PU, "_remove", stops)
    with pytest.raises(RuntimeError):
        PU.purge(spark, root, ["t"], "a", digest, "month")
    assert ("r3", "a", "2024-02") in left(spark, root)
    monkeypatch.setattr(PU, "_remove", remove)
    assert PU.purge(spark, root, ["t"], "a", digest, "month").collect()[-1]["outcome"] == "success"
    assert left(spark, root) == sorted([ROWS[1], ROWS[3], ROWS[4]])


def test_a_calendar_without_records_shows_every_gap(spark):
    schema = "occurred_at timestamp, target_id string, name string"
    got = RE.calendar_rollup(spark.createDataFrame([], schema), "2024-01-01", "2024-01-08").collect()
    assert {r["level"] for r in got} == {"day", "week", "all"} and all(r["missing"] and r["n"] == 0 for r in got)
    assert sum(r["level"] == "day" for r in got) == 8 and sorted(r["days"] for r in got if r["level"] == "week") == [1, 7]
    rows = [(dt.datetime(2024, 1, 2, 5), None, "x"), (dt.datetime(2024, 1, 2, 6), "a", "x"), (dt.datetime(2025, 1, 1), "a", "y")]
    got = RE.calendar_rollup(spark.createDataFrame(rows, schema), "2024-01-01", "2024-01-03").collect()
    pairs = {(r["target_id"], r["name"], r["n"], r["missing_days"]) for r in got if r["level"] == "week/target/name"}
    assert pairs == {(None, "x", 1, 2), ("a", "x", 1, 2)}


def test_refused_logs_hide_no_other(spark):
    head = '{"line":"header","at":"2024-01-01T00:00:00.000Z","retention_days":30}'
    event = '{"line":"event","at":"2024-01-02T00:00:00.000Z","code":"c"}'
    texts = {"open": [head, event], "twice": [head, head], "none": [event], "broken": [head, "{"], "unsealed": [head, event, '{"line":"trailer","at":"2024-01-03T00:00:00.000Z","event_count":2,"content_sha256":"?","expires_at":"2024-01-09T00:00:00.000Z"}'], "when": ['{"line":"header","at":"soon","retention_days":30}']}
    rows = [(s, n, v) for s, lines in texts.items() for n, v in enumerate(lines)]
    got = {r["segment"]: (r["deadline"] and r["deadline"].isoformat()[:10], r["refused"]) for r in LG.retention_preview(LG.parsed(spark.createDataFrame(rows, "segment string, n int, value string")), 20).collect()}
    assert got == {"open": ("2024-01-21", None), "twice": (None, "OL_LOG_HEADER"), "none": (None, "OL_LOG_HEADER"), "broken": (None, "OL_LOG_LINE"), "unsealed": (None, "OL_LOG_TRAILER"), "when": (None, "OL_LOG_HEADER")}
