"""Ranges of bounded size and scans of many keys in a task give what one fold gives."""

import datetime as dt

import pytest

from obslake.operators import cooldown as C
from obslake.operators.alerts import fold


@pytest.mark.parametrize("bits", [2, 17])
def test_ranges_inside_a_task(spark, monkeypatch, bits):
    monkeypatch.setattr(C, "ROWS", bits, raising=False)
    ends = C._ends

    def counted(pdf):
        assert len(pdf) <= 2**bits
        return ends(pdf)

    monkeypatch.setattr(C, "_ends", counted)
    start = dt.datetime(2024, 1, 1)
    schema = "rule_id string, rule_version int, target string, sampled_at timestamp, record_id string, outcome string, consecutive_failures int, consecutive_successes int, cooldown_seconds double"
    rows = [("r", 1, None if k % 9 == 0 else f"t{k % 9}", start + dt.timedelta(minutes=k), f"x{k:04}", "failure" if k * k % 7 < 4 else "success", 2, 1, 1800.0) for k in range(300)]
    got = C.transitions(spark.createDataFrame(rows, schema)).collect()
    want = []
    for target in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == target]
        want += [("r", 1, target, *o) for o in fold(None, ((r[3], r[4], r[5]) for r in mine), 2, 1, 1800.0)[1]]
    assert want and sorted(map(tuple, got), key=str) == sorted(want, key=str)
