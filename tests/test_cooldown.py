"""The scan with a cooldown against one fold over each key's samples."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from obslake.operators import cooldown as C
from obslake.operators.alerts import fold, transitions_with_cooldown

SCHEMA = "rule_id string, rule_version int, target string, sampled_at timestamp, record_id string, outcome string, consecutive_failures int, consecutive_successes int, cooldown_seconds double"
START = dt.datetime(2024, 1, 1)


def samples(seed, n, keys=(("hot", "t", 2, 1, 90.0),) * 6 + (("a", "t", 1, 2, 0.0), ("b", None, 3, 1, 1e6), ("c", "u", 1, 1, 20.5))):
    r = random.Random(seed)
    out = []
    for i in range(n):
        rule, target, f, s, c = r.choice(keys)
        at = START + dt.timedelta(seconds=r.randint(0, 8 * n))
        out.append((rule, 1, target, at, None if r.random() < 0.1 else f"r{i:06d}", r.choice(["failure", "failure", "success"]), f, s, c))
    return out


def plain(rows):
    by = {}
    for x in rows:
        by.setdefault(x[:3], []).append(x)
    out = []
    for key, xs in by.items():
        xs.sort(key=lambda x: (x[3], x[4] or ""))
        _, got = fold(None, [(pd.Timestamp(x[3]), x[4], x[5]) for x in xs], xs[0][6], xs[0][7], xs[0][8])
        out += [(*key, t.to_pydatetime(), *rest) for t, *rest in got]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed,ranges", [(1, 1), (2, 3), (3, 16), (4, 64)])
def test_equals_one_fold(spark, seed, ranges):
    rows = samples(seed, 1500)
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted([tuple(r) for r in transitions_with_cooldown(spark.createDataFrame(rows, SCHEMA)).collect()], key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows) and len(got) > 50


def test_a_hot_key_has_many_ranges(spark):
    """All samples of one key: no range, and so no task, sees more than its share."""
    rows = spark.createDataFrame(samples(5, 4000, (("hot", "t", 2, 1, 90.0),)), SCHEMA)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [*C.KEY, "sampled_at", "record_id"]
        sizes = [r["n"] for r in rows.repartitionByRange(*order).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == 16 and max(sizes) < 800
        plan = transitions_with_cooldown(rows)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_transfer_functions_agree_with_replays():
    """Any incoming state: the function of a range gives what folding its samples gives."""
    import numpy as np

    r = random.Random(7)
    for _ in range(300):
        n = r.randint(1, 30)
        us = np.sort(np.array([r.randint(0, 60) for _ in range(n)]))
        fires = np.array([r.random() < 0.6 for _ in range(n)])
        pause = np.full(n, r.choice([0, 3, 17, 200]))
        span = C.Range(us, fires, pause)
        resolves, steps = span.transfer()
        for until in [C.NEVER, *range(-1, int(us[0] + pause[0]) + 1, 3)]:
            for firing in (False, True):
                now, end, seen = firing, until, False
                for t, f, p in zip(us.tolist(), fires.tolist(), pause.tolist()):
                    if f and not now and t >= end:
                        now, end, seen = True, t + p, True
                    elif not f and now:
                        now = False
                assert C.applied(firing, until, False, resolves, steps) == (now, end, seen)


def test_samples_without_a_time_and_an_empty_table(spark):
    rows = [("a", 1, "t", None, "r1", "failure", 2, 1, 5.0), ("a", 1, "t", START, "r2", "failure", 2, 1, 5.0), ("a", 1, None, START, "r3", "failure", 1, 1, 5.0)]
    got = [tuple(r)[:3] + tuple(r)[4:] for r in transitions_with_cooldown(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted([("a", 1, "t", "r2", "inactive", "firing", 2), ("a", 1, None, "r3", "inactive", "firing", 1)], key=str)
    assert transitions_with_cooldown(spark.createDataFrame([], SCHEMA)).count() == 0
