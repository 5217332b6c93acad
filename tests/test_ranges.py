"""The range join of specifications and records over spans of unlike length."""

import datetime as dt
import random

from pyspark.sql import functions as F

from obslake.operators import feedback as FB

T0 = dt.datetime(2024, 1, 1)
SPEC = "item_id int, target_id string, names array<string>, created_at timestamp, window_seconds int, lateness_seconds int, deadline timestamp, dimensions map<string,string>"
RECORD = "target_id string, name string, status string, value double, occurred_at timestamp, ingested_at timestamp, record_id string, dimensions map<string,string>"


def specs(n=60):
    r = random.Random(2)
    return [(i, r.choice("ab"), r.choice([["x"], ["x", "y"], ["x", "x"]]), T0 + dt.timedelta(seconds=r.randint(0, 10**6)), r.choice([1, 60, 61, 3600, 86_400, 31_536_000]), r.choice([0, 600]), T0 + dt.timedelta(days=r.choice([5, 500])), r.choice([None, {}, {"k": "1"}])) for i in range(n)]


def records(n=1500):
    r = random.Random(3)
    out = []
    for i in range(n):
        at = T0 + dt.timedelta(seconds=r.randint(0, 2 * 10**6))
        out.append((r.choice("abc"), r.choice("xyz"), "healthy", 1.0, at, at + dt.timedelta(seconds=r.choice([0, 500, 5000])), f"r{i}", r.choice([None, {"k": "1"}, {"k": "2", "j": "1"}])))
    return out


def test_mixed_spans_against_all_pairs(spark):
    want = set()
    for i, target, names, start, window, late, deadline, dims in specs():
        for t, name, _, _, at, came, record, have in records():
            end = start + dt.timedelta(seconds=window)
            fits = all((have or {}).get(k) == v for k, v in (dims or {}).items())
            if t == target and name in names and start <= at <= end and came <= min(end + dt.timedelta(seconds=late), deadline) and fits:
                want.add((i, record))
    got = [(r["item_id"], r["record_id"]) for r in FB.observations(spark.createDataFrame(specs(), SPEC), spark.createDataFrame(records(), RECORD)).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 200


def test_a_year_costs_two_buckets_and_no_cross_join(spark):
    one = specs(1)[0]
    long = [(i, *one[1:4], w, *one[5:]) for i, w in enumerate((60, 31_536_000, 60, 31_536_000))]
    s = spark.createDataFrame(long, SPEC)
    assert s.select(FB._span(F.col("window_seconds")).alias("s")).distinct().count() == 2
    out = FB.observations(s, spark.createDataFrame(records(200), RECORD))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_span" in plan and "_bucket" in plan and "Cross" not in plan
    # rows of the exploded side: windows of either length stand in two buckets at most
    width = F.lit(FB.SPAN) * F.pow(F.lit(FB.STEP), FB._span(F.col("window_seconds"))).cast("long")
    ends = [F.floor((F.unix_seconds("created_at") + more) / width) for more in (F.lit(0), F.col("window_seconds"))]
    assert s.agg(F.max(ends[1] - ends[0])).first()[0] <= 1


def test_many_specifications_are_shuffled_and_large_buckets_dealt_in_parts(spark, monkeypatch):
    """Whatever Spark thinks of their size, exploded specifications go to every task only where they are few; the pairs stay the same."""
    pairs = lambda: sorted(tuple(r) for r in FB.observations(spark.createDataFrame(specs(), SPEC), spark.createDataFrame(records(), RECORD)).select("item_id", "record_id").collect())
    want = pairs()
    monkeypatch.setattr(FB, "HELD", 50, raising=False)
    monkeypatch.setattr(FB, "SORTED", 16, raising=False)
    assert pairs() == want and len(want) > 200
    out = FB.observations(spark.createDataFrame(specs(), SPEC).hint("broadcast"), spark.createDataFrame(records(), RECORD))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=merge") == 1 and out.rdd.getNumPartitions() > 50
