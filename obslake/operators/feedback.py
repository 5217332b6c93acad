"""Feedback: recurrence, lifecycle proposals, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .contracts import FEEDBACK_EDGES, one_of


def trailing_counts(rows: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """rows with `in_window`, how many of the keys' rows lie in the `seconds` up to each."""
    w = W.partitionBy(*keys).orderBy(F.col(at).cast("timestamp").cast("long")).rangeBetween(-seconds, 0)
    return rows.withColumn("in_window", F.count(F.lit(1)).over(w))


def recurrences(records: DataFrame, names: list[str], minimum: int, seconds: int, known: DataFrame | None = None) -> DataFrame:
    """One item a target whose named records reach the minimum inside a window, unless its fingerprint is known."""
    hits = trailing_counts(records.where(F.col("name").isin(names)), ["target_id"], "occurred_at", seconds).where(F.col("in_window") >= minimum)
    items = hits.groupBy("target_id").agg(F.min("occurred_at").alias("first_at"), F.max("in_window").alias("most"))
    items = items.withColumn("fingerprint", F.sha2(F.concat_ws("\0", F.col("target_id"), F.lit(",".join(sorted(names)))), 256))
    return items if known is None else items.join(known.select("fingerprint"), "fingerprint", "left_anti")


def apply_proposals(current: DataFrame, proposals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next states, results). current(item_id, state, revision); proposals(item_id, request_id, expected_revision, to_state, at).

    A request id that comes again has the result of its first; of an item's proposals on one revision the first
    that the edges allow wins.
    """
    first = F.row_number().over(W.partitionBy("request_id").orderBy("at", "item_id"))
    once = proposals.withColumn("_again", first > 1)
    at = once.join(current, "item_id", "left")
    fits = ~F.col("_again") & (F.col("expected_revision") == F.col("revision")) & one_of(FEEDBACK_EDGES, F.col("state"), F.col("to_state"))
    at = at.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    rank = F.row_number().over(W.partitionBy("item_id").orderBy(F.col("_fits").desc(), "at", "request_id"))
    at = at.withColumn("_won", F.col("_fits") & (rank == 1))
    result = F.when(F.col("_won"), "applied").when(F.col("state").isNull(), "unknown_item").when(F.col("_again"), "repeated").when(F.col("expected_revision") != F.col("revision"), "stale").when(F.col("_fits"), "lost").otherwise("edge")
    won = at.where("_won").select("item_id", F.col("to_state").alias("state"), (F.col("revision") + 1).alias("revision"))
    return current.join(won.select("item_id"), "item_id", "left_anti").select("item_id", "state", "revision").unionByName(won), at.select("item_id", "request_id", "at", result.alias("result"))


#: seconds of the shortest span, by how much a span is longer than the one below it, and the number of spans (60 s to 32 years)
SPAN, STEP, SPANS = 60, 4, 13
#: rows of specifications by name and bucket that every task may hold; more of them are shuffled and sorted, as records are
HELD = 100_000
#: rows that a task of the join sorts, about, and records of one target, name and bucket that stay together
SORTED = 2**18


def _span(seconds: Column) -> Column:
    """The least span that a window fits in."""
    return sum(((seconds > SPAN * STEP**k).cast("int") for k in range(SPANS - 1)), F.lit(0))


def observations(specs: DataFrame, records: DataFrame) -> DataFrame:
    """Records that a specification looks at: its target, names and window, with lateness, before the deadline, and its dimensions.

    A range join over nested spans of time, each four times the one below: a specification stands in the two buckets at most that
    its window touches on the span it fits in, however long it is, and a record in one bucket of each span that is in use. So
    a year's window beside a minute's costs two rows, and both meet only records of their target, names and time.
    The rows of specifications are counted, as Spark's estimate of their size knows nothing of names and buckets: only few
    of them are sent to every task. Otherwise both sides are dealt to as many tasks as their rows need, and a bucket with very
    many records is dealt in parts, each of which meets all of its specifications.
    A dimension that a specification names must be there with its value; one that names none takes all.
    """
    ended = F.col("created_at") + F.make_dt_interval(secs=F.col("window_seconds").cast("decimal(18,6)"))
    last = F.least(ended + F.make_dt_interval(secs=F.col("lateness_seconds").cast("decimal(18,6)")), F.col("deadline"))
    width = lambda span: F.lit(SPAN) * F.pow(F.lit(STEP), span).cast("long")
    bucket = lambda at, span: F.floor(F.unix_seconds(at) / width(span))
    dims = F.col("dimensions") if "dimensions" in specs.columns else F.lit(None).cast("map<string,string>")
    have = F.col("dimensions") if "dimensions" in records.columns else F.lit(None).cast("map<string,string>")
    s = specs.withColumn("_span", _span(F.col("window_seconds")))
    s = s.select(
        "item_id", "target_id", "_span", F.explode(F.array_distinct("names")).alias("name"), F.col("created_at").alias("_from"), ended.alias("_to"), last.alias("_last"), dims.alias("_dims"),
    ).withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from"), F.col("_span")), bucket(F.col("_to"), F.col("_span")))))
    used = {x["_span"]: x["count"] for x in s.groupBy("_span").count().collect()}  # SPANS at most
    r = records.withColumn("_have", have).withColumn("_span", F.explode(F.array(*[F.lit(k) for k in sorted(used)]).cast("array<int>")))
    r = r.withColumn("_bucket", bucket(F.col("occurred_at").cast("timestamp"), F.col("_span")))
    keys, few = ["target_id", "name", "_span", "_bucket"], sum(used.values()) <= HELD
    if not few:
        r, s = (x.withColumn("_slot", F.col("_bucket") * SPANS + F.col("_span")).drop("_bucket", "_span") for x in (r, s))  # one key, as Spark drops a constant span from keys of a join
        keys = ["target_id", "name", "_slot"]
        large = F.broadcast(r.groupBy(*keys).count().where(F.col("count") > SORTED).select(*keys, F.ceil(F.col("count") / SORTED).alias("_parts")))
        parts, tasks = F.coalesce("_parts", F.lit(1)), -(-(records.count() * len(used) + sum(used.values())) // SORTED)
        r = r.join(large, keys, "left").withColumn("_part", F.pmod(F.xxhash64("record_id", "occurred_at"), parts))
        s = s.join(large, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        keys.append("_part")
        r, s = (x.drop("_parts").repartition(tasks, *keys) for x in (r, s))
    out = r.join(s.hint("broadcast" if few else "merge"), keys).where(F.col("occurred_at").between(F.col("_from"), F.col("_to")) & (F.col("ingested_at") <= F.col("_last")))
    fits = F.forall(F.map_entries("_dims"), lambda e: F.coalesce(F.element_at("_have", e["key"]) == e["value"], F.lit(False)))
    return out.where(F.coalesce(fits, F.lit(True))).select("item_id", "name", "status", "value", "occurred_at", "record_id")


def verified(specs: DataFrame, records: DataFrame, now) -> DataFrame:
    """(item_id, observed, outcome): verified, regressed, or pending while too little was seen.

    Predicates: state_equals, no_recurrence, count_at_most, ratio_at_least, latency_at_most, validation_passed.
    """
    per = observations(specs, records).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("status", F.struct("occurred_at", "record_id")).alias("last"), F.sum((F.col("status") == "degraded").cast("long")).alias("bad"), F.sum((F.col("status") == "healthy").cast("long")).alias("good"), F.max("value").alias("worst"))
    s = specs.join(per, "item_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "bad": F.coalesce("bad", F.lit(0)), "good": F.coalesce("good", F.lit(0))})
    p = F.col("predicate")
    holds = (
        F.when(p == "state_equals", F.col("last") == F.col("state")).when(p == "no_recurrence", F.col("bad") == 0).when(p == "count_at_most", F.col("bad") <= F.col("threshold")).when(p == "ratio_at_least", F.col("good") >= F.col("threshold") * F.col("n"))
        .when(p == "latency_at_most", F.col("worst") <= F.col("threshold")).when(p == "validation_passed", F.col("good") > 0)
    )
    closed = F.lit(now).cast("timestamp") >= F.least(F.col("created_at") + F.make_dt_interval(secs=(F.col("window_seconds") + F.col("lateness_seconds")).cast("decimal(18,6)")), F.col("deadline"))
    outcome = F.when(~closed | (F.col("n") < F.col("minimum")), "pending").when(F.coalesce(holds, F.lit(False)), "verified").otherwise("regressed")
    return s.select("item_id", F.col("n").alias("observed"), outcome.alias("outcome"))
