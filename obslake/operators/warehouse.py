"""The record warehouse: export rows, current views, snapshots, set checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.values import timestamp_text

CURRENT_KEY = ("target_id", "record_type", "record_id")


def record_rows(records: DataFrame) -> DataFrame:
    """The `records` table: 16 columns, an absent target or source as an empty string. Restricted rows are refused (see export)."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return records.select(
        empty(F.col("target")["id"]).alias("target_id"), "record_type", "record_id", "dedupe_key", "content_hash", "name", "severity", "trust_level", "privacy_class", empty(F.col("source")["id"]).alias("source_id"), "scope",
        "occurred_at", "observed_at", "ingested_at", "expires_at", F.to_json("data").alias("payload"),
    )


def export(records: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """({table: rows}, counts by table). One restricted record refuses the export with an error at run time."""
    guard = F.when(F.col("privacy_class") == "restricted", F.raise_error(F.lit("OL_EGRESS_RESTRICTED")).cast("boolean")).otherwise(F.lit(True))
    safe = records.where(guard)
    tables = {"records": record_rows(safe), "feedback_items": safe.where("record_type = 'feedback_item'").select("record_id", "target", "data"), "feedback_transitions": safe.where("record_type = 'feedback_transition'").select("record_id", "target", "data")}
    kind = F.when(F.col("record_type") == "feedback_item", F.array(F.lit("records"), F.lit("feedback_items"))).when(F.col("record_type") == "feedback_transition", F.array(F.lit("records"), F.lit("feedback_transitions"))).otherwise(F.array(F.lit("records")))
    return tables, safe.select(F.explode(kind).alias("table_name")).groupBy("table_name").agg(F.count(F.lit(1)).alias("n_rows"))


def newest(rows: DataFrame, keys: list[str] | tuple, version: str, tie: str) -> DataFrame:
    """The newest row of each key; among equal versions the largest tie value, so that the result is fixed.

    max_by combines on the map side, so repeats of a hot key meet as one row a task.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.col(version), F.col(tie))).alias("_b"))
    return best.select(*keys, "_b.*").select(rows.columns)


def current_records(rows: DataFrame, now, target: str | None = None) -> DataFrame:
    """Newest, unexpired rows; expiry is judged by the newest row, at `now`, however old its deletion."""
    if target is not None:
        rows = rows.where(F.col("target_id") == F.lit(target))
    return newest(rows, CURRENT_KEY, "ingested_at", "content_hash").where(F.col("expires_at") > F.lit(now).cast("timestamp"))


def current_items(items: DataFrame) -> DataFrame:
    return newest(items, ("target_id", "item_id"), "created_at", "fingerprint")


def distinct_transitions(transitions: DataFrame) -> DataFrame:
    return transitions.dropDuplicates(["item_id", "transition_id"])


def current_feedback(transitions: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """Each item's state by its last transition; with items, those without one are open."""
    last = F.struct("revision", "occurred_at", "transition_id")
    state = transitions.groupBy("item_id").agg(F.max_by("to_state", last).alias("state"), F.max("revision").alias("revision"), F.max("occurred_at").alias("updated_at"))
    if items is None:
        return state
    return items.select("item_id").distinct().join(state, "item_id", "left").withColumn("state", F.coalesce("state", F.lit("open"))).withColumn("revision", F.coalesce("revision", F.lit(0)))


def content_conflicts(rows: DataFrame) -> DataFrame:
    """Records that came with unequal contents."""
    seen = rows.groupBy("record_id").agg(F.min("content_hash").alias("least"), F.max("content_hash").alias("most"), F.count(F.lit(1)).alias("copies"))
    return seen.where("least <> most").select("record_id", "copies")


def snapshot(rows: DataFrame) -> DataFrame:
    return rows.select("record_id").distinct()


def restored_equal(source: DataFrame, restored: DataFrame) -> DataFrame:
    """One row: ids only in the source, only in the restored set, and whether the two sets are equal."""
    a, b = source.select("record_id").distinct().withColumn("s", F.lit(1)), restored.select("record_id").distinct().withColumn("r", F.lit(1))
    both = a.join(b, "record_id", "full_outer").agg(F.coalesce(F.sum(F.when(F.col("r").isNull(), 1).otherwise(0)), F.lit(0)).alias("missing"), F.coalesce(F.sum(F.when(F.col("s").isNull(), 1).otherwise(0)), F.lit(0)).alias("added"))
    return both.withColumn("equal", (F.col("missing") == 0) & (F.col("added") == 0))


def missing_ids(delivered: DataFrame, restored: DataFrame) -> DataFrame:
    """Delivered ids that the restored set lacks."""
    return delivered.select("record_id").distinct().join(restored.select("record_id"), "record_id", "left_anti")


def cas_advance(current: DataFrame, proposals: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(next state, conflicts) of revisioned rows.

    current(key, revision, value); proposals(key, expected_revision, value, request_id). A proposal holds when it
    expects the current revision (0 where there is none); of several that do, the least request id wins.
    """
    at = proposals.join(current.select(key, F.col("revision").alias("_now")), key, "left").withColumn("_now", F.coalesce("_now", F.lit(0)))
    rank = F.row_number().over(W.partitionBy(key).orderBy((F.col("expected_revision") == F.col("_now")).desc(), "request_id"))
    at = at.withColumn("_won", (rank == 1) & (F.col("expected_revision") == F.col("_now")))
    won = at.where("_won").select(key, (F.col("_now") + 1).alias("revision"), "value")
    kept = current.join(won.select(key), key, "left_anti").select(key, "revision", "value")
    return kept.unionByName(won), at.where("not _won").select(key, "expected_revision", F.col("_now").alias("revision"), "request_id")


def invalid_chains(transitions: DataFrame) -> DataFrame:
    """Transitions that do not step the revision by one from the state before."""
    w = W.partitionBy("item_id").orderBy("revision", "transition_id")
    before, state = F.lag("revision", 1, 0).over(w), F.lag("to_state", 1, "open").over(w)
    return transitions.withColumns({"_b": before, "_s": state}).where("revision <> _b + 1 OR from_state <> _s").drop("_b", "_s")


def listing(rows: DataFrame) -> DataFrame:
    """The metadata listing: nine columns, newest first, never the payload."""
    return rows.select("record_id", "record_type", "target_id", "name", "severity", "privacy_class", timestamp_text(F.col("occurred_at")).alias("occurred_at"), timestamp_text(F.col("ingested_at")).alias("ingested_at"), timestamp_text(F.col("expires_at")).alias("expires_at")).orderBy(F.desc("ingested_at"), "record_id")


def page(rows: DataFrame, keys: list[tuple[str, bool]], after: tuple | None, size: int = 100, most: int = 500) -> DataFrame:
    """One page by keyset: rows after the cursor in the keys' order ((column, descending)), with `truncated` telling of more."""
    size = min(size, most)
    if after is not None:
        test = F.lit(False)
        for (name, down), value in reversed(list(zip(keys, after))):
            c = F.col(name)
            test = ((c < F.lit(value)) if down else (c > F.lit(value))) | ((c == F.lit(value)) & test)
        rows = rows.where(test)
    order = [F.desc(n) if d else F.asc(n) for n, d in keys]
    got = rows.orderBy(*order).limit(size + 1)
    n = W.orderBy(*order)  # of size + 1 rows at most
    return got.withColumn("_n", F.row_number().over(n)).withColumn("truncated", F.max("_n").over(W.partitionBy(F.lit(1))) > size).where(F.col("_n") <= size).drop("_n")
