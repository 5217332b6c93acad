"""Ledger audits: files against ledger rows, deliveries, retention, replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.values import configuration

#: what a file and its ledger row agree on
AGREED = ("day", "schema_version", "config_generation", "scope", "target_id", "privacy_class", "retention_days", "record_count", "content_sha256", "byte_size", "file_sha256")


def disagreements(ledger: DataFrame, files: DataFrame, fields: tuple = AGREED) -> DataFrame:
    """(batch_id, kind, fields): missing_file, orphan_file, or drift with the names of the fields that differ."""
    drift = F.array_compact(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}")), c) for c in fields]))
    both = ledger.alias("l").join(files.alias("f"), F.col("l.batch_id") == F.col("f.batch_id"), "full_outer")
    kind = F.when(F.col("f.batch_id").isNull(), "missing_file").when(F.col("l.batch_id").isNull(), "orphan_file").when(F.size(drift) > 0, "drift")
    return both.select(F.coalesce("l.batch_id", "f.batch_id").alias("batch_id"), kind.alias("kind"), F.when(kind == "drift", F.array_join(drift, ",")).alias("fields")).where("kind IS NOT NULL")


def supplied(segments: DataFrame, ledger: DataFrame, fields: tuple = ("record_count", "content_sha256", "byte_size", "file_sha256")) -> DataFrame:
    """(batch_id, verdict, fields) of segments that a caller hands in: live, segment_gone without a ledger row, or segment_stale with the fields that the live row has otherwise."""
    drift = F.array_compact(F.array(*[F.when(~F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")), c) for c in fields]))
    both = segments.alias("s").join(ledger.alias("l"), F.col("s.batch_id") == F.col("l.batch_id"), "left")
    verdict = F.when(F.col("l.batch_id").isNull(), "segment_gone").when(F.size(drift) > 0, "segment_stale").otherwise("live")
    return both.select(F.col("s.batch_id").alias("batch_id"), verdict.alias("verdict"), F.when(verdict == "segment_stale", F.array_join(drift, ",")).alias("fields"))


def missing_files(ledger: DataFrame, files: DataFrame) -> DataFrame:
    return ledger.join(files, "batch_id", "left_anti")


def adopted_orphans(ledger: DataFrame, files: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """Files without a ledger row as rows of origin `reconciled`, committed at the start of their day.

    retired(batch_id, file_sha256): a file whose digest equals its tombstone's is expired and stays out; with
    another digest the tombstone is stale and the file an ordinary orphan.
    """
    out = files.join(ledger.select("batch_id"), "batch_id", "left_anti")
    if retired is not None:
        out = out.join(retired.select("batch_id", "file_sha256"), ["batch_id", "file_sha256"], "left_anti")
    return out.withColumns({"committed_at": F.to_timestamp("day"), "origin": F.lit("reconciled")})


def duplicates(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files of repeated batch ids: the copy that agrees with the ledger is `healthy`, others `conflict_divergent` or `conflict_duplicate`."""
    w = W.partitionBy("batch_id")
    marked = files.withColumns({"_n": F.count(F.lit(1)).over(w), "_low": F.min("file_sha256").over(w), "_high": F.max("file_sha256").over(w)}).where("_n > 1")
    keep = marked.join(ledger.select("batch_id", F.col("file_sha256").alias("_l")), "batch_id", "left")
    keep = keep.withColumn("_k", F.row_number().over(W.partitionBy("batch_id").orderBy(F.col("_l").eqNullSafe(F.col("file_sha256")).desc(), "path")))
    status = F.when((F.col("_k") == 1) & F.col("_l").eqNullSafe(F.col("file_sha256")), "healthy").when(F.col("_low") != F.col("_high"), "conflict_divergent").otherwise("conflict_duplicate")
    return keep.select("batch_id", "path", status.alias("status"))


def with_status(ledger: DataFrame, deliveries: DataFrame, status: str) -> DataFrame:
    """Segments that some exporter has in the status."""
    return ledger.join(deliveries.where(F.col("delivery_status") == status), "batch_id", "left_semi").orderBy("batch_id")


def delivered(ledger: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(batch_id, exporters, delivered_all, delivered_some): all delivered, with and without segments that have no exporter."""
    per = deliveries.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("delivery_status") == "delivered").alias("all"))
    out = ledger.select("batch_id").join(per, "batch_id", "left")
    return out.select("batch_id", F.coalesce("n", F.lit(0)).alias("exporters"), F.coalesce("all", F.lit(True)).alias("delivered_all"), F.coalesce("all", F.lit(False)).alias("delivered_some"))


def segment_summary(ledger: DataFrame, deliveries: DataFrame) -> DataFrame:
    return ledger.join(delivered(ledger, deliveries).select("batch_id", F.col("delivered_some").alias("delivered")), "batch_id").select("batch_id", "day", "record_count", "byte_size", "delivered")


def outcomes(ledger: DataFrame, deliveries: DataFrame, exporters: DataFrame, expiries: DataFrame, now) -> DataFrame:
    """(batch_id, exporter_id, outcome) of a delivery pass.

    exporters(exporter_id, identity_ok, works); expiries(batch_id, first_expiry). Order: a batch without a ledger
    row is segment_gone, one with an expired record is expired whole, delivered is final, no exporter, failed, delivered.
    """
    d = deliveries.join(ledger.select("batch_id", F.lit(1).alias("_live")), "batch_id", "left").join(expiries, "batch_id", "left")
    d = d.join(configuration(exporters), "exporter_id", "left")  # configured exporters: a few rows
    outcome = (
        F.when(F.col("_live").isNull(), "segment_gone").when(F.col("delivery_status") == "delivered", "already_delivered").when(F.col("first_expiry") <= F.lit(now).cast("timestamp"), "expired")
        .when(~F.coalesce("identity_ok", F.lit(False)), "no_exporter").when(~F.col("works"), "failed").otherwise("delivered")
    )
    return d.select("batch_id", "exporter_id", outcome.alias("outcome"))


def merged_deliveries(deliveries: DataFrame, results: DataFrame) -> DataFrame:
    """Deliveries after a pass: only delivered and failed change a row; delivered is final."""
    new = results.select("batch_id", "exporter_id", F.when(F.col("outcome").isin("delivered", "failed"), F.col("outcome")).alias("_new"))
    out = deliveries.join(new, ["batch_id", "exporter_id"], "left")
    return out.select("batch_id", "exporter_id", F.when(F.col("delivery_status") == "delivered", "delivered").otherwise(F.coalesce("_new", "delivery_status")).alias("delivery_status"))


def outcome_totals(results: DataFrame, ledger: DataFrame) -> DataFrame:
    """(outcome, segments, records), with the records of each segment counted once an outcome."""
    return results.select("batch_id", "outcome").distinct().join(ledger.select("batch_id", "record_count"), "batch_id", "left").groupBy("outcome").agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"))


def retention(expiries: DataFrame, ledger: DataFrame, now, unreadable: DataFrame | None = None, disagreeing: DataFrame | None = None) -> DataFrame:
    """(batch_id, state): fully_expired, mixed or live by the records' expiries; a segment without records is live.

    unreadable and disagreeing (batch_id): segments that can't be read, or whose file and ledger row differ; they have that state and are left alone.
    """
    per = expiries.groupBy("batch_id").agg(F.min("expires_at").alias("_min"), F.max("expires_at").alias("_max"))
    t = F.lit(now).cast("timestamp")
    state = F.when(F.col("_max") <= t, "fully_expired").when(F.col("_min") <= t, "mixed").otherwise("live")
    out = ledger.select("batch_id").join(per, "batch_id", "left")
    for name, marked in (("disagreeing", disagreeing), ("unreadable", unreadable)):
        if marked is not None:
            out = out.join(marked.select("batch_id", F.lit(1).alias(f"_{name}")).distinct(), "batch_id", "left")
            state = F.when(F.col(f"_{name}").isNotNull(), name).otherwise(state)
    return out.select("batch_id", state.alias("state"))


def reclaimable(states: DataFrame, ledger: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(segments, records, bytes, undelivered) of what is fully expired."""
    gone = states.where("state = 'fully_expired'").join(ledger, "batch_id").join(delivered(ledger, deliveries).select("batch_id", "delivered_all"), "batch_id")
    return gone.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"), F.coalesce(F.sum("byte_size"), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(~F.col("delivered_all"), 1).otherwise(0)), F.lit(0)).alias("undelivered"))


def prune(ledger: DataFrame, states: DataFrame, deliveries: DataFrame, cursors: DataFrame) -> dict[str, DataFrame]:
    """What retention leaves: ledger, deliveries, cursors (detached from pruned segments), report, audit."""
    marked = states.join(delivered(ledger, deliveries).select("batch_id", "delivered_all"), "batch_id")
    action = F.when(F.col("state") == "fully_expired", "pruned").otherwise("skipped")
    report = marked.select("batch_id", action.alias("action"), F.when(F.col("state") != "fully_expired", F.col("state")).alias("reason"), ((F.col("state") == "fully_expired") & ~F.col("delivered_all")).alias("critical"))
    gone = report.where("action = 'pruned'").select("batch_id")
    kept = cursors.join(gone.withColumn("_gone", F.lit(1)), "batch_id", "left").withColumn("batch_id", F.when(F.col("_gone").isNull(), F.col("batch_id"))).drop("_gone")
    audit = gone.select(F.lit("retention.prune").alias("action"), F.lit("system").alias("actor"), F.lit("success").alias("outcome"), F.sha2("batch_id", 256).alias("resource"))
    return {"ledger": ledger.join(gone, "batch_id", "left_anti"), "deliveries": deliveries.join(gone, "batch_id", "left_anti"), "cursors": kept, "report": report, "audit": audit}


def compacted(frames: DataFrame, states: DataFrame, now) -> tuple[DataFrame, DataFrame]:
    """(live frames of mixed segments renumbered under a new batch id, audit of old and new counts)."""
    mixed = frames.join(states.where("state = 'mixed'").select("batch_id"), "batch_id", "left_semi")
    live = mixed.where(F.col("expires_at") > F.lit(now).cast("timestamp"))
    new = live.withColumn("sequence", F.row_number().over(W.partitionBy("batch_id").orderBy("sequence")).cast("long"))
    audit = mixed.groupBy("batch_id").agg(F.count(F.lit(1)).alias("before"), F.count(F.when(F.col("expires_at") > F.lit(now).cast("timestamp"), 1)).alias("after"))
    return new.withColumnRenamed("batch_id", "old_batch_id").withColumn("batch_id", F.concat("old_batch_id", F.lit("-c"))), audit


def purged(tables: dict[str, DataFrame], target: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without a target's rows, manifest (table, rows, ids digest))."""
    left, manifest = {}, None
    for name, df in sorted(tables.items()):
        left[name] = df.where(~F.col("target_id").eqNullSafe(F.lit(target)))
        row = df.where(F.col("target_id") == target).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64("record_id").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("ids_digest"))
        manifest = row if manifest is None else manifest.unionByName(row)
    return left, manifest


def reconciliation(ledger: DataFrame, files: DataFrame, fields: tuple = AGREED) -> DataFrame:
    """(kind, n) over all batches, healthy ones included."""
    found = disagreements(ledger, files, fields)
    every = ledger.select("batch_id").union(files.select("batch_id")).distinct()
    return every.join(found, "batch_id", "left").groupBy(F.coalesce("kind", F.lit("healthy")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def reconciliation_counts(ledger: DataFrame, files: DataFrame, quarantined: DataFrame, fields: tuple = AGREED) -> DataFrame:
    """One row: files scanned, batches registered before, adopted by this pass, quarantined (batch_id: files kept out), missing, drifted."""
    found = disagreements(ledger, files, fields)
    kept_out = files.join(quarantined.select("batch_id").distinct(), "batch_id", "left_semi")
    adopted = adopted_orphans(ledger, files).join(quarantined.select("batch_id").distinct(), "batch_id", "left_anti")
    out = None
    for name, rows in (("scanned", files), ("registered", ledger), ("adopted", adopted), ("quarantined", kept_out), ("missing", found.where("kind = 'missing_file'")), ("drifted", found.where("kind = 'drift'"))):
        one = rows.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.join(one)
    return out


def unreferenced(cursors: DataFrame, ledger: DataFrame) -> DataFrame:
    """Cursors that point at no committed segment."""
    return cursors.where("batch_id IS NOT NULL").join(ledger, "batch_id", "left_anti")


def exporter_drift(required: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Batches whose exporters are not those required. required(batch_id, exporters ARRAY)."""
    have = deliveries.groupBy("batch_id").agg(F.array_sort(F.collect_set("exporter_id")).alias("have"))
    return required.join(have, "batch_id", "left").where(~F.array_sort("exporters").eqNullSafe(F.coalesce("have", F.array().cast("array<string>")))).select("batch_id")


def replay(frames: DataFrame) -> DataFrame:
    return frames.select("batch_id", "sequence", "record_id").orderBy("batch_id", "sequence")


def store_totals(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.count(F.lit(1)).alias("segments"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"))


def readable_totals(ledger: DataFrame, files: DataFrame, fields: tuple = AGREED) -> DataFrame:
    """store_totals, with how many segments and records have a file that agrees with its ledger row."""
    bad = disagreements(ledger, files, fields).select("batch_id").distinct()
    fine = ledger.join(bad, "batch_id", "left_anti").agg(F.count(F.lit(1)).alias("readable"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("readable_records"))
    return store_totals(ledger).join(fine)


def backlog(ledger: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(exporter_id, segments, records, oldest) not yet delivered."""
    d = deliveries.where(F.col("delivery_status") != "delivered").join(ledger, "batch_id")
    return d.groupBy("exporter_id").agg(F.count(F.lit(1)).alias("segments"), F.sum("record_count").alias("records"), F.min("committed_at").alias("oldest"))


def audit_listing(audit: DataFrame, action: str | None = None, limit: int = 1000) -> DataFrame:
    """Audit rows, oldest first."""
    if not 1 <= limit <= 100_000:
        raise ValueError("OL_AUDIT_LIMIT")
    rows = audit if action is None else audit.where(F.col("action") == action)
    return rows.orderBy("id").limit(limit)


def run_summary(attempts: DataFrame) -> DataFrame:
    """(collector, drafts, committed, delivered, failed), with a total row (collector null)."""
    count = lambda c: F.sum(F.when(F.col("outcome") == c, 1).otherwise(0)).alias(c)
    return attempts.rollup("collector").agg(F.count(F.lit(1)).alias("drafts"), *[count(c) for c in ("committed", "delivered", "failed")])


def run_totals(attempts: DataFrame, changes: DataFrame, intents: DataFrame) -> DataFrame:
    """run_summary with the alerts fired and resolved (changes: collector, state) and the intents (collector) of each collector."""
    fired = changes.rollup("collector").agg(*[F.sum(F.when(F.col("state") == s, 1).otherwise(0)).alias(name) for s, name in (("firing", "fired"), ("resolved", "resolved"))])
    meant = intents.rollup("collector").agg(F.count(F.lit(1)).alias("intents"))
    out = run_summary(attempts)
    for more in (fired, meant):
        more = more.withColumnRenamed("collector", "_c")
        out = out.join(more, F.col("collector").eqNullSafe(F.col("_c")), "left").drop("_c")
    return out.fillna(0, ["fired", "resolved", "intents"])
