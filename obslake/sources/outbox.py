"""Untrusted inbound lines: incremental reads, parsing, rejection, positions, rotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

FRAME = "schema_version STRING, producer_id STRING, occurred_at STRING, target STRING, kind STRING, actionability STRING, evidence_references ARRAY<STRING>, data MAP<STRING, STRING>"
FIELDS = ("schema_version", "producer_id", "occurred_at", "target", "kind", "actionability", "evidence_references", "data")
ACTIONABILITY = ("observe", "investigate", "agent_safe", "needs_approval")
TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}Z$"


def complete_lines(lines: DataFrame, positions: DataFrame) -> DataFrame:
    """Lines after each source's position that end in a line feed. lines(source, byte_start, byte_end, terminated, value)."""
    at = lines.join(positions.select("source", "offset"), "source", "left")
    return at.where(F.col("terminated") & (F.col("byte_start") >= F.coalesce("offset", F.lit(0)))).drop("offset")


def parsed(lines: DataFrame, max_line_bytes: int = 65_536, producers: list[str] | None = None) -> DataFrame:
    """lines with `frame` (null where rejected) and `reject_code`. The value of a rejected line is dropped."""
    f = F.from_json("value", FRAME)
    keys = F.json_object_keys("value")
    exact = (F.size(keys) == len(FIELDS)) & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in FIELDS]))) == 0)
    good = (
        exact & F.rtrim("value").endswith("}") & F.try_parse_json("value").isNotNull() & (f["schema_version"] == "1.0") & f["producer_id"].rlike(r"^[a-z][a-z0-9_-]{0,63}$") & f["occurred_at"].rlike(TIME) & F.try_to_timestamp(f["occurred_at"]).isNotNull() & f["kind"].rlike(r"^[a-z][a-z0-9]*(?:[._-][a-z0-9]+)*$")
        & f["actionability"].isin(*ACTIONABILITY) & (F.size(f["evidence_references"]) <= 100) & (F.size(F.array_distinct(f["evidence_references"])) == F.size(f["evidence_references"])) & (F.size(F.map_keys(f["data"])) <= 100)
    )
    code = F.when(F.octet_length("value") > max_line_bytes, "OL_OUTBOX_LARGE").when(~F.coalesce(good, F.lit(False)), "OL_OUTBOX_FRAME")
    if producers:
        code = code.when(~f["producer_id"].isin(*producers), "OL_OUTBOX_DENIED")
    out = lines.withColumn("reject_code", code).withColumn("frame", F.when(F.col("reject_code").isNull(), f))
    return out.withColumn("value", F.when(F.col("reject_code").isNull(), F.col("value")))


def reject_counts(read: DataFrame) -> DataFrame:
    """(reject_code, lines, bytes), accepted lines under null."""
    return read.groupBy("reject_code").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"))


def torn_tails(lines: DataFrame) -> DataFrame:
    """(source, torn_bytes) left for the next read."""
    return lines.where("not terminated").groupBy("source").agg(F.sum(F.col("byte_end") - F.col("byte_start")).alias("torn_bytes"))


def acknowledged(read: DataFrame, positions: DataFrame) -> DataFrame:
    """(source, offset, last_line_sha256, high_water): positions moved past what was read; the high water never falls."""
    new = read.groupBy("source").agg(F.max("byte_end").alias("_end"), F.max_by("line_sha256", "byte_end").alias("_sha"), F.max("sequence").alias("_seq"))
    out = positions.join(new, "source", "full_outer")
    return out.select("source", F.greatest("offset", "_end").alias("offset"), F.coalesce("_sha", "last_line_sha256").alias("last_line_sha256"), F.greatest("high_water", "_seq").alias("high_water"))


def rotation_number(path: Column) -> Column:
    """Number of a rotated file `name.jsonl.12`, null for another name; order is numeric."""
    return F.when(path.rlike(r"\.jsonl\.[1-9]\d{0,17}$"), F.regexp_extract(path, r"\.(\d+)$", 1).cast("long"))


def rotation_losses(files: DataFrame, positions: DataFrame) -> DataFrame:
    """(source, code): what a source's inventory says of its position, null where nothing was lost.

    files(source, path, sequence NULL, device, inode, size, prefix_sha256, ends_with_lf, is_active); positions(source,
    device, inode, offset, prefix_sha256, high_water). The first that holds: ambiguous name, cursor file gone,
    truncated, rewritten, gap above the cursor, top run deleted, torn rotated tail.
    """
    rotated = F.col("sequence").isNotNull()
    inventory = files.groupBy("source").agg(
        F.sum(F.when(~F.col("is_active") & ~rotated, 1).otherwise(0)).alias("_odd"), (F.count("sequence") - F.countDistinct("sequence")).alias("_twice"), F.max("sequence").alias("_top"),
        F.sum(F.when(rotated & ~F.col("ends_with_lf"), 1).otherwise(0)).alias("_torn"),
    )
    mine = positions.join(files.select("source", "device", "inode", "size", F.col("prefix_sha256").alias("_prefix"), "sequence"), ["source", "device", "inode"], "left")
    above = mine.where("sequence IS NOT NULL").select("source", F.col("sequence").alias("_mine")).join(files.where(rotated).select("source", "sequence"), "source").where("sequence >= _mine").groupBy("source").agg(((F.max("sequence") - F.min("sequence") + 1) - F.countDistinct("sequence")).alias("_gap"))
    out = mine.join(inventory, "source", "left").join(above, "source", "left")
    code = (
        F.when((F.col("_odd") > 0) | (F.col("_twice") > 0), "OL_ROTATION_AMBIGUOUS").when(F.col("size").isNull(), "OL_ROTATION_GONE").when(F.col("offset") > F.col("size"), "OL_ROTATION_TRUNCATED").when(F.col("_prefix") != F.col("prefix_sha256"), "OL_ROTATION_REWRITTEN")
        .when(F.col("_gap") > 0, "OL_ROTATION_GAP").when(F.col("high_water") > F.coalesce("_top", F.lit(0)), "OL_ROTATION_DELETED").when(F.col("_torn") > 0, "OL_ROTATION_TORN")
    )
    return out.select("source", code.alias("code"))
