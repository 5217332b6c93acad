"""Segments: digest-sealed batches of record lines.

Lines are JSON: one header (keys of HEADER) and frames (keys of FRAME) a file.
Frames carry their sequence, so a segment is scanned by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.values import RETENTION_DAYS
from ..operators.numbering import numbered

HEADER = "batch_id STRING, day STRING, schema_version STRING, scope STRING, target_id STRING, privacy_class STRING, retention_days INT, record_count BIGINT, content_sha256 STRING"
FRAME = "batch_id STRING, sequence BIGINT, scope STRING, target_id STRING, privacy_class STRING, record_id STRING, record STRING"
HEADER_KEYS, FRAME_KEYS = ([f.split()[0] for f in s.split(", ")] for s in (HEADER, FRAME))
#: files of a day that one write makes, at most: lines name their batch, so many batches share a file
FILES = 16
BATCH = ("scope", "privacy_class", "target_id", "record_type")


def content_digest(frames: DataFrame, key: str = "batch_id", sequence: str = "sequence", line: str = "line") -> DataFrame:
    """(key, content_sha256, record_count): SHA-256 of a batch's lines in order, each with its line feed.

    A batch is bounded where it is made (see batched), so its lines may meet in one row.
    """
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(sequence).alias("s"), F.col(line).alias("l")))), lambda x: F.concat(x["l"], F.lit("\n")))
    return frames.groupBy(key).agg(F.sha2(F.array_join(lines, ""), 256).alias("content_sha256"), F.count(F.lit(1)).alias("record_count"))


def batched(records: DataFrame, order: list[str], most: int = 1000) -> DataFrame:
    """records with `chunk` and `sequence` (from 1): homogeneous batches of at most `most` records of one source and day.

    Rows are numbered in their group by the order; a group past `most` rows goes on in further chunks. The numbers come
    from ranges and prefix sums, so a source's whole day needs no task of its own.
    """
    rows = numbered(records, ["source_id", "day", *BATCH], order, "_n")
    n = F.col("_n") - 1
    return rows.withColumns({"chunk": F.floor(n / most).cast("int"), "sequence": (n % most + 1).cast("long")}).drop("_n")


def batch_ids(batches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, batch_id): the source and 24 hex digits of the digest over the day and the ordered record ids."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "record_id"))), lambda x: x["record_id"])
    digest = F.sha2(F.concat_ws("\0", F.first("day"), ids), 256)
    return batches.groupBy(*keys).agg(F.concat_ws("-", F.first("source_id"), F.substring(digest, 1, 24)).alias("batch_id"))


def build(records: DataFrame, order: list[str], most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(headers, frames) of records(source_id, day, scope, target_id, privacy_class, record_type, record_id, line)."""
    keys = ["source_id", "day", *BATCH, "chunk"]
    rows = batched(records, order, most)
    ids = batch_ids(rows, keys)
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    frames = rows.alias("r").join(ids.alias("i"), same).select("i.batch_id", *[f"r.{c}" for c in rows.columns])
    days = F.create_map(*[F.lit(x) for kv in RETENTION_DAYS.items() for x in kv])
    head = frames.groupBy("batch_id").agg(*[F.first(c).alias(c) for c in ("day", "scope", "target_id", "privacy_class", "record_type", "source_id")])
    head = head.join(content_digest(frames), "batch_id").withColumn("schema_version", F.lit("1.0")).withColumn("retention_days", days[F.col("record_type")])
    return head, frames


def homogeneous(frames: DataFrame) -> DataFrame:
    """(batch_id, homogeneous): one scope, class, target and type (null is a value of its own)."""
    one = F.lit(True)
    for c in BATCH:
        one = one & (F.countDistinct(F.coalesce(F.col(c), F.lit("\0"))) == 1)
    return frames.groupBy("batch_id").agg(one.alias("homogeneous"))


def contiguous(frames: DataFrame) -> DataFrame:
    """(batch_id, contiguous): sequences are 1 to n, each once."""
    return frames.groupBy("batch_id").agg(((F.min("sequence") == 1) & (F.max("sequence") == F.count(F.lit(1))) & (F.countDistinct("sequence") == F.count(F.lit(1)))).alias("contiguous"))


def write(headers: DataFrame, frames: DataFrame, path: str) -> None:
    """Appends header and frame lines, a folder for each day. A batch's lines stand together in one of the day's FILES files at most."""
    h = headers.select("day", "batch_id", F.lit(0).cast("long").alias("_s"), F.to_json(F.struct(*HEADER_KEYS)).alias("value"))
    f = frames.select("day", "batch_id", F.col("sequence").alias("_s"), F.to_json(F.struct("batch_id", "sequence", "scope", "target_id", "privacy_class", "record_id", F.col("line").alias("record"))).alias("value"))
    lines = h.unionByName(f).repartition("day", F.pmod(F.xxhash64("batch_id"), F.lit(FILES))).sortWithinPartitions("day", "batch_id", "_s")
    lines.select(F.col("day").alias("p_day"), "value").write.mode("append").partitionBy("p_day").text(path)


def scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, frames, bad lines) of segment files: lines told apart by their keys, rejected ones by code only."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    keys = F.array_sort(F.json_object_keys("value"))
    is_header, is_frame = (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in names]))) == 0 for names in (HEADER_KEYS, FRAME_KEYS))
    kind = F.when(keys.isNull(), "bad").when(F.array_contains(keys, "record") & is_frame, "frame").when(F.array_contains(keys, "content_sha256") & is_header, "header").otherwise("bad")
    lines = raw.withColumn("kind", kind)
    parse = lambda k, s: lines.where(F.col("kind") == k).select("file", F.from_json("value", s).alias("x")).select("file", "x.*")
    return parse("header", HEADER), parse("frame", FRAME).withColumnRenamed("record", "line"), lines.where("kind = 'bad'").select("file", F.lit("OL_SEGMENT_LINE").alias("code"))


def audit(headers: DataFrame, frames: DataFrame) -> DataFrame:
    """(batch_id, code): null for a batch whose frames agree with its header, else the first that fails."""
    got = content_digest(frames).withColumnsRenamed({"content_sha256": "got_sha256", "record_count": "got_count"})
    agree = frames.alias("f").join(headers.alias("h"), "batch_id").groupBy("batch_id").agg(F.min(F.col("f.scope").eqNullSafe(F.col("h.scope")) & F.col("f.target_id").eqNullSafe(F.col("h.target_id")) & F.col("f.privacy_class").eqNullSafe(F.col("h.privacy_class"))).alias("agree"))
    out = headers.join(got, "batch_id", "full_outer").join(agree, "batch_id", "left").join(contiguous(frames), "batch_id", "left")
    code = (
        F.when(F.col("record_count").isNull(), "OL_SEGMENT_HEADER").when(F.coalesce("got_count", F.lit(0)) != F.col("record_count"), "OL_SEGMENT_COUNT").when(F.col("record_count") == 0, None).when(~F.col("agree"), "OL_SEGMENT_FRAME")
        .when(~F.col("contiguous"), "OL_SEGMENT_SEQUENCE").when(F.col("got_sha256") != F.col("content_sha256"), "OL_SEGMENT_DIGEST")
    )
    return out.select("batch_id", code.alias("code"))


def trusted(headers: DataFrame, frames: DataFrame, identity_ok: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Headers and frames of the batches without any fault; identity_ok is a condition over a frame."""
    bad = audit(headers, frames).where("code IS NOT NULL").select("batch_id")
    if identity_ok is not None:
        bad = bad.unionByName(frames.where(~F.coalesce(identity_ok, F.lit(False))).select("batch_id")).distinct()
    return headers.join(bad, "batch_id", "left_anti"), frames.join(bad, "batch_id", "left_anti")


def commit(headers: DataFrame, frames: DataFrame, exporters: list[str], committed_at, root: str) -> int:
    """Writes batches that the ledger lacks: lines first, then ledger rows, then a pending delivery for each exporter. Returns their number.

    A crash after the lines leaves orphans that reconciliation adopts; a second commit of a batch does nothing.
    """
    spark = headers.sparkSession
    known = read_table(spark, f"{root}/ledger", "batch_id STRING")
    new = headers.join(known.select("batch_id"), "batch_id", "left_anti").persist()
    try:
        n = new.count()
        if n:
            write(new, frames.join(new.select("batch_id"), "batch_id", "left_semi"), f"{root}/lines")
            new.withColumns({"committed_at": F.lit(committed_at).cast("timestamp"), "origin": F.lit("committed")}).write.mode("append").parquet(f"{root}/ledger")
            pending = new.select("batch_id", F.explode(F.array(*[F.lit(e) for e in exporters])).alias("exporter_id"), F.lit("pending").alias("delivery_status"))
            pending.write.mode("append").parquet(f"{root}/deliveries")
        return n
    finally:
        new.unpersist()


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where nothing was written yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else spark.createDataFrame([], schema)


def verified(ledger: DataFrame, headers: DataFrame, frames: DataFrame) -> DataFrame:
    """(batch_id, intact, code) of every batch of the ledger; one bad batch hides no other."""
    lost = ledger.join(headers.select("batch_id"), "batch_id", "left_anti").select("batch_id", F.lit("OL_SEGMENT_MISSING").alias("code"))
    drift = ledger.alias("l").join(headers.alias("h"), "batch_id").where(~F.col("l.content_sha256").eqNullSafe(F.col("h.content_sha256")) | ~F.col("l.record_count").eqNullSafe(F.col("h.record_count"))).select("batch_id", F.lit("OL_SEGMENT_LEDGER").alias("code"))
    own = audit(headers, frames).where("code IS NOT NULL")
    found = lost.unionByName(drift).unionByName(own).groupBy("batch_id").agg(F.min("code").alias("code"))
    out = ledger.select("batch_id").join(found, "batch_id", "left")
    return out.select("batch_id", F.col("code").isNull().alias("intact"), "code")


#: what a record shows without its payload
METADATA = "record_id STRING, record_type STRING, name STRING, occurred_at STRING, severity STRING"


def record_metadata(headers: DataFrame, frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata of the records, skipped batches with their code): a row a record of the readable segments, never its payload.

    One unreadable segment hides no other: it is skipped and told. Of a record only the METADATA fields are parsed; a line that is no
    object gives a row with nulls.
    """
    faults = audit(headers, frames).where("code IS NOT NULL")
    good = frames.join(faults.select("batch_id"), "batch_id", "left_anti")
    kept = headers.select("batch_id", "day", F.col("retention_days").alias("retention_days"))
    out = good.join(kept, "batch_id").withColumn("m", F.from_json("line", METADATA)).select("batch_id", "sequence", "day", "scope", "target_id", "privacy_class", F.coalesce("record_id", "m.record_id").alias("record_id"), "m.record_type", "m.name", "m.occurred_at", "m.severity", "retention_days")
    return out, faults
