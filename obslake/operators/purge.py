"""Removal of one target from tables on disk, against a confirmed manifest, with proof and an audit row.

Tables are folders of Parquet, parted by one column. Only the partitions that hold the target are rewritten: what stays of
them is staged in full before anything is replaced, so a failure before that changes nothing, and one after it is made good by
the same call again. The target's rows are counted in the pass that reads the rewritten tables for the audit row; no
record id, and no name of the target, goes into that row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

AUDIT = "action string, actor string, resource string, manifest_digest string, n_tables bigint, n_partitions bigint, n_rows bigint, n_left bigint, outcome string"


def _of(df: DataFrame, target: str):
    return df["target_id"].eqNullSafe(F.lit(target))


def manifest(tables: dict[str, DataFrame], target: str, part: str) -> DataFrame:
    """(table_name, part, n_rows, ids_digest) of the target's rows by partition. The digest is a sum of hashes: it needs no order."""
    out = None
    for name, df in sorted(tables.items()):
        rows = df.where(_of(df, target)).groupBy(F.col(part).cast("string").alias("part")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.sum(F.xxhash64("record_id").cast("decimal(38,0)")).cast("string").alias("ids_digest"))
        rows = rows.select(F.lit(name).alias("table_name"), "part", "n_rows", "ids_digest")
        out = rows if out is None else out.unionByName(rows)
    return out


def digest_of(rows: DataFrame) -> str:
    """One digest of a manifest, as text; it is what a purge has to be confirmed with."""
    one = F.sha2(F.to_json(F.struct("table_name", "part", "n_rows", "ids_digest"), {"ignoreNullFields": "false"}), 256)
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.conv(F.substring(one, 1, 15), 16, 10).cast("decimal(38,0)")).alias("a"), F.sum(F.conv(F.substring(one, 16, 15), 16, 10).cast("decimal(38,0)")).alias("b")).first()
    return f"{got['n']}-{int(got['a'] or 0):x}-{int(got['b'] or 0):x}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _table(spark: SparkSession, folder: str, part: str) -> DataFrame:
    """A table with its partition's value as the text that its folder has: a value read as a date would be written to another folder."""
    kinds = spark.read.parquet(folder).schema
    return spark.read.schema(StructType([StructField(f.name, StringType() if f.name == part else f.dataType) for f in kinds])).parquet(folder)


def _folder(value: str | None) -> str:
    """A partition's folder name as Spark writes it for plain values; others are refused rather than missed."""
    if value is not None and not all(c.isalnum() or c in "-_." for c in value):
        raise ValueError("OL_PURGE_PARTITION")
    return "__HIVE_DEFAULT_PARTITION__" if value is None else value


def purge(spark: SparkSession, root: str, names: list[str], target: str, confirm: str, part: str = "day", actor: str = "operator") -> DataFrame:
    """Removes the target from the tables root/<name> and appends to root/audit; returns the audit row. confirm: the digest of the present manifest.

    Code OL_PURGE_STALE where the rows are no longer those that were confirmed. A purge that stopped half way may be called again with
    its own digest: what it removed by then is gone, and the rest goes now.
    """
    read = lambda n: _table(spark, f"{root}/{n}", part)
    tables = {n: read(n) for n in sorted(names)}
    rows = manifest(tables, target, part).persist()
    base = f"{root}/purge-{uuid.uuid4().hex}"
    try:
        started = spark.read.schema("confirm string").json(f"{root}/purges") if _there(spark, f"{root}/purges") else None
        again = started is not None and not started.where(F.col("confirm") == confirm).isEmpty()
        if digest_of(rows) != confirm and not again:
            raise ValueError("OL_PURGE_STALE")
        spark.range(1).select(F.lit(confirm).alias("confirm")).write.mode("append").json(f"{root}/purges")
        touched = rows.select("table_name", "part").distinct()
        for name, df in tables.items():
            here = touched.where(F.col("table_name") == name).select(F.col("part").alias("_p"))
            stay = df.where(~_of(df, target)).join(here, F.col(part).cast("string").eqNullSafe(F.col("_p")), "left_semi")
            stay.write.partitionBy(part).parquet(f"{base}/{name}")
        totals = rows.agg(F.countDistinct("table_name", F.coalesce("part", F.lit(""))).alias("p"), F.sum("n_rows").alias("n")).first()
        for name, df in tables.items():
            staged = spark.read.schema(df.schema).parquet(f"{base}/{name}")
            staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(f"{root}/{name}")
            full = staged.select(F.col(part).cast("string").alias("_p")).distinct()
            empty = touched.where(F.col("table_name") == name).join(full, F.col("part").eqNullSafe(F.col("_p")), "left_anti")
            for r in empty.toLocalIterator():  # names of partitions that held the target only
                _remove(spark, f"{root}/{name}/{part}={_folder(r['part'])}")
        left = None
        for name in tables:
            now = read(name)
            n = now.where(_of(now, target)).agg(F.count(F.lit(1)).alias("n"))
            left = n if left is None else left.unionByName(n)
        n_left = F.sum("n")
        audit = left.agg(
            F.lit("target.purge").alias("action"), F.lit(actor).alias("actor"), F.sha2(F.lit(target), 256).alias("resource"), F.lit(confirm).alias("manifest_digest"), F.lit(len(tables)).cast("long").alias("n_tables"),
            F.lit(totals["p"] or 0).cast("long").alias("n_partitions"), F.lit(totals["n"] or 0).cast("long").alias("n_rows"), n_left.alias("n_left"), F.when(n_left == 0, "success").otherwise("failure").alias("outcome"),
        )
        audit.write.mode("append").parquet(f"{root}/audit")
        return spark.read.parquet(f"{root}/audit").where(F.col("manifest_digest") == confirm)
    finally:
        rows.unpersist()
        _remove(spark, base)


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
