"""Row numbers of groups of any size: range partitions and prefix sums of their counts, no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..sources.adapters import shared_folder

AT, PART, FIRST, BEFORE = "__ob_at", "__ob_part", "__ob_first", "__ob_before"


def numbered(df: DataFrame, groups: list[str], order: list[str | Column], name: str = "n") -> DataFrame:
    """df with `name`: 1, 2, 3 and so on by the order, in each group (null is a group of its own) or, without groups, over all rows.

    The rows are dealt out in ranges of (groups, order) and sorted there, so a group of many rows spans many tasks;
    a row's number is its place in its range plus the group's rows in the ranges before it. That leaves a small table,
    a row for each range and group in it, for the prefix sum. The order should tell rows apart: rows that it leaves
    equal are numbered in any order and share a range.
    """
    keys = [*groups, *order]
    shared_folder(df.sparkSession, "numbering")  # makes sure that checkpoints have a folder that all executors reach
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(AT, F.monotonically_increasing_id()).checkpoint()
    ranged = ranged.withColumn(PART, F.shiftright(AT, 33))
    there = ranged.groupBy(PART, *groups).agg(F.min(AT).alias(FIRST), F.count(F.lit(1)).alias("__ob_n"))
    earlier = W.partitionBy(*(groups or [F.lit(0)])).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    there = there.withColumn(BEFORE, F.coalesce(F.sum("__ob_n").over(earlier), F.lit(0)))
    same = F.col(f"r.{PART}") == F.col(f"t.{PART}")
    for g in groups:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}"))
    number = (F.col(f"r.{AT}") - F.col(f"t.{FIRST}") + F.col(f"t.{BEFORE}") + 1).cast("long")
    return ranged.alias("r").join(there.alias("t"), same).select(*[F.col(f"r.{c}") for c in df.columns if c != name], number.alias(name))
