"""Shared helpers: gapless ranks over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.operators.graph import components
from aerolith.runtime import packed, scratch, shared_dir, written

__all__ = ["components", "gapless", "numbered", "packed", "scratch", "shared_dir", "written"]


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``written`` plus ``__pid`` (the writing partition) and ``__seq`` (order in it), stored as data so that
    every later read sees the same values."""
    return written(df.withColumn("__pid", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), name)


def gapless(df: DataFrame, group: str, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... within each value of ``group``, for a ``numbered`` table. A group is ranked
    per writing partition and shifted by the counts of the partitions before it, so no task sees a whole
    group however many of the rows it holds."""
    counts = df.groupBy(group, "__pid").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    local = F.row_number().over(Window.partitionBy(group, "__pid").orderBy("__seq"))
    return df.withColumn("__local", local).join(base, [group, "__pid"]).withColumn(out, F.col("__base") + F.col("__local") - 1).drop("__local", "__base")
