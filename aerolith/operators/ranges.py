"""Static ranges of work: the sizes that a prefix sum gives, remainder to the first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ranges(spark: SparkSession, total: DataFrame, column: str, parts: int) -> DataFrame:
    """``part, start, stop`` for ``parts`` ranges over the row's count."""
    n, k = F.col(column), F.col("part")
    size, extra = F.floor(n / parts), n % parts
    rows = total.select(column, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    start = k * size + F.least(k, extra)
    return rows.select("part", start.cast("long").alias("start"), (start + size + F.when(k < extra, 1).otherwise(0)).cast("long").alias("stop"))
