"""The shared folder and tables written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that ``scratch`` has named, by the application that may remove them.
_MADE: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset a run in one process (tests) takes a
    local folder, which goes when the process ends; on a cluster it is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir")
    if not where:
        current = sc._jsc.sc().getCheckpointDir()
        where = current.get() if current.isDefined() else None
    if not where:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="aerolith-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        where = "file://" + folder
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name inside the shared folder."""
    path = f"{shared_dir(spark)}/aerolith-{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Remove what this application has written to the shared folder, once nothing reads it any more; the number of
    folders removed. Results that are still to be computed from written tables must be stored before."""
    sc, removed = spark.sparkContext, 0
    for path in _MADE.pop(sc.applicationId, []):
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        removed += bool(place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True))
    return removed


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and a lost executor costs
    a re-read, not a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """``df``, what comes out of a shuffle, for writing: where Spark does not merge small partitions itself, its rows are
    dealt out to as many tasks as there are cores. The partitions are computed as they are, but no longer make a file
    each; on a local file system without Hadoop's native library each file costs an executor two processes, which for a
    moment double the memory it seems to hold."""
    spark = df.sparkSession
    merges = all(spark.conf.get(f"spark.sql.adaptive.{k}").lower() == "true" for k in ("enabled", "coalescePartitions.enabled"))
    cores = spark.sparkContext.defaultParallelism
    return df if merges or int(spark.conf.get("spark.sql.shuffle.partitions")) <= cores else df.repartition(cores)


def ordered_ids(df: DataFrame, order: str, out: str) -> DataFrame:
    """Add ``out``: 0, 1, 2, ... in the order of the unique column ``order``. The table is sorted by range over
    all tasks and written once with its partition number; a partition then counts on from those before it."""
    rows = written(df.orderBy(order).withColumn("__pid", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "ordered")
    first = rows.groupBy("__pid").agg(F.count("*").alias("__n"), F.min("__seq").alias("__first"))
    starts, at = [], 0
    for r in sorted(first.collect()):  # a row for each partition
        starts.append((r[0], at - r[2]))
        at += r[1]
    base = df.sparkSession.createDataFrame(starts, "__pid int, __shift long")
    return rows.join(F.broadcast(base), "__pid").withColumn(out, F.col("__seq") + F.col("__shift")).drop("__pid", "__seq", "__shift")


def upper_medians(df: DataFrame, columns: list[str]) -> list[float | None]:
    """The upper of the two middle values of each column (the middle one for an odd count), nulls left out; null where
    there is none. All columns are sorted by range in one pass, and the ranks are picked by the counts of the
    partitions, so no task sees all values."""
    values = [df.select(F.lit(k).alias("kind"), F.col(c).cast("double").alias("value")).where(F.col("value").isNotNull()) for k, c in enumerate(columns)]
    rows = values[0]
    for more in values[1:]:
        rows = rows.union(more)
    rows = rows.repartitionByRange("kind", "value").sortWithinPartitions("kind", "value")
    rows = written(rows.withColumn("pid", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()), "medians")
    parts: dict[int, list[tuple[int, int, int]]] = {}
    for kind, pid, n, first in rows.groupBy("kind", "pid").agg(F.count("*"), F.min("seq")).collect():  # a row for each partition
        parts.setdefault(kind, []).append((pid, n, first))
    wanted = {}
    for kind, found in parts.items():
        rank = sum(n for _, n, _ in found) // 2
        for _, n, first in sorted(found):
            if rank < n:
                wanted[first + rank] = kind
                break
            rank -= n
    out: list[float | None] = [None] * len(columns)
    for kind, value in rows.where(F.col("seq").isin(list(wanted))).select("kind", "value").collect() if wanted else []:
        out[kind] = value
    return out
