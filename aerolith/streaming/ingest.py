"""Incremental listing: new image files of a folder, batch by batch, appended to a metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from aerolith.sources import images

LISTING = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of valid image files as they arrive."""
    return spark.readStream.format("binaryFile").schema(LISTING).load(folder).where(images.valid_extension(F.col("path"))).select("path", "length", "modificationTime")


def start(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Append the paths of new files to ``out`` until the folder holds nothing new."""
    return new_files(spark, folder).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
