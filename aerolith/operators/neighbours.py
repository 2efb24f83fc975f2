"""Neighbour search: k nearest images, and the pairs they propose."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith.config import DEFAULT
from aerolith.runtime import written

#: A cell is halved until its fullest one holds no more than this many times k points.
FULLEST = 32
PLACES = 6
#: Pairs of a place and a point that meet in one task, about.
TASK_PAIRS = 1_000_000


def _cells(df: DataFrame, size: float) -> DataFrame:
    return df.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))


def nearest(points: DataFrame, k: int = DEFAULT.neighbours) -> DataFrame:
    """``id, neighbour_id, rank, distance`` of the k nearest other points, ties to the lower id; all others where
    there are fewer than k. ``points`` has ``id, x, y``.

    Places meet only points of the nine grid cells around them. A place whose k + 1 nearest points, its own among
    them, lie closer than the edge of those cells is done; the others go on with cells of twice the size. A point's
    neighbours are its place's nearest points without itself. Cells start small enough that the fullest holds a
    bounded number of points. Of points in one place only the k + 1 lowest ids can be anyone's neighbours, so places
    with many points are thinned first.
    """
    points = written(points.select("id", "x", "y").where("x is not null and y is not null"), "points")
    place = Window.partitionBy("x", "y").orderBy("id")
    others = written(points.withColumn("at", F.row_number().over(place)).where(F.col("at") <= k + 1).drop("at"), "candidates")
    n, x0, x1, y0, y1 = others.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    spark = points.sparkSession
    if not n:
        return spark.createDataFrame([], "id long, neighbour_id long, rank int, distance double")
    extent = max(x1 - x0, y1 - y0, 1e-3)
    size = max(extent * math.sqrt((k + 1) / n), extent * 2.0**-40)
    while size > extent * 2.0**-40 and _cells(others, size).groupBy("gx", "gy").count().agg(F.max("count")).first()[0] > FULLEST * (k + 1):
        size /= 2
    todo, found = others.select("x", "y").distinct(), None
    distance = F.round(F.sqrt(F.pow(F.col("p.x") - F.col("q.x"), 2) + F.pow(F.col("p.y") - F.col("q.y"), 2)), PLACES)
    around = F.expr("explode(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> struct(gx + i AS gx, gy + j AS gy)))))")
    while True:
        last = size > extent
        asked = _cells(todo, size).withColumn("cell", around).select("x", "y", "cell.gx", "cell.gy")
        held = _cells(others, size)
        # As many tasks as bound the pairs of each; Spark doesn't merge partitions whose number is given.
        counts = (df.groupBy("gx", "gy").agg(F.count("*").alias(c)) for df, c in ((asked, "n"), (held, "m")))
        pairs = next(counts).join(next(counts), ["gx", "gy"]).agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        tasks = max(spark.sparkContext.defaultParallelism, -(-pairs // TASK_PAIRS))
        met = asked.repartition(tasks, "gx", "gy").alias("p").join(held.repartition(tasks, "gx", "gy").alias("q"), (F.col("p.gx") == F.col("q.gx")) & (F.col("p.gy") == F.col("q.gy")))
        met = met.select("p.x", "p.y", "q.id", distance.alias("distance"))
        order = Window.partitionBy("x", "y").orderBy("distance", "id")
        best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
        lists = best.groupBy("x", "y").agg(F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("near"))
        best = written(lists, "nearest")
        done = best if last else best.where((F.size("near") == k + 1) & (F.col("near")[k]["distance"] < size - 2 * 10.0**-PLACES))
        found = done if found is None else found.union(done)
        if last:
            break
        todo = written(todo.join(done.select("x", "y"), ["x", "y"], "left_anti"), "open")
        if todo.isEmpty():
            break
        size *= 2
    mine = F.slice(F.filter("near", lambda q: q["id"] != F.col("id")), 1, k)
    out = points.join(found, ["x", "y"]).select("id", F.posexplode(mine).alias("at", "q"))
    return out.select("id", F.col("q.id").alias("neighbour_id"), (F.col("at") + 1).cast("int").alias("rank"), "q.distance")


def proposed_pairs(neighbours: DataFrame) -> DataFrame:
    """Each neighbour relation once, as ``img_lhs < img_rhs``."""
    return neighbours.select(F.least("id", "neighbour_id").alias("img_lhs"), F.greatest("id", "neighbour_id").alias("img_rhs")).distinct()


def pair_degree(pairs: DataFrame) -> DataFrame:
    """Pairs per image, either side."""
    ends = pairs.select(F.explode(F.array("img_lhs", "img_rhs")).alias("image_id"))
    return ends.groupBy("image_id").agg(F.count("*").alias("degree"))


def pair_batches(pairs: DataFrame) -> DataFrame:
    """One batch per left image, so that its features are loaded once."""
    return pairs.groupBy("img_lhs").agg(F.count("*").alias("n_pairs"), F.min("img_rhs").alias("first_rhs"), F.max("img_rhs").alias("last_rhs"))
