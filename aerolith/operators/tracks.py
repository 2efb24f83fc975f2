"""Multi-view tracks: components of the match graph, and components with one point per image."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.operators.graph import components
from aerolith.runtime import written

#: A component of up to this many edges is split inside one task.
TASK_EDGES = 50_000


def edge_weights(links: DataFrame) -> DataFrame:
    """One edge ``a < b`` for each linked pair of points, weighing the highest of its scores."""
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").groupBy("a", "b").agg(F.max("score").alias("score"))


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b", "score").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"))


def tracks(edges: DataFrame) -> DataFrame:
    """``track_id, node``: a track is a component, named by its smallest node."""
    return components(edges, "tracks").select(F.col("root").alias("track_id"), "node")


def conflicts(track_nodes: DataFrame, image_of: str) -> DataFrame:
    """Images with several points in one track."""
    return track_nodes.groupBy("track_id", F.expr(image_of).alias("image_id")).agg(F.count("*").alias("n_points")).where("n_points > 1")


def _greedy(frame: pd.DataFrame) -> pd.DataFrame:
    """Union edges in order unless two points of one image would meet."""
    parent: dict[int, int] = {}
    images: dict[int, set[int]] = {}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for node, image in {**dict(zip(frame.a, frame.ia, strict=True)), **dict(zip(frame.b, frame.ib, strict=True))}.items():
        parent[node], images[node] = node, {image}
    ordered = frame.sort_values(["score", "a", "b"], ascending=[False, True, True])
    for a, b in zip(ordered.a.tolist(), ordered.b.tolist(), strict=True):
        p, q = find(a), find(b)
        if p != q and images[p].isdisjoint(images[q]):
            low, high = min(p, q), max(p, q)
            parent[high] = low
            images[low] |= images.pop(high)
    return pd.DataFrame({"track_id": [find(n) for n in parent], "node": list(parent)}, dtype="int64")


def _rounds(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same result for components too large for a task. Edges whose clusters share an image go at once, as clusters
    only grow. Of the others one that comes first among all edges of both its clusters meets them just as it would in
    the whole order, so all such edges join their clusters in one round. ``edges(a, b, score)``,
    ``nodes(node, image)``."""
    member = written(nodes.select("node", F.col("node").alias("cluster"), "image"), "member")
    edges = edges.select("a", "b", "score", F.col("a").alias("p"), F.col("b").alias("q"))
    while True:
        images = member.select("cluster", "image")
        named = written(edges, "named")
        shared = named.select("p", "q").distinct().join(images.withColumnRenamed("cluster", "p"), "p").join(images.withColumnRenamed("cluster", "q"), ["q", "image"]).select("p", "q").distinct()
        open_edges = written(named.join(shared, ["p", "q"], "left_anti"), "open")
        ends = open_edges.select("p", "q", F.struct((-F.col("score")).alias("s"), "a", "b").alias("e"))
        first = ends.select(F.col("p").alias("c"), "e").union(ends.select(F.col("q").alias("c"), "e")).groupBy("c").agg(F.min("e").alias("e"))
        mine = ends.join(first.select(F.col("c").alias("p"), F.col("e").alias("ep")), "p").join(first.select(F.col("c").alias("q"), F.col("e").alias("eq")), "q").where("e = ep AND e = eq")
        moved = written(mine.select(F.greatest("p", "q").alias("old"), F.least("p", "q").alias("new")), "moved")
        if moved.isEmpty():
            break
        rename = lambda df, c: df.join(moved.withColumnRenamed("old", c), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")  # noqa: B023, E731
        member = written(rename(member, "cluster"), "member")
        edges = rename(rename(open_edges, "p"), "q").where("p <> q")
    low = member.groupBy("cluster").agg(F.min("node").alias("track_id"))
    return member.join(low, "cluster").select("track_id", "node")


def conflict_free_tracks(edges: DataFrame, image_of: str, task_edges: int = TASK_EDGES) -> DataFrame:
    """Tracks with at most one point per image: edges by falling score (ties by ends) join clusters unless these
    share an image. ``image_of`` gives a point's image from ``node``. Components of up to ``task_edges`` edges are
    dealt over tasks, several to each; larger ones are settled in distributed rounds."""
    image = lambda c: F.expr(image_of.replace("node", c))
    edges = written(edges.select("a", "b", "score"), "weighted")
    root = components(edges, "tracks")
    sized = edges.join(root.select(F.col("node").alias("a"), "root"), "a")
    counts = written(sized.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    total = counts.agg(F.sum("n")).first()[0] or 0
    sized = sized.join(counts, "root")
    deal = max(1, -(-total // max(task_edges, 1)))
    small = sized.where(F.col("n") <= task_edges).select("a", "b", "score", image("a").alias("ia"), image("b").alias("ib"), F.pmod(F.xxhash64("root"), F.lit(deal)).alias("task"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _greedy(frame)

    out = small.groupBy("task").applyInPandas(run, "track_id long, node long")
    large = counts.where(F.col("n") > task_edges)
    if large.isEmpty():
        return out
    rest = sized.where(F.col("n") > task_edges)
    nodes = root.join(large, "root").select("node", image("node").alias("image"))
    return out.union(_rounds(rest, nodes))


