"""Connected components by contraction over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.runtime import packed, written

#: Edges that a task contracts at a time.
CHUNK_EDGES = 1 << 20


def lowest_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges ``u, v`` and for each the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    parent = np.arange(len(nodes))
    while True:
        while (parent[parent] != parent).any():
            parent = parent[parent]
        p, q = parent[a], parent[b]
        if (p == q).all():
            return nodes, nodes[parent]
        np.minimum.at(parent, np.maximum(p, q), np.minimum(p, q))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars around the smallest nodes, CHUNK_EDGES at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def stars() -> pa.RecordBatch:
        nodes, roots = lowest_labels(*(np.concatenate(c) for c in zip(*held, strict=True)))
        apart = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(roots[apart])], names=["u", "v"])

    for batch in batches:
        for lo in range(0, batch.num_rows, CHUNK_EDGES):
            part = batch.slice(lo, CHUNK_EDGES)
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy()))
            if sum(len(u) for u, _ in held) >= CHUNK_EDGES:
                yield stars()
                held = []
    if held:
        yield stars()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``, whole numbers, as ``(node, root)``, root the smallest node.

    Large-star and small-star contraction in turn, where each node links to the smallest node around it; every task
    first replaces its own edges by stars. Rounds grow with the logarithm of the longest chain; each is a grouped
    minimum and a join, and its result is written to the shared folder. A hub's neighbours meet in a minimum that is
    combined map-side, never in a collected list.
    """
    pair, local = ["u", "v"], "u long, v long"
    ends = [f("a", "b").cast("long").alias(c) for f, c in ((F.greatest, "u"), (F.least, "v"))]
    cur = written(packed(edges.select(*ends).where("u <> v").mapInArrow(_stars, local)), name)
    while not _settled(cur):
        both = cur.select(*pair).union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join is of two plain shuffles and a hub's rows can be split.
        low = written(packed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))), name)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(packed(large.mapInArrow(_stars, local).distinct()), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        cur = written(packed(small), name)
    roots = cur.select(F.col("v").alias("node")).distinct()
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: every ``u`` has one ``v``, which is no other edge's ``u``."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()
