"""Mosaic: the graph of image placements, and its contraction star by star."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import geo, mat, raster
from aerolith.sources import store


def out_degree(edges: DataFrame, priority: int = 0) -> DataFrame:
    """Edges of ``priority`` that leave each node."""
    return edges.groupBy("src").agg(F.count_if(F.col("priority") == priority).alias("degree"))


def hub(edges: DataFrame, priority: int = 0) -> DataFrame:
    """The node of highest degree, ties to the smallest; no row where no edge has the priority."""
    best = out_degree(edges, priority).where("degree > 0").agg(F.max(F.struct("degree", (-F.col("src")).alias("low"))).alias("m"))
    return best.where("m IS NOT NULL").select((-F.col("m.low")).alias("src"), F.col("m.degree").alias("degree"))


def canvas_box(edges: DataFrame, width: float, height: float) -> DataFrame:
    """Per source node the integer box of its own corners and its neighbours' corners moved by (dx, dy)."""
    corners = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1))))
    own = edges.select("src", F.explode(corners).alias("p")).select("src", "p.x", "p.y")
    moved = edges.select("src", "dx", "dy", F.explode(corners).alias("p")).select("src", geo.abs_ceil(F.col("p.x") + F.col("dx")).alias("x"), geo.abs_ceil(F.col("p.y") + F.col("dy")).alias("y"))
    return own.union(moved).groupBy("src").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))


def two_hop(edges: DataFrame) -> DataFrame:
    """Placements i -> l through j, where i has no edge to l: the shifts add up, the priority rises by one. Of
    several ways the one of lowest (priority, j) counts."""
    first, second = edges.select("src", F.col("dst").alias("mid"), "dx", "dy"), edges.select(F.col("src").alias("mid"), "dst", F.col("dx").alias("ex"), F.col("dy").alias("ey"), "priority")
    ways = first.join(second, "mid").where("src <> dst").join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    best = ways.groupBy("src", "dst").agg(F.min(F.struct("priority", "mid", F.expr("dx + ex").alias("dx"), F.expr("dy + ey").alias("dy"))).alias("w"))
    return best.select("src", "dst", F.col("w.mid").alias("mid"), "w.dx", "w.dy", (F.col("w.priority") + 1).alias("priority"))


def two_hop_matrices(edges: DataFrame) -> DataFrame:
    """``two_hop`` for placements by a 3x3 matrix ``m`` (row-major array, from the pixels of ``src`` to those of ``dst``):
    the matrices multiply."""
    first, second = edges.select("src", F.col("dst").alias("mid"), F.col("m").alias("m1")), edges.select(F.col("src").alias("mid"), "dst", F.col("m").alias("m2"), "priority")
    ways = first.join(second, "mid").where("src <> dst").join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    entries = lambda c: [[F.col(c)[3 * i + j] for j in range(3)] for i in range(3)]
    product = F.array(*(mat.num(x) for row in mat.mul(entries("m2"), entries("m1")) for x in row))
    best = ways.groupBy("src", "dst").agg(F.min(F.struct("priority", "mid", product.alias("m"))).alias("w"))
    return best.select("src", "dst", F.col("w.mid").alias("mid"), "w.m", (F.col("w.priority") + 1).alias("priority"))


class Memory:
    """Pixels of a mosaic's nodes in this process."""

    def __init__(self, nodes: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.nodes = dict(nodes)

    def stitch(self, out: int, centre: int, around: list[tuple[int, np.ndarray]], priority: int) -> np.ndarray:
        self.nodes[out], corner = stitch_star(self.nodes[centre], [(self.nodes[j], m) for j, m in around])
        return corner


class Stored:
    """Pixels of a mosaic's nodes in a folder that driver and executors share: ``{node}.npz``. A star is stitched in a
    task, which reads the images around it one by one and writes the new node, and beside it the partial mosaic
    ``p{priority}-i{node}.png`` with its ``_mask``; the driver holds no pixels."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def load(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        fs, path = store.place(f"{self.folder}/{node}.npz")
        with fs.open_input_file(path) as f, np.load(io.BytesIO(f.read())) as z:
            return z["img"], z["mask"]

    def save(self, node: int, img: np.ndarray, mask: np.ndarray) -> None:
        data = io.BytesIO()
        np.savez_compressed(data, img=img, mask=mask)
        store.write_bytes(data.getvalue(), f"{self.folder}/{node}.npz")

    def put(self, images: DataFrame) -> list[int]:
        """Store rectified images (``image_id, height, width, nChannels, data, mask``) from their tasks; their ids."""
        folder = self.folder

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = Stored(None, folder)
            for f in frames:
                for r in f.itertuples():
                    mine.save(r.image_id, np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels), np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width))
                yield f[["image_id"]]

        return sorted(r.image_id for r in images.select("image_id", "height", "width", "nChannels", "data", "mask").mapInPandas(run, "image_id long").collect())

    def stitch(self, out: int, centre: int, around: list[tuple[int, np.ndarray]], priority: int) -> np.ndarray:
        folder = self.folder

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            mine = Stored(None, folder)
            for f in frames:
                if len(f):
                    (img, mask), corner = stitch_star(mine.load(centre), ((mine.load(j), m) for j, m in around), lambda j: mine.load(j)[0].shape, around)
                    mine.save(out, img, mask)
                    for name, pixels in (("", img), ("_mask", mask)):
                        store.write_image(pixels, f"{folder}/p{priority}-i{out}{name}.png")
                    yield pd.DataFrame({"x": [int(corner[0])], "y": [int(corner[1])]})

        (r,) = self.spark.range(1, numPartitions=1).mapInPandas(run, "x long, y long").collect()
        return np.array([r.x, r.y])


class Mosaic:
    """Contraction of a placement graph. The graph (one node per image) stays on the driver; pixels are where ``nodes``
    keeps them: a dictionary id -> (image, mask), or ``Stored`` with the ids given.

    ``edges``: (i, j) -> 3x3 matrix from i's pixels to j's.
    """

    def __init__(self, nodes: dict[int, tuple[np.ndarray, np.ndarray]] | Stored, edges: dict[tuple[int, int], np.ndarray], ids: list[int] | None = None) -> None:
        ids = list(nodes) if ids is None else ids
        if not ids:
            raise ValueError("no image")
        self.pixels = nodes if isinstance(nodes, Stored) else Memory(nodes)
        self.edges: dict[int, dict[int, tuple[np.ndarray, int]]] = {}
        for (i, j), m in edges.items():
            self.edges.setdefault(i, {})[j] = (m, 0)
            self.edges.setdefault(j, {})[i] = (np.linalg.inv(m), 0)
        self.last, self.many = max(ids), len(ids)

    def hub(self, priority: int) -> int | None:
        degree = {i: sum(p == priority for _, p in out.values()) for i, out in self.edges.items()}
        best = max(degree.values(), default=0)
        return min(i for i, d in degree.items() if d == best) if best else None

    def contract(self) -> int:
        """Stitch star after star; the node of the last one."""
        priority = 0
        i = self.hub(priority)
        while len(self.edges) > 1 and i is not None:
            around = {j: m for j, (m, _) in self.edges[i].items()}
            self.last += 1
            self.many += 1
            p = self.last
            corner = self.pixels.stitch(p, i, [(j, np.linalg.inv(m)) for j, m in sorted(around.items())], priority)
            place = np.array([[1, 0, corner[0]], [0, 1, corner[1]], [0, 0, 1]], float)
            far: dict[int, tuple[np.ndarray, int]] = {}
            for j in sorted(around):
                for k, (m, q) in sorted(self.edges.get(j, {}).items()):
                    if k != i and k not in around and k not in far:
                        far[k] = m @ around[j] @ place, q + 1
            gone = {i, *around}
            self.edges = {a: {b: e for b, e in out.items() if b not in gone} for a, out in self.edges.items() if a not in gone}
            for k, (m, q) in far.items():
                self.edges.setdefault(p, {})[k] = (m, q)
                self.edges.setdefault(k, {})[p] = (np.linalg.inv(m), q)
            self.edges = {a: out for a, out in self.edges.items() if out}
            i = self.hub(priority)
            while i is None and self.edges and priority <= self.many:
                priority += 1
                i = self.hub(priority)
        return self.last

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """The image and mask of the last star."""
        last = self.contract()
        return self.pixels.load(last) if isinstance(self.pixels, Stored) else self.pixels.nodes[last]


def stitch_star(centre: tuple[np.ndarray, np.ndarray], around: Iterable[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]], shape_of: Callable | None = None, keys: list | None = None) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The centre with its neighbours warped onto it by their matrices, and the canvas corner in the centre's pixels.
    Where ``around`` is read as it goes, ``shape_of`` gives the shapes of ``keys`` (node, matrix) before."""

    def corners(shape):
        h, w = shape[:2]
        return np.array([(0, 0), (w - 1, 0), (w - 1, h - 1), (0, h - 1)], float)

    away = lambda v: np.where(v >= 0, np.ceil(np.round(v, 9)), np.floor(np.round(v, 9)))
    sizes = [(shape_of(j), m) for j, m in keys] if shape_of else [(n[0].shape, m) for n, m in around]
    every = np.concatenate([corners(centre[0].shape), *(away(raster.transform_points(m, corners(shape))) for shape, m in sizes)])
    low, high = every.min(axis=0).astype(int), every.max(axis=0).astype(int)
    width, height = high - low + 1
    img = np.zeros((height, width, *centre[0].shape[2:]), np.uint8)
    mask = np.zeros((height, width), np.uint8)
    h, w = centre[1].shape
    img[-low[1] : h - low[1], -low[0] : w - low[0]] = centre[0]
    mask[-low[1] : h - low[1], -low[0] : w - low[0]] = centre[1]
    shift = np.array([[1, 0, -low[0]], [0, 1, -low[1]], [0, 0, 1]], float)
    for (pixels, m_mask), m in around:
        img, mask = raster.blend(img, mask, raster.warp(pixels, shift @ m, width, height), raster.warp(m_mask, shift @ m, width, height, cubic=False))
    return (img, mask), low
