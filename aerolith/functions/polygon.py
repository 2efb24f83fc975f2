"""Polygons: shoelace area and convexity as columns, clipping of convex polygons as an Arrow UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def _edges(points: Column, at) -> Column:
    n = F.size(points)
    follow = lambda i, k: F.element_at(points, ((i + k) % n + 1).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: at(follow(i, 0), follow(i, 1), follow(i, 2)))


def signed_area(points: Column) -> Column:
    """Shoelace area of ``array<struct<x, y>>``, positive where x turns to y."""
    cross = _edges(points, lambda p, q, _: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2


def area(points: Column) -> Column:
    return F.abs(signed_area(points))


def is_convex(points: Column) -> Column:
    """Whether all turns have one sign (zero turns allowed)."""
    turn = _edges(points, lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - q["y"]) - (q["y"] - p["y"]) * (r["x"] - q["x"]))
    return F.forall(turn, lambda t: t >= 0) | F.forall(turn, lambda t: t <= 0)


def box_iou(a: tuple, b: tuple) -> Column:
    """Intersection over union of axis-aligned boxes (x, y, width, height)."""
    side = lambda p, w, q, v: F.greatest(F.least(p + w, q + v) - F.greatest(p, q), F.lit(0.0))
    common = side(a[0], a[2], b[0], b[2]) * side(a[1], a[3], b[1], b[3])
    return F.try_divide(common, a[2] * a[3] + b[2] * b[3] - common)


def clip(subject: np.ndarray, clipper: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: the part of a convex polygon inside another convex one."""
    def cross(o, p, q):
        return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])

    turn = sum(cross(clipper[0], clipper[i], clipper[i + 1]) for i in range(1, len(clipper) - 1))
    edges = clipper if turn >= 0 else clipper[::-1]
    out = [tuple(p) for p in subject]
    for k in range(len(edges)):
        a, b = edges[k], edges[(k + 1) % len(edges)]
        found = []
        for i, p in enumerate(out):
            q = out[(i + 1) % len(out)]
            sp, sq = cross(a, b, p), cross(a, b, q)
            if sp >= 0:
                found.append(p)
            if sp * sq < 0:
                t = sp / (sp - sq)
                found.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = found
    return np.array(out, float).reshape(-1, 2)


def plain_area(p: np.ndarray) -> float:
    if len(p) < 3:
        return 0.0
    x, y = p[:, 0], p[:, 1]
    return abs(float(x @ np.roll(y, -1) - y @ np.roll(x, -1))) / 2


def plain_convex(p: np.ndarray) -> bool:
    d = np.roll(p, -1, axis=0) - p
    turn = d[:, 0] * np.roll(d[:, 1], -1) - d[:, 1] * np.roll(d[:, 0], -1)
    return bool((turn >= 0).all() or (turn <= 0).all())


def _points(a) -> np.ndarray:
    return np.array([(p["x"], p["y"]) for p in a], float)


@F.pandas_udf(POINTS)
def intersection(a: pd.Series, b: pd.Series) -> pd.Series:
    """The common polygon of two convex polygons; an error where one is not convex."""
    def one(x, y):
        p, q = _points(x), _points(y)
        if not (plain_convex(p) and plain_convex(q)):
            raise ValueError("polygons must be convex")
        return [{"x": float(u), "y": float(v)} for u, v in clip(p, q)]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.DoubleType())
def convex_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """Intersection over union of convex polygons."""
    def one(x, y):
        p, q = _points(x), _points(y)
        common = plain_area(clip(p, q))
        union = plain_area(p) + plain_area(q) - common
        return common / union if union > 0 else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])
