"""Triangulation of tracks: linear in plain sums, residuals and robust cost, and a robust refinement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.config import DEFAULT
from aerolith.functions import geo, mat

#: Determinants below this, relative to the number of views cubed, mean parallel rays.
FLAT = 1e-9
#: Tracks that one task refines at a time.
TASK_TRACKS = 4096
#: World to camera, looking straight down.
DOWN = mat.matrix([[1, 0, 0], [0, 1, 0], [0, 0, -1]])


def linear(rays: DataFrame) -> DataFrame:
    """The point closest to the rays ``C + d v`` of each track with two views or more: with P = I - v v' / v'v it
    solves (sum P) X = sum P C. ``rays`` has ``track_id, cx, cy, cz, vx, vy, vz``; the sums combine map-side."""
    v, c = [F.col(x) for x in ("vx", "vy", "vz")], [F.col(x) for x in ("cx", "cy", "cz")]
    norm = v[0] * v[0] + v[1] * v[1] + v[2] * v[2]
    p = [[(1.0 if i == j else 0.0) - F.try_divide(v[i] * v[j], norm) for j in range(3)] for i in range(3)]
    pc = mat.apply(p, c)
    sums = rays.groupBy("track_id").agg(
        F.count("*").alias("n_views"),
        *(F.sum(p[i][j]).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)),
        *(F.sum(pc[i]).alias(f"b{i}") for i in range(3)),
    )
    a = [[F.col(f"a{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)]
    point, d = mat.solve(a, [F.col(f"b{i}") for i in range(3)])
    usable = F.coalesce(F.abs(d) > FLAT * F.pow("n_views", 3), F.lit(False))
    cells = [F.when(usable, x).alias(n) for x, n in zip(point, "XYZ", strict=True)]
    return sums.where("n_views > 1").select("track_id", *cells, usable.alias("usable"), "n_views")


def shared_depth(rays: DataFrame) -> DataFrame:
    """The variant with one depth d for all rays: d = S (v - mean v)(C - mean C) / -S (v - mean v)^2 and
    X = mean v d + mean C, from plain sums."""
    n = F.count("*")
    sums = rays.groupBy("track_id").agg(
        n.alias("n_views"),
        *(F.sum(f"{k}{x}").alias(f"{k}{x}") for k in "vc" for x in "xyz"),
        F.sum(F.expr("vx * vx + vy * vy + vz * vz")).alias("vv"),
        F.sum(F.expr("vx * cx + vy * cy + vz * cz")).alias("vc"),
    )
    num = F.expr("vc - (vx * cx + vy * cy + vz * cz) / n_views")
    den = F.expr("vv - (vx * vx + vy * vy + vz * vz) / n_views")
    usable = F.abs(den) > FLAT
    sums = sums.where("n_views > 1").withColumn("usable", usable).withColumn("d", F.when(usable, -num / den))
    return sums.select("track_id", *(((F.col(f"v{x}") * F.col("d") + F.col(f"c{x}")) / F.col("n_views")).alias(x.upper()) for x in "xyz"), "usable", "n_views")


def residuals(points: DataFrame, seen: DataFrame, rotation: mat.Matrix | None = None) -> DataFrame:
    """``du, dv`` of every observation of a usable point. ``seen`` has ``track_id, cx, cy, cz, fx, fy, u, v``;
    ``rotation`` is world to camera, by default looking straight down."""
    r = rotation or DOWN
    joined = seen.drop("X", "Y", "Z").join(points.where("usable"), "track_id")
    du, dv = geo.residual(r, [F.col(x) for x in ("cx", "cy", "cz")], (F.col("fx"), F.col("fy"), F.lit(0.0), F.lit(0.0)), [F.col(x) for x in "XYZ"], F.col("u"), F.col("v"))
    return joined.withColumn("du", du).withColumn("dv", dv)


def squared_at(point: list[Column], rotation: mat.Matrix | None = None) -> Column:
    """The squared residual of an observation (``residuals``' columns) of a point at ``point``."""
    r = rotation or DOWN
    du, dv = geo.residual(r, [F.col(x) for x in ("cx", "cy", "cz")], (F.col("fx"), F.col("fy"), F.lit(0.0), F.lit(0.0)), point, F.col("u"), F.col("v"))
    return du * du + dv * dv


def squared(res: DataFrame) -> Column:
    return F.col("du") * F.col("du") + F.col("dv") * F.col("dv")


def rmse(res: DataFrame) -> DataFrame:
    return res.groupBy("track_id").agg(F.sqrt(F.avg(squared(res))).alias("rmse"), F.count("*").alias("n_views"))


def cost(res: DataFrame) -> DataFrame:
    return res.groupBy("track_id").agg((F.sum(geo.huber(squared(res))) / 2).alias("cost"))


def refine_points(start: np.ndarray, track: np.ndarray, centre: np.ndarray, focal: np.ndarray, uv: np.ndarray, iterations: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Levenberg-Marquardt with Huber weights on many points at once. ``track`` numbers the rows' points; cameras
    look straight down. Returns points, costs and accepted steps. Points that are done leave the arrays, so that a slow
    one doesn't hold up the others."""
    x, n = start.copy(), len(start)
    order = np.argsort(track, kind="stable")
    track, centre, focal, uv = track[order], centre[order], focal[order], uv[order]

    def evaluate(points):
        d = points[track] - centre
        with np.errstate(divide="ignore", invalid="ignore"):
            r = focal * d[:, :2] / -d[:, 2:] - uv
        s = (r * r).sum(axis=1)
        rho = np.where(s <= 1, s, 2 * np.sqrt(s) - 1)
        return d, r, s, np.bincount(track, np.nan_to_num(rho, nan=1e30, posinf=1e30), len(points)) / 2

    def summed(rows):
        return np.bincount(track, rows, len(at))

    result, costs, steps = x.copy(), np.zeros(n), np.zeros(n, int)
    at, damp = np.arange(n), np.full(n, 1e-4)
    d, r, s, value = evaluate(x)
    costs[:] = value
    for _ in range(iterations):
        z = -d[:, 2]
        w = np.where(s <= 1, 1.0, 1 / np.sqrt(np.maximum(s, 1e-300)))
        px, py = focal[:, 0] / z, focal[:, 1] / z
        qx, qy = px * d[:, 0] / z, py * d[:, 1] / z
        h, g = np.empty((len(at), 3, 3)), np.empty((len(at), 3))
        h[:, 0, 0], h[:, 1, 1], h[:, 2, 2] = summed(w * px * px), summed(w * py * py), summed(w * (qx * qx + qy * qy))
        h[:, 0, 1] = h[:, 1, 0] = 0.0
        h[:, 0, 2] = h[:, 2, 0] = summed(w * px * qx)
        h[:, 1, 2] = h[:, 2, 1] = summed(w * py * qy)
        g[:, 0], g[:, 1], g[:, 2] = summed(w * px * r[:, 0]), summed(w * py * r[:, 1]), summed(w * (qx * r[:, 0] + qy * r[:, 1]))
        diag = np.einsum("nii->ni", h)
        lhs = h + (damp[:, None] * np.maximum(diag, 1e-12))[:, :, None] * np.eye(3)
        step = -np.linalg.solve(lhs + 1e-15 * np.eye(3), g[:, :, None])[:, :, 0]
        trial = x + step
        d1, r1, s1, value1 = evaluate(trial)
        better = value1 < value
        small = np.abs(step).max(axis=1) < 1e-10 * (1 + np.abs(x).max(axis=1))
        gain = np.abs(value - value1) <= 1e-12 * (value + 1e-30)
        x = np.where(better[:, None], trial, x)
        taken = better[track]
        d, r, s = (np.where(taken if a.ndim == 1 else taken[:, None], a, b) for a, b in ((d1, d), (r1, r), (s1, s)))
        value = np.where(better, value1, value)
        damp = np.where(better, damp / 5, damp * 10)
        steps[at] += better
        result[at], costs[at] = x, value
        active = ~(small | (better & gain) | (damp > 1e12))
        if not active.any():
            break
        if not active.all():
            rows, number = active[track], np.cumsum(active) - 1
            track, centre, focal, uv, d, r, s = number[track[rows]], centre[rows], focal[rows], uv[rows], d[rows], r[rows], s[rows]
            at, x, value, damp = at[active], x[active], value[active], damp[active]
    return result, costs, steps


def robust(points: DataFrame, seen: DataFrame, iterations: int = DEFAULT.solver_iterations) -> DataFrame:
    """Refined points with final cost and steps; unusable where the solver ends without a finite result. Tracks
    are dealt over tasks, many to each; a track has at most one row per image."""
    rows = seen.select("track_id", "cx", "cy", "cz", "fx", "fy", "u", "v").join(points.where("usable").select("track_id", "X", "Y", "Z"), "track_id")
    n = points.count()
    rows = rows.withColumn("task", F.pmod(F.xxhash64("track_id"), F.lit(max(1, -(-n // TASK_TRACKS)))))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        ids, first, track = np.unique(frame.track_id.to_numpy(), return_index=True, return_inverse=True)
        start = frame[["X", "Y", "Z"]].to_numpy()[first]
        x, value, steps = refine_points(start, track, frame[["cx", "cy", "cz"]].to_numpy(), frame[["fx", "fy"]].to_numpy(), frame[["u", "v"]].to_numpy(), iterations)
        usable = np.isfinite(x).all(axis=1) & np.isfinite(value) & (value < 1e29)
        return pd.DataFrame({"track_id": ids, "X": x[:, 0], "Y": x[:, 1], "Z": x[:, 2], "usable": usable, "n_views": np.bincount(track), "cost": value, "iterations": steps})

    return rows.groupBy("task").applyInPandas(run, f"{schemas.POINT}, cost double, iterations long")
