"""Joint bundle adjustment: Levenberg-Marquardt over cameras and points together, the points eliminated.

A camera has ten parameters (a turn of its rotation, its centre, fx, fy, cx, cy), a point three. Residuals carry Huber
weights. The views of a track stand in one row, so a track's point is eliminated where its views are, and what it adds
to the reduced camera system is a ten-by-ten block for each pair of its cameras. The blocks are summed by pair of
cameras and stay distributed; conjugate gradients, preconditioned by the blocks on the diagonal, multiply them where they
are. The driver keeps the cameras and vectors of ten numbers for each, for at most ``CAMERAS`` cameras. A step is taken
if it lowers the loss; otherwise the damping grows and the step is made anew.

Cameras and points without an observation stay as they are; observations of cameras that are not given are left out;
a point in a camera's plane does not pull and counts with a finite loss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.config import DEFAULT
from aerolith.runtime import written

PARAMETERS = 10
CAMERA = ["qw", "qx", "qy", "qz", "cx", "cy", "cz", "fx", "fy", "px", "py"]
CAMERA_SCHEMA = "image_id long, " + ", ".join(f"{c} double" for c in CAMERA)
#: Photos of one adjustment: about a kilobyte each on the driver.
CAMERAS = 100_000
#: Damping at first, and what it is divided by and multiplied with.
DAMPING, EASIER, HARDER = 1e-4, 5.0, 10.0
#: Conjugate gradients end at this share of the first residual.
GRADIENT_SHARE, GRADIENT_STEPS = 0.02, 30
LEAST_FOCAL, LEAST_DEPTH = 1e-6, 1e-6
#: A loss below this share of the first is as good as none.
EXACT = 1e-9
#: Pairs of views that are multiplied at a time, and blocks that a task sums before it passes them on.
PAIRS, HELD_BLOCKS = 20_000, 20_000
#: Views that are linearised at a time; a track with more is taken alone.
VIEWS = 20_000


def matrices(q: np.ndarray) -> np.ndarray:
    w, x, y, z = (q / np.linalg.norm(q, axis=1, keepdims=True)).T
    return np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1).reshape(-1, 3, 3)


def turned(q: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """The unit quaternions of a turn (rotation vector) after q."""
    angle = np.linalg.norm(turn, axis=1, keepdims=True)
    half = np.where(angle > 1e-12, np.sin(angle / 2) / np.maximum(angle, 1e-300), 0.5)
    a, b = np.hstack([np.cos(angle / 2), turn * half]), q
    out = np.column_stack([
        a[:, 0] * b[:, 0] - (a[:, 1:] * b[:, 1:]).sum(axis=1),
        a[:, :1] * b[:, 1:] + b[:, :1] * a[:, 1:] + np.cross(a[:, 1:], b[:, 1:]),
    ])
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def jacobians(cam: np.ndarray, point: np.ndarray, uv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Residuals (k, 2), their derivatives by the camera (k, 2, 10) and by the point (k, 2, 3), and whether the point is
    off the camera's plane."""
    r = matrices(cam[:, :4])
    p = np.einsum("kij,kj->ki", r, point - cam[:, 4:7])
    x, y, z = p.T
    off = np.abs(z) >= LEAST_DEPTH
    z = np.where(off, z, np.copysign(LEAST_DEPTH, z))
    fx, fy, px, py = cam[:, 7:].T
    res = np.column_stack([fx * x / z + px, fy * y / z + py]) - uv
    by_p = np.zeros((len(p), 2, 3))
    by_p[:, 0, 0], by_p[:, 0, 2], by_p[:, 1, 1], by_p[:, 1, 2] = fx / z, -fx * x / z**2, fy / z, -fy * y / z**2
    cross = np.zeros((len(p), 3, 3))
    cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 0], cross[:, 1, 2], cross[:, 2, 0], cross[:, 2, 1] = z, -y, -z, x, y, -x
    by_point = by_p @ r
    by_camera = np.zeros((len(p), 2, PARAMETERS))
    by_camera[:, :, :3], by_camera[:, :, 3:6] = by_p @ cross, -by_point
    by_camera[:, 0, 6], by_camera[:, 1, 7], by_camera[:, 0, 8], by_camera[:, 1, 9] = x / z, y / z, 1, 1
    return res, by_camera, by_point, off


def _weights(res: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = (res * res).sum(axis=1)
    return np.where(s <= 1, 1.0, 1 / np.sqrt(np.maximum(s, 1e-300))), np.where(s <= 1, s, 2 * np.sqrt(s) - 1) / 2


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tracks of ``batches`` in pieces of up to ``VIEWS`` views, or of one track."""
    for batch in batches:
        ends = np.cumsum(batch.column("views").value_lengths().fill_null(0).to_numpy())
        lo = 0
        while lo < batch.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + VIEWS, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


class Views:
    """The views in a batch of tracks, linearised: rows of ``track`` and ``camera`` numbers with their blocks."""

    def __init__(self, batch: pa.RecordBatch, ids: np.ndarray, cameras: np.ndarray, damping: float) -> None:
        self.ids = batch.column("track_id").to_numpy()
        self.points = np.column_stack([batch.column(c).to_numpy() for c in "XYZ"])
        lists = batch.column("views")
        flat = lists.flatten()
        track = np.repeat(np.arange(batch.num_rows), lists.value_lengths().fill_null(0).to_numpy())
        image, uv = flat.field("image_id").to_numpy(), np.column_stack([flat.field(c).to_numpy() for c in "uv"])
        at = np.minimum(np.searchsorted(ids, image), max(len(ids) - 1, 0))
        known = ids[at] == image if len(ids) else np.zeros(len(image), bool)
        self.track, self.camera, self.uv = track[known], at[known], uv[known]
        res, jc, jp, off = jacobians(cameras[self.camera], self.points[self.track], self.uv)
        w, self.loss = _weights(res)
        w = w * off
        self.b = np.einsum("k,kia,kib->kab", w, jc, jc)
        self.g = np.einsum("k,kia,ki->ka", w, jc, res)
        self.e = np.einsum("k,kia,kib->kab", w, jc, jp)
        c, self.h = np.zeros((len(self.ids), 3, 3)), np.zeros((len(self.ids), 3))
        np.add.at(c, self.track, np.einsum("k,kia,kib->kab", w, jp, jp))
        np.add.at(self.h, self.track, np.einsum("k,kia,ki->ka", w, jp, res))
        diagonal = np.einsum("nii->ni", c)
        c = c + (damping * diagonal + 1e-12)[:, :, None] * np.eye(3)
        self.inverse = np.linalg.inv(c)

    def track_loss(self) -> np.ndarray:
        return np.bincount(self.track, self.loss, len(self.ids))


BLOCK = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("s", pa.list_(pa.float64()))])
#: A block on the diagonal is followed by the camera's gradient and the diagonal before points were eliminated.
DIAGONAL = PARAMETERS * PARAMETERS + 2 * PARAMETERS


def _block_batch(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([sums[k].tolist() for k in keys], pa.list_(pa.float64()))], schema=BLOCK)


def _add(sums: dict[tuple[int, int], np.ndarray], i: np.ndarray, j: np.ndarray, rows: np.ndarray) -> None:
    order = np.lexsort((j, i))
    i, j, rows = i[order], j[order], rows[order]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])) if len(i) else []
    for key_i, key_j, total in zip(i[first].tolist(), j[first].tolist(), np.add.reduceat(rows, first, axis=0) if len(first) else [], strict=True):
        held = sums.get((key_i, key_j))
        sums[key_i, key_j] = total if held is None else held + total


def _assembled(ids: np.ndarray, cameras: np.ndarray, damping: float):
    """Sums of blocks (camera numbers i <= j) from tracks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in _slices(batches):
            v = Views(batch, ids, cameras, damping)
            y = v.e @ v.inverse[v.track]
            size = PARAMETERS * PARAMETERS
            own = np.zeros((len(v.track), DIAGONAL))
            own[:, :size] = v.b.reshape(-1, size)
            own[:, size : size + PARAMETERS] = v.g - np.einsum("kab,kb->ka", y, v.h[v.track])
            own[:, size + PARAMETERS :] = np.einsum("kaa->ka", v.b)
            _add(sums, v.camera, v.camera, own)
            n = np.bincount(v.track, minlength=len(v.ids))
            start, many = np.cumsum(n) - n, n[v.track]
            ends = np.cumsum(many)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, PAIRS):
                pair = np.arange(lo, min(lo + PAIRS, int(ends[-1])))
                a = np.searchsorted(ends, pair, side="right")
                b = start[v.track[a]] + pair - (ends[a] - many[a])
                half = v.camera[a] <= v.camera[b]
                a, b = a[half], b[half]
                block = np.zeros((len(a), DIAGONAL))
                block[:, :size] = -(y[a] @ v.e[b].transpose(0, 2, 1)).reshape(-1, size)
                _add(sums, v.camera[a], v.camera[b], block)
            if len(sums) > HELD_BLOCKS:
                yield _block_batch(sums)
                sums = {}
        yield _block_batch(sums)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        if batch.num_rows:
            rows = batch.column("s").flatten().to_numpy().reshape(batch.num_rows, DIAGONAL)
            _add(sums, batch.column("i").to_numpy(), batch.column("j").to_numpy(), rows)
    yield _block_batch(sums)


def _product(x: np.ndarray):
    """Rows (i, y0 to y9) of the reduced system times ``x``, without damping, from blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            i, j = batch.column("i").to_numpy(), batch.column("j").to_numpy()
            s = batch.column("s").flatten().to_numpy().reshape(n, DIAGONAL)[:, : PARAMETERS**2].reshape(n, PARAMETERS, PARAMETERS)
            apart = i != j
            at = np.concatenate([i, j[apart]])
            y = np.concatenate([np.einsum("kab,kb->ka", s, x[j]), np.einsum("kab,ka->kb", s[apart], x[i[apart]])])
            rows, where = np.unique(at, return_inverse=True)
            total = np.zeros((len(rows), PARAMETERS))
            np.add.at(total, where, y)
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(total[:, k]) for k in range(PARAMETERS))], names=["i", *(f"y{k}" for k in range(PARAMETERS))])

    return run


def _camera_step(blocks: DataFrame, n: int, damping: float) -> np.ndarray:
    """The cameras' step from the summed blocks, by preconditioned conjugate gradients."""
    size = PARAMETERS * PARAMETERS
    s, g, d = np.zeros((n, PARAMETERS, PARAMETERS)), np.zeros((n, PARAMETERS)), np.ones((n, PARAMETERS))
    for i, row in blocks.where("i = j").select("i", "s").collect():  # one for each camera
        row = np.array(row)
        s[i], g[i], d[i] = row[:size].reshape(PARAMETERS, PARAMETERS), row[size : size + PARAMETERS], row[size + PARAMETERS :]
    extra = damping * d + 1e-9
    inverse = np.linalg.inv((s + s.transpose(0, 2, 1)) / 2 + extra[:, :, None] * np.eye(PARAMETERS))
    columns = ", ".join(f"y{k} double" for k in range(PARAMETERS))

    def times(x: np.ndarray) -> np.ndarray:
        rows = blocks.mapInArrow(_product(x), f"i long, {columns}").groupBy("i").agg(*(F.sum(f"y{k}") for k in range(PARAMETERS)))
        out = extra * x
        for i, *y in rows.collect():
            out[i] += y
        return out

    step, rest = np.zeros_like(g), -g
    z = np.einsum("nab,nb->na", inverse, rest)
    way, now = z, float((rest * z).sum())
    goal = now * GRADIENT_SHARE**2
    for _ in range(GRADIENT_STEPS):
        if now <= goal or now <= 0:
            break
        q = times(way)
        curve = float((way * q).sum())
        if curve <= 0:
            break
        step, rest = step + now / curve * way, rest - now / curve * q
        z = np.einsum("nab,nb->na", inverse, rest)
        before, now = now, float((rest * z).sum())
        way = z + now / before * way
    return step


def _moved(ids: np.ndarray, cameras: np.ndarray, trial: np.ndarray, step: np.ndarray, damping: float):
    """Tracks with the points that follow from the cameras' step, and the loss with both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            v = Views(batch, ids, cameras, damping)
            pull = v.h.copy()
            np.add.at(pull, v.track, np.einsum("kab,ka->kb", v.e, step[v.camera]))
            v.points = v.points - np.einsum("nab,nb->na", v.inverse, pull)
            _, v.loss = _weights(jacobians(trial[v.camera], v.points[v.track], v.uv)[0])
            columns = [batch.column("track_id"), *(pa.array(v.points[:, k]) for k in range(3)), batch.column("views"), pa.array(v.track_loss())]
            yield pa.RecordBatch.from_arrays(columns, names=["track_id", *"XYZ", "views", "loss"])

    return run


def stepped(cameras: np.ndarray, step: np.ndarray) -> np.ndarray:
    out = cameras.copy()
    out[:, :4] = turned(cameras[:, :4], step[:, :3])
    out[:, 4:] += step[:, 3:]
    out[:, 7:9] = np.maximum(out[:, 7:9], LEAST_FOCAL)
    return out


def bundle(cameras: DataFrame, points: DataFrame, seen: DataFrame, turns: int = DEFAULT.solver_iterations, tolerance: float = 1e-9) -> tuple[DataFrame, DataFrame, list[float]]:
    """Refined ``cameras`` (CAMERA_SCHEMA), refined ``points(track_id, X, Y, Z)`` and the loss at first and after each
    step taken. ``seen`` has ``track_id, image_id, u, v``, at most a row for each image in a track. Ends after ``turns``
    trials, when a step lowers the loss by less than ``tolerance`` of it, when hardly any loss is left, or when no damping
    helps."""
    spark = cameras.sparkSession
    held = sorted(tuple(r) for r in cameras.select("image_id", *CAMERA).limit(CAMERAS + 1).collect())
    if len(held) > CAMERAS:
        raise ValueError(f"more than {CAMERAS} cameras: adjust parts of the survey")
    ids, now = np.array([r[0] for r in held], np.int64), np.array([r[1:] for r in held], float).reshape(-1, len(CAMERA))
    views = seen.groupBy("track_id").agg(F.sort_array(F.collect_list(F.struct(F.col("image_id").cast("long").alias("image_id"), F.col("u").cast("double").alias("u"), F.col("v").cast("double").alias("v")))).alias("views"))
    packed = points.select("track_id", *(F.col(c).cast("double").alias(c) for c in "XYZ")).join(views, "track_id", "left")
    nothing = F.array().cast("array<struct<image_id:long,u:double,v:double>>")
    packed = written(packed.withColumn("views", F.coalesce("views", nothing)), "tracks")
    schema = "track_id long, X double, Y double, Z double, views array<struct<image_id:long,u:double,v:double>>, loss double"
    still = np.zeros((len(ids), PARAMETERS))
    total = lambda tracks: float(tracks.agg(F.sum("loss")).first()[0] or 0.0)
    # A step of nothing under endless damping: the loss at the start.
    losses, damping = [total(packed.mapInArrow(_moved(ids, now, now, still, 1e30), schema))], DAMPING
    for _ in range(turns if len(ids) else 0):
        blocks = packed.select("track_id", *"XYZ", "views").mapInArrow(_assembled(ids, now, damping), "i long, j long, s array<double>")
        blocks = written(blocks.repartition("i", "j").mapInArrow(_summed, "i long, j long, s array<double>"), "blocks")
        step = _camera_step(blocks, len(ids), damping)
        trial = stepped(now, step)
        moved = written(packed.select("track_id", *"XYZ", "views").mapInArrow(_moved(ids, now, trial, step, damping), schema), "tracks")
        loss = total(moved)
        if not loss < losses[-1]:
            damping *= HARDER
            if damping > 1e12:
                break
            continue
        now, packed, damping = trial, moved, max(damping / EASIER, 1e-12)
        losses.append(loss)
        if losses[-2] - loss <= tolerance * losses[-2] or loss <= EXACT * losses[0]:
            break
    rows = [(int(i), *map(float, row)) for i, row in zip(ids, now, strict=True)]
    return spark.createDataFrame(rows, CAMERA_SCHEMA), packed.select("track_id", *"XYZ"), losses
