"""Pose, camera and canvas geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.config import DEFAULT
from aerolith.functions import mat
from aerolith.runtime import upper_medians

#: WGS-84 (fixed values): semi-major axis in metres, flattening.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
#: A 35 mm frame in millimetres.
FRAME_WIDTH, FRAME_HEIGHT = 36.0, 24.0


def rounded(x: mat.Entry, places: int = 6) -> Column:
    """Rounded, ties to even, without a negative zero. Scaling, rounding to a whole number and scaling back are single
    operations on doubles, so that every engine agrees on ties."""
    scale = F.lit(10.0**places)
    return F.rint(mat.num(x) * scale) / scale + F.lit(0.0)


def local_coordinates(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """East and north metres from a reference on the WGS-84 ellipsoid (degrees in)."""
    e2 = 2 * FLATTENING - FLATTENING * FLATTENING
    phi = F.radians(lat0)
    w = 1 - e2 * F.pow(F.sin(phi), 2)
    meridian = SEMI_MAJOR * (1 - e2) / F.pow(w, 1.5)
    normal = SEMI_MAJOR / F.sqrt(w)
    return normal * (F.radians(lon) - F.radians(lon0)) * F.cos(phi), meridian * (F.radians(lat) - F.radians(lat0))


def rx(a: Column) -> mat.Matrix:
    return mat.matrix([[1, 0, 0], [0, F.cos(a), F.sin(a)], [0, -F.sin(a), F.cos(a)]])


def ry(a: Column) -> mat.Matrix:
    return mat.matrix([[F.cos(a), 0, -F.sin(a)], [0, 1, 0], [F.sin(a), 0, F.cos(a)]])


def rz(a: Column) -> mat.Matrix:
    return mat.matrix([[F.cos(a), F.sin(a), 0], [-F.sin(a), F.cos(a), 0], [0, 0, 1]])


#: ``ry`` of minus a quarter turn.
QUARTER: mat.Matrix = [[0, 0, 1], [0, 1, 0], [-1, 0, 0]]


def world_to_camera(yaw: Column, pitch: Column, roll: Column) -> mat.Matrix:
    """Rotation from world to camera axes for gimbal angles in degrees."""
    level = mat.mul(mat.mul(rz(-F.radians(yaw)), ry(-F.radians(pitch))), rx(-F.radians(roll)))
    return mat.transpose(mat.mul(level, QUARTER))


def with_rotation(images: DataFrame) -> DataFrame:
    """``images`` with the entries ``r00`` to ``r22`` of world to camera; later expressions refer to the columns, so
    that they don't repeat the products."""
    r = world_to_camera(F.col("yaw"), F.col("pitch"), F.col("roll"))
    return images.withColumns({f"r{i}{j}": mat.num(r[i][j]) for i in range(3) for j in range(3)})


def rotation_columns() -> mat.Matrix:
    return [[F.col(f"r{i}{j}") for j in range(3)] for i in range(3)]


def intrinsics(width: Column, height: Column, focal: Column, focal35: Column | float = DEFAULT.focal35_default) -> tuple[Column, Column, Column, Column]:
    """``fx, fy, cx, cy`` in pixels from the focal length and its 35 mm equivalent."""
    scale = focal / mat.num(focal35)
    return width * focal / (scale * FRAME_WIDTH), height * focal / (scale * FRAME_HEIGHT), width / 2, height / 2


def camera_matrix(fx: Column, fy: Column, cx: Column, cy: Column) -> mat.Matrix:
    return mat.matrix([[fx, 0, cx], [0, fy, cy], [0, 0, 1]])


def no_distortion() -> Column:
    return F.array_repeat(F.lit(0.0), 5)


def projection(k: mat.Matrix, r: mat.Matrix, t: mat.Vector) -> mat.Matrix:
    """K [R | R t]."""
    rt = mat.apply(r, t)
    return mat.mul(k, [[*row, x] for row, x in zip(r, rt, strict=True)])


def residual(r: mat.Matrix, centre: mat.Vector, k: tuple, point: mat.Vector, u: Column, v: Column) -> tuple[Column, Column]:
    """Reprojection residual of a point seen at (u, v) by a camera at ``centre``."""
    x, y, z = mat.apply(r, mat.subtract(point, centre))
    fx, fy, cx, cy = k
    return fx * F.try_divide(x, z) + cx - u, fy * F.try_divide(y, z) + cy - v


def huber(squared: Column, delta: float = DEFAULT.huber_delta) -> Column:
    """Huber's loss of a squared residual."""
    return F.when(squared <= delta * delta, squared).otherwise(2 * delta * F.sqrt(squared) - delta * delta)


def decimated(width: Column, height: Column, max_width: int = DEFAULT.inference_width, max_height: int = DEFAULT.inference_height) -> tuple[Column, Column]:
    """Size after shrinking into the inference resolution with the aspect kept; never enlarged."""
    scale = F.least(F.lit(float(max_width)) / width, F.lit(float(max_height)) / height, F.lit(1.0))
    return F.round(width * scale).cast("int"), F.round(height * scale).cast("int")


def normalise(p: Column, side: Column, width: Column, height: Column) -> Column:
    """Keypoint coordinate relative to the centre, in units of half the longer side."""
    return (p - side / 2) / F.greatest(width / 2, height / 2)


def denormalise(p: Column, side: Column, width: Column, height: Column) -> Column:
    return p * F.greatest(width / 2, height / 2) + side / 2


def abs_ceil(x: Column) -> Column:
    """Rounded away from zero."""
    return F.when(x >= 0, F.ceil(x)).otherwise(F.floor(x))


def hypot(*d: Column) -> Column:
    return F.sqrt(sum((x * x for x in d[1:]), d[0] * d[0]))


def bounding(points: Column) -> Column:
    """``x, y, width, height`` of an array of ``struct<x, y>``."""
    axis = lambda name: F.transform(points, lambda p: p[name])
    x, y = F.array_min(axis("x")), F.array_min(axis("y"))
    return F.struct(x.alias("x"), y.alias("y"), (F.array_max(axis("x")) - x).alias("width"), (F.array_max(axis("y")) - y).alias("height"))


def centroid(points: Column) -> Column:
    total = lambda name: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[name]) / F.size(points)
    return F.struct(total("x").alias("x"), total("y").alias("y"))


def image_corners(width: Column, height: Column) -> list[tuple[Column, Column]]:
    zero = F.lit(0.0)
    return [(zero, zero), (width - 1, zero), (width - 1, height - 1), (zero, height - 1)]


def with_footprint(images: DataFrame) -> DataFrame:
    """``images`` (``width, height`` and ``r00`` to ``r22``) with ``corners``: the image corners' rays (unit in the image
    plane, depth 1) on the plane at depth 1, as ``array<struct>``. One lambda serves the four corners: their unrolled
    expressions are too long for the compiler of generated code."""
    corners = F.array(*(F.struct((x - F.col("width") / 2).alias("dx"), (y - F.col("height") / 2).alias("dy")) for x, y in image_corners(F.col("width"), F.col("height"))))
    back = mat.transpose(rotation_columns())

    def on_plane(ray: Column) -> Column:
        px, py = mat.dehomogenise(mat.apply(back, [ray["x"], ray["y"], 1.0]))
        return F.struct(px.alias("x"), py.alias("y"))

    unit = lambda p: F.struct(*(F.try_divide(p[f"d{c}"], hypot(p["dx"], p["dy"])).alias(c) for c in "xy"))
    return images.withColumn("corners", F.transform(F.transform(corners, unit), on_plane))


def canvas(corners: Column, side: int = DEFAULT.rectified_side) -> Column:
    """Corners moved to the origin and scaled so that the longer side is ``side``, with the canvas size."""
    box = bounding(corners)
    longest = F.greatest(box["width"], box["height"])
    factor = F.lit(float(side)) / F.when(longest < 1e-6, 1.0).otherwise(longest)
    moved = F.transform(corners, lambda p: F.struct(((p["x"] - box["x"]) * factor).alias("x"), ((p["y"] - box["y"]) * factor).alias("y")))
    return F.struct(moved.alias("corners"), F.ceil(F.round(box["width"] * factor, 6)).alias("width"), F.ceil(F.round(box["height"] * factor, 6)).alias("height"))


def with_reference(images: DataFrame) -> DataFrame:
    """``images`` with the upper-median position and metres from it; the reference is two numbers."""
    lat0, lon0 = (F.lit(v).cast("double") for v in upper_medians(images, ["lat", "lon"]))
    x, y = local_coordinates(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return images.withColumn("lat0", lat0).withColumn("lon0", lon0).withColumn("x", x).withColumn("y", y)


def path_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def path_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]+)$", 1)


def path_stem(path: Column) -> Column:
    return F.regexp_replace(path_name(path), r"\.[^./]+$", "")
