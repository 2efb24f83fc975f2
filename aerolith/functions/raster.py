"""Pixels in numpy, and the Arrow functions that run them: decimation, grey and planar forms, the rectifying
warp with its mask, and blending."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aerolith.config import DEFAULT

BORDER = 2
SMALLEST = 5


def resize_nearest(img: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = img.shape[:2]
    ys = np.minimum(np.arange(height) * h // height, h - 1)
    xs = np.minimum(np.arange(width) * w // width, w - 1)
    return img[ys][:, xs]


def decimate(img: np.ndarray, max_width: int = DEFAULT.inference_width, max_height: int = DEFAULT.inference_height) -> np.ndarray:
    """Shrunk into the resolution with the aspect kept; never enlarged."""
    h, w = img.shape[:2]
    scale = min(max_width / w, max_height / h, 1.0)
    return img if scale == 1.0 else resize_nearest(img, max(1, int(np.floor(w * scale + 0.5))), max(1, int(np.floor(h * scale + 0.5))))


def grey(img: np.ndarray) -> np.ndarray:
    """Luma of a blue-green-red image, 0 to 1."""
    if img.ndim == 2:
        return img.astype(np.float32) / 255
    b, g, r = (img[..., i].astype(np.float32) for i in range(3))
    return (0.114 * b + 0.587 * g + 0.299 * r) / 255


def planar(img: np.ndarray) -> np.ndarray:
    """Blue-green-red pixels as red, green and blue planes, 0 to 1."""
    return np.ascontiguousarray(img[..., ::-1].transpose(2, 0, 1)).astype(np.float32) / 255


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3x3 matrix, last entry 1, that takes four points to four others."""
    a, b = np.zeros((8, 8)), np.zeros(8)
    for i, ((x, y), (u, v)) in enumerate(zip(src, dst, strict=True)):
        a[2 * i] = [x, y, 1, 0, 0, 0, -u * x, -u * y]
        a[2 * i + 1] = [0, 0, 0, x, y, 1, -v * x, -v * y]
        b[2 * i : 2 * i + 2] = u, v
    return np.append(np.linalg.solve(a, b), 1.0).reshape(3, 3)


def transform_points(m: np.ndarray, points: np.ndarray) -> np.ndarray:
    p = np.column_stack([points, np.ones(len(points))]) @ m.T
    return p[:, :2] / p[:, 2:]


def _cubic(t: np.ndarray, a: float = -0.75) -> list[np.ndarray]:
    """Weights of the four neighbours at fraction t."""
    near = lambda d: ((a + 2) * d - (a + 3)) * d * d + 1
    far = lambda d: ((a * d - 5 * a) * d + 8 * a) * d - 4 * a
    return [far(t + 1), near(t), near(1 - t), far(2 - t)]


def warp(img: np.ndarray, m: np.ndarray, width: int, height: int, cubic: bool = True) -> np.ndarray:
    """Perspective warp by inverse mapping; outside is 0."""
    h, w = img.shape[:2]
    flat = img.reshape(h, w, -1).astype(np.float64)
    ys, xs = np.divmod(np.arange(width * height), width)
    back = np.linalg.inv(m)
    p = back @ np.vstack([xs, ys, np.ones(len(xs))])
    with np.errstate(divide="ignore", invalid="ignore"):
        x, y = p[0] / p[2], p[1] / p[2]
    x, y = np.nan_to_num(x, nan=-9, posinf=-9, neginf=-9), np.nan_to_num(y, nan=-9, posinf=-9, neginf=-9)
    out = np.zeros((len(xs), flat.shape[2]))

    def pick(px, py):
        ok = (px >= 0) & (px < w) & (py >= 0) & (py < h)
        v = np.zeros((len(px), flat.shape[2]))
        v[ok] = flat[py[ok], px[ok]]
        return v

    x, y = np.clip(x, -9, w + 9), np.clip(y, -9, h + 9)
    if cubic:
        fx, fy = np.floor(x).astype(int), np.floor(y).astype(int)
        wx, wy = _cubic(x - fx), _cubic(y - fy)
        for j in range(4):
            for i in range(4):
                out += pick(fx + i - 1, fy + j - 1) * (wx[i] * wy[j])[:, None]
    else:
        out = pick(np.floor(x + 0.5).astype(int), np.floor(y + 0.5).astype(int))
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8).reshape(height, width, *img.shape[2:])


def frame_mask(width: int, height: int) -> np.ndarray:
    """255 inside a border of two zero pixels."""
    if width < SMALLEST or height < SMALLEST:
        raise ValueError("image size is too small")
    mask = np.zeros((height, width), np.uint8)
    mask[BORDER:-BORDER, BORDER:-BORDER] = 255
    return mask


def rectifying(width: int, height: int, camera_to_world: np.ndarray, side: int = DEFAULT.rectified_side) -> tuple[np.ndarray, int, int]:
    """The matrix that takes a photo's pixels onto the ground plane, and the size of the canvas there."""
    src = np.array([(0, 0), (width - 1, 0), (width - 1, height - 1), (0, height - 1)], float)
    d = src - [width / 2, height / 2]
    rays = np.column_stack([d / np.linalg.norm(d, axis=1, keepdims=True), np.ones(4)]) @ camera_to_world.T
    plane = rays[:, :2] / rays[:, 2:]
    low, high = plane.min(axis=0), plane.max(axis=0)
    longest = (high - low).max()
    dst = (plane - low) * (side / (longest if longest >= 1e-6 else 1.0))
    w, h = (max(1, int(v)) for v in np.ceil(np.round(dst.max(axis=0), 6)))
    return homography(src, dst), w, h


def rectify(img: np.ndarray, width: int, height: int, camera_to_world: np.ndarray, side: int = DEFAULT.rectified_side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The image warped onto the ground plane, its mask, and the matrix of the warp."""
    mask = frame_mask(width, height)
    img = resize_nearest(img, width, height)
    m, w, h = rectifying(width, height, camera_to_world, side)
    return warp(img, m, w, h), warp(mask, m, w, h, cubic=False), m


def blend(base: np.ndarray, base_mask: np.ndarray, new: np.ndarray, new_mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half and half where both masks are set, the new pixels where only theirs is, and the joint mask."""
    both, only = (base_mask & new_mask) > 0, (~base_mask & new_mask) > 0
    out = base.copy()
    mixed = np.floor((base.astype(float) + new) / 2 + 0.5).astype(np.uint8)
    out[both], out[only] = mixed[both], new[only]
    return out, base_mask | new_mask


def pixel(base: Column, base_mask: Column, new: Column, new_mask: Column) -> Column:
    """``blend`` on pixel rows."""
    both, only = base_mask.bitwiseAND(new_mask) > 0, F.bitwise_not(base_mask).bitwiseAND(new_mask) > 0
    return F.when(both, F.floor((base + new) / 2 + 0.5)).when(only, new).otherwise(base)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def homography_of(src: pd.Series, dst: pd.Series) -> pd.Series:
    """Row-major 3x3 matrices from four-point arrays of ``struct<x, y>``."""
    points = lambda a: np.array([(p["x"], p["y"]) for p in a], float)
    return pd.Series([homography(points(s), points(d)).ravel().tolist() for s, d in zip(src, dst, strict=True)])
