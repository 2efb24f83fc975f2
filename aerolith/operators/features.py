"""Local features: filtering, ranking, normalising, extraction by a pluggable detector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aerolith import schemas
from aerolith.config import DEFAULT
from aerolith.functions import geo, raster


def strongest(features: DataFrame, score: float = DEFAULT.feature_score, top: int = DEFAULT.features_per_image) -> DataFrame:
    """Features of at least ``score``, the ``top`` of each image by score (ties to the lower index). The filter
    stands below the window, which limits groups before its shuffle."""
    order = Window.partitionBy("image_id").orderBy(F.desc("score"), "feat_idx")
    return features.where(F.col("score") >= score).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def inside_mask(features: DataFrame, width: int, height: int, border: int = raster.BORDER) -> DataFrame:
    """Features off the masked border."""
    return features.where(F.col("x").between(border, width - 1 - border) & F.col("y").between(border, height - 1 - border))


def normalised(features: DataFrame, width: float, height: float) -> DataFrame:
    w, h = F.lit(float(width)), F.lit(float(height))
    return features.withColumn("nx", geo.normalise(F.col("x"), w, w, h)).withColumn("ny", geo.normalise(F.col("y"), h, w, h))


def denormalised(features: DataFrame, width: float, height: float) -> DataFrame:
    w, h = F.lit(float(width)), F.lit(float(height))
    return features.withColumn("x", geo.denormalise(F.col("nx"), w, w, h)).withColumn("y", geo.denormalise(F.col("ny"), h, w, h))


class CornerDetector:
    """A classical detector: Harris corners with normalised grey patches as descriptors."""

    def __init__(self, patch: int = 8, k: float = 0.05) -> None:
        self.patch, self.k = patch, k

    def __call__(self, img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Points (n, 2), scores 0 to 1 and descriptors (n, patch * patch) of a blue-green-red image."""
        g = raster.grey(img).astype(np.float64)
        gy, gx = np.gradient(g)

        def smooth(a: np.ndarray) -> np.ndarray:
            p = np.pad(a, 1, mode="edge")
            return sum(p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(3) for j in range(3)) / 9

        xx, yy, xy = smooth(gx * gx), smooth(gy * gy), smooth(gx * gy)
        r = xx * yy - xy * xy - self.k * (xx + yy) ** 2
        p = np.pad(r, 1, constant_values=-np.inf)
        peak = np.max([p[i : i + r.shape[0], j : j + r.shape[1]] for i in range(3) for j in range(3)], axis=0)
        half = self.patch // 2
        ok = (r == peak) & (r > 0)
        ok[:half], ok[:, :half], ok[len(ok) - half :], ok[:, ok.shape[1] - half :] = False, False, False, False
        y, x = np.nonzero(ok)
        if not len(x):
            return np.zeros((0, 2)), np.zeros(0), np.zeros((0, self.patch**2))
        desc = np.stack([g[b - half : b + half, a - half : a + half].ravel() for a, b in zip(x, y, strict=True)])
        desc = desc - desc.mean(axis=1, keepdims=True)
        norm = np.linalg.norm(desc, axis=1, keepdims=True)
        return np.column_stack([x, y]).astype(float), r[y, x] / r.max(), desc / np.where(norm > 0, norm, 1)


def extract(images: DataFrame, detector: Callable | None = None) -> DataFrame:
    """Features of decoded images (``image_id`` and the fields of the image source: ``height, width, nChannels,
    data``): decimated, detected, kept where the mask is set, indexed. A rectified image brings its warped ``mask`` and
    ``warp``; without them the mask is the frame's. ``x, y`` are pixels of the photo, ``nx, ny`` normalised places in the
    decimated image. One detector per Python worker."""
    detector = detector or CornerDetector()
    extra = [c for c in ("mask", "warp") if c in images.columns]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                whole = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., :3]
                img = raster.decimate(whole)
                height, width = img.shape[:2]
                points, scores, desc = detector(img)
                mask = raster.decimate(np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width)) if "mask" in extra else raster.frame_mask(width, height)
                keep = mask[points[:, 1].astype(int), points[:, 0].astype(int)] > 0
                points, scores, desc = points[keep], scores[keep], desc[keep]
                half = max(width, height) / 2
                places = (points - [width / 2, height / 2]) / half
                photo = points * [r.width / width, r.height / height]
                if "warp" in extra and len(photo):
                    photo = raster.transform_points(np.linalg.inv(np.array(r.warp).reshape(3, 3)), photo)
                rows = zip(photo.tolist(), scores.tolist(), places.tolist(), desc.tolist(), strict=True)
                out += [(r.image_id, i, x, y, s, nx, ny, d) for i, ((x, y), s, (nx, ny), d) in enumerate(rows)]
            yield pd.DataFrame(out, columns=["image_id", "feat_idx", "x", "y", "score", "nx", "ny", "descriptor"])

    return images.select("image_id", "height", "width", "nChannels", "data", *extra).mapInPandas(run, schemas.FEATURE)


def memory(features: DataFrame, images: DataFrame) -> DataFrame:
    """Bytes of an image's pixels (three channels) and of its features (two coordinates and a descriptor)."""
    held = features.groupBy("image_id").agg(F.sum((F.size("descriptor") + 2) * 4).cast("long").alias("feature_bytes"))
    pixels = images.select("image_id", (F.col("width") * F.col("height") * 3).cast("long").alias("image_bytes"))
    return pixels.join(held, "image_id", "left").select("image_id", "image_bytes", F.coalesce("feature_bytes", F.lit(0)).cast("long").alias("feature_bytes"))
