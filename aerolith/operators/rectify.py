"""Rectified images: pixels warped onto the ground plane with their masks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from aerolith.config import DEFAULT
from aerolith.functions import raster

RECTIFIED = "image_id long, height int, width int, nChannels int, data binary, mask binary, warp array<double>"
ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]


def rectified(images: DataFrame, side: int = DEFAULT.rectified_side) -> DataFrame:
    """``images`` has ``image_id``, the pixels (``height, width, nChannels, data``), the size in the metadata
    (``meta_width, meta_height``) and world to camera as ``r00`` to ``r22``; ``warp`` is the row-major matrix from the
    photo's pixels to the rectified ones. A task holds the photos of one Arrow batch, which Spark bounds in bytes, and
    one warped image."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                img = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                turn = np.array([getattr(r, c) for c in ROTATION]).reshape(3, 3)
                out, mask, m = raster.rectify(img, int(r.meta_width), int(r.meta_height), turn.T, side)
                yield pd.DataFrame({"image_id": [r.image_id], "height": [out.shape[0]], "width": [out.shape[1]], "nChannels": [r.nChannels], "data": [out.tobytes()], "mask": [mask.tobytes()], "warp": [m.ravel().tolist()]})

    return images.mapInPandas(run, RECTIFIED)
