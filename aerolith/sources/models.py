"""Model files: an ONNX session per Python worker, for detectors and pair matchers. A model is read through the file
system that its path names, so a path on shared storage serves every executor."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow.fs as pafs

from aerolith.functions import raster


#: Where a session runs, in order of preference; those that this machine lacks are left out.
PROVIDERS = ("CUDAExecutionProvider", "CPUExecutionProvider")


@lru_cache(maxsize=4)
def session(path: str):
    """The session of a model file; one for each worker process."""
    fs, place = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(place) as f:
        model = f.read()
    import onnxruntime

    there = onnxruntime.get_available_providers()
    return onnxruntime.InferenceSession(model, providers=[p for p in PROVIDERS if p in there])


def detector(path: str | None, colour: bool = False) -> Callable | None:
    """The learned detector of a model file; none where there is no file."""
    return OnnxDetector(path, colour) if path else None


def matcher(path: str | None) -> Callable | None:
    return OnnxPairMatcher(path) if path else None


class OnnxDetector:
    """Learned detector with input ``image`` and outputs ``keypoints, scores, descriptors``."""

    def __init__(self, path: str, colour: bool = False) -> None:
        self.path, self.colour = path, colour

    def __call__(self, img: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = raster.planar(img)[None] if self.colour else raster.grey(img)[None, None]
        points, scores, desc = session(self.path).run(["keypoints", "scores", "descriptors"], {"image": x.astype(np.float32)})
        return points.reshape(-1, 2).astype(float), scores.ravel(), desc.reshape(len(scores.ravel()), -1)


class OnnxPairMatcher:
    """Learned matcher with inputs ``kpts0, kpts1, desc0, desc1`` and outputs ``matches0, mscores0``."""

    def __init__(self, path: str) -> None:
        self.path = path

    def __call__(self, kpts0, desc0, kpts1, desc1) -> tuple[np.ndarray, np.ndarray]:
        feed = {k: np.asarray(v, np.float32)[None] for k, v in (("kpts0", kpts0), ("kpts1", kpts1), ("desc0", desc0), ("desc1", desc1))}
        matches, scores = session(self.path).run(["matches0", "mscores0"], feed)
        return matches.reshape(-1, 2), scores.ravel()
