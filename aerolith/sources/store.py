"""Stored features and mosaics."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(features: DataFrame, path: str, buckets: int = 64) -> None:
    """Features by image bucket, so that a pair's images are found without a full scan."""
    features.selectExpr("*", f"pmod(image_id, {buckets}) AS bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def png(img: np.ndarray) -> bytes:
    """A grey or blue-green-red image as PNG."""
    height, width = img.shape[:2]
    rows = img.reshape(height, width, -1)[..., ::-1]
    lines = np.zeros((height, 1 + rows.shape[2] * width), np.uint8)
    lines[:, 1:] = rows.reshape(height, -1)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2 if rows.shape[2] == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, or of a plain path on this machine."""
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def write_bytes(data: bytes, uri: str) -> None:
    """Write a file, with the folders that it needs."""
    fs, path = place(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(data)


def write_image(img: np.ndarray, uri: str) -> None:
    """Write a mosaic or a single rectified image; an empty one is an error."""
    if not img.size:
        raise ValueError("the image is empty")
    write_bytes(png(img), uri)


def features_of(data: bytes, width: int = 256) -> np.ndarray:
    """Features of a ``.desc`` file: their number as decimal text, then ``x, y`` and a descriptor of ``width`` numbers
    for each, 32-bit floats without a gap. The first float may begin with bytes that are digits, so the number is the
    prefix of digits whose value fits the length of the file."""
    size = 4 * (width + 2)
    digits = 0
    while data[digits : digits + 1].isdigit():
        digits += 1
        if digits + int(data[:digits]) * size == len(data):
            return np.frombuffer(data, "<f4", offset=digits).reshape(-1, width + 2)
    raise ValueError("the length of the file fits no number of features")


def read_descriptors(spark: SparkSession, folder: str, width: int = 256) -> DataFrame:
    """The features of the ``.desc`` files of a folder: ``stem, feat_idx, x, y, descriptor``."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.desc").load(folder).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame.path, frame.content, strict=True):
                rows = features_of(content, width).astype(float)
                stem = path.rpartition("/")[2].rpartition(".")[0]
                yield pd.DataFrame({"stem": stem, "feat_idx": range(len(rows)), "x": rows[:, 0], "y": rows[:, 1], "descriptor": rows[:, 2:].tolist()})

    return found.mapInPandas(run, "stem string, feat_idx long, x double, y double, descriptor array<double>")


def write_descriptors(features: DataFrame, folder: str) -> None:
    """One ``{stem}.desc`` file for each stem of ``stem, feat_idx, x, y, descriptor``, of as many features as
    ``strongest`` leaves."""

    def put(frame: pd.DataFrame) -> pd.DataFrame:
        rows = np.array([[x, y, *d] for x, y, d in zip(frame.x, frame.y, frame.descriptor, strict=True)], "<f4")
        write_bytes(str(len(rows)).encode() + rows.tobytes(), f"{folder}/{frame.stem.iloc[0]}.desc")
        return pd.DataFrame({"stem": [frame.stem.iloc[0]], "n": [len(rows)]})

    features.orderBy("stem", "feat_idx").groupBy("stem").applyInPandas(lambda f: put(f.sort_values("feat_idx")), "stem string, n long").write.format("noop").mode("overwrite").save()


def line_picture(left: np.ndarray, right: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two images side by side with a line for each match; ``ends`` has rows ``x0, y0, x1, y1``."""
    height, width = max(left.shape[0], right.shape[0]), left.shape[1] + right.shape[1]
    out = np.zeros((height, width, 3), np.uint8)
    for img, at in ((left, 0), (right, left.shape[1])):
        out[: img.shape[0], at : at + img.shape[1]] = img if img.ndim == 3 else img[..., None]
    for k, (x0, y0, x1, y1) in enumerate(np.asarray(ends, float).reshape(-1, 4)):
        x1 += left.shape[1]
        n = int(max(abs(x1 - x0), abs(y1 - y0))) + 1
        xs, ys = np.linspace(x0, x1, n).round().astype(int), np.linspace(y0, y1, n).round().astype(int)
        inside = (xs >= 0) & (xs < width) & (ys >= 0) & (ys < height)
        out[ys[inside], xs[inside]] = [(37 * k) % 200 + 55, (91 * k) % 200 + 55, (53 * k) % 200 + 55]
    return out


def write_match_pictures(lines: DataFrame, images: DataFrame, folder: str) -> None:
    """``{img_lhs}_{img_rhs}_matches.png`` for each pair of ``lines`` (``img_lhs, img_rhs, x0, y0, x1, y1``); ``images``
    has ``image_id`` and the fields of the image source. A pair's lines, at most as many as an image has features, stand
    in one row."""
    ends = lines.groupBy("img_lhs", "img_rhs").agg(F.collect_list(F.array("x0", "y0", "x1", "y1")).alias("ends"))
    side = lambda name: images.select(F.col("image_id").alias(name), F.struct("height", "width", "nChannels", "data").alias(f"{name}_px"))

    def put(rows) -> None:
        for r in rows:
            left, right = (np.frombuffer(p.data, np.uint8).reshape(p.height, p.width, p.nChannels) for p in (r.img_lhs_px, r.img_rhs_px))
            write_image(line_picture(left, right, r.ends), f"{folder}/{r.img_lhs}_{r.img_rhs}_matches.png")

    ends.join(side("img_lhs"), "img_lhs").join(side("img_rhs"), "img_rhs").foreachPartition(put)


def write_rectified(images: DataFrame, folder: str) -> None:
    """Every rectified image and its mask as ``{image_id}_r.png`` and ``{image_id}_rm.png``, from the tasks."""

    def put(rows) -> None:
        for r in rows:
            write_image(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels), f"{folder}/{r.image_id}_r.png")
            write_image(np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width), f"{folder}/{r.image_id}_rm.png")

    images.foreachPartition(put)
