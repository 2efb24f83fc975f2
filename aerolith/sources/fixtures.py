"""Photogrammetry views on general tables. Each expression is valid in Spark SQL and in DuckDB; ``AT(array, i)``
stands for the i-th element from 1."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.runtime import scratch
from aerolith.sources import store

#: view -> (base table, {column: expression}, condition)
VIEWS: dict[str, tuple[str, dict[str, str], str]] = {
    "images": (
        "supplier",
        {
            "image_id": "CAST(s_suppkey AS BIGINT)",
            "path": "concat('/img/DJI_', CAST(s_suppkey AS STRING), CASE s_suppkey % 7 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPG' WHEN 2 THEN '.png' WHEN 3 THEN '.tif' WHEN 4 THEN '.Jpg' WHEN 5 THEN '.bmp' ELSE '.txt' END)",
            "width": "CAST(4000 - (s_suppkey % 3) * 500 AS DOUBLE)",
            "height": "CAST(3000 - (s_suppkey % 2) * 700 AS DOUBLE)",
            "focal": "CAST(4.5 AS DOUBLE)",
            "focal35": "CAST(24 + s_suppkey % 5 AS DOUBLE)",
            "yaw": "CAST((s_suppkey * 37) % 360 - 180 AS DOUBLE)",
            "pitch": "CAST(-90 + s_suppkey % 11 AS DOUBLE)",
            "roll": "CAST(s_suppkey % 7 - 3 AS DOUBLE)",
            "lat": "CAST(22.5 AS DOUBLE) + s_nationkey * CAST(0.0004 AS DOUBLE) + (s_suppkey % 17) * CAST(0.00007 AS DOUBLE)",
            "lon": "CAST(114 AS DOUBLE) + ((s_suppkey * 7) % 101) * CAST(0.00005 AS DOUBLE)",
            "rel_alt": "CAST(100 AS DOUBLE) + s_acctbal / CAST(1000 AS DOUBLE)",
            "abs_alt": "CASE WHEN s_suppkey % 13 = 4 THEN NULL ELSE CAST(135 AS DOUBLE) + s_acctbal / CAST(1000 AS DOUBLE) END",
        },
        "",
    ),
    "features": (
        "embeddings",
        {
            "image_id": "CAST(label AS BIGINT)",
            "feat_idx": "CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS BIGINT)",
            "x": "floor((CAST(AT(embedding, 1) AS DOUBLE) + 1) * 512)",
            "y": "floor((CAST(AT(embedding, 2) AS DOUBLE) + 1) * 384)",
            "score": "4 * abs(CAST(AT(embedding, 5) AS DOUBLE))",
            "descriptor": "CAST(embedding AS DOUBLE[])",
        },
        "",
    ),
    "raw_matches": (
        "lineitem",
        {
            "img_lhs": "CAST(l_suppkey % 8 AS BIGINT)",
            "img_rhs": "CAST(8 + l_partkey % 8 AS BIGINT)",
            "lhs": "CAST(l_orderkey % 500 AS BIGINT)",
            "rhs": "CAST(l_partkey % 500 AS BIGINT)",
            "score": "l_extendedprice / CAST(110000 AS DOUBLE)",
        },
        "",
    ),
    "order_links": (
        "lineitem",
        {
            "a": "CAST(l_orderkey * 8 + l_linenumber % 4 AS BIGINT)",
            "b": "CAST(l_orderkey * 8 + 4 + l_partkey % 4 AS BIGINT)",
            "score": "l_extendedprice / CAST(110000 AS DOUBLE)",
        },
        "",
    ),
    "cameras": (
        "nation",
        {
            "image_id": "CAST(n_nationkey AS BIGINT)",
            "cx": "CAST((n_nationkey % 5) * 20 AS DOUBLE)",
            "cy": "floor(CAST(n_nationkey AS DOUBLE) / 5) * 20",
            "cz": "CAST(120 AS DOUBLE)",
            "fx": "CAST(3000 AS DOUBLE)",
            "fy": "CAST(3000 AS DOUBLE)",
        },
        "",
    ),
    "scene_points": (
        "part",
        {"track_id": "CAST(p_partkey AS BIGINT)", "X": "CAST(p_partkey % 97 AS DOUBLE)", "Y": "CAST((p_partkey * 7) % 89 AS DOUBLE)", "Z": "p_size / CAST(10 AS DOUBLE)"},
        "",
    ),
    "pixels": (
        "part",
        {
            "x": "CAST(p_partkey % 64 AS BIGINT)",
            "y": "CAST(floor(CAST(p_partkey AS DOUBLE) / 64) AS BIGINT)",
            "base": "CAST(p_size AS BIGINT)",
            "warped": "CAST(floor(p_retailprice) AS BIGINT) % 256",
            "mask0": "CASE WHEN p_partkey % 64 < 40 THEN 255 ELSE 0 END",
            "mask1": "CASE WHEN p_partkey % 64 >= 24 THEN 255 ELSE 0 END",
        },
        "",
    ),
    "boxes": (
        "supplier",
        {"box_id": "CAST(s_suppkey AS BIGINT)", "x0": "CAST(s_suppkey % 13 AS DOUBLE)", "y0": "CAST(s_suppkey % 11 AS DOUBLE)", "w": "CAST(3 + s_suppkey % 5 AS DOUBLE)", "h": "CAST(2 + s_suppkey % 7 AS DOUBLE)"},
        "",
    ),
    "mosaic_edges": (
        "orders",
        {
            "src": "CAST(o_custkey % 211 AS BIGINT)",
            "dst": "CAST((o_custkey * 7 + o_orderkey % 3 + 1) % 211 AS BIGINT)",
            "dx": "CAST((o_custkey * 7 + o_orderkey % 3 + 1) % 211 % 40 AS DOUBLE) - 13.5",
            "dy": "CAST(o_custkey % 211 % 30 AS DOUBLE) - 7.25",
            "priority": "CAST((o_custkey % 211 + o_orderkey % 3) % 3 AS BIGINT)",
        },
        "o_custkey % 211 <> (o_custkey * 7 + o_orderkey % 3 + 1) % 211",
    ),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns, where = VIEWS[name]
    df = spark.read.parquet(f"{sf_dir}/{base}.parquet")
    df = df.where(where) if where else df
    return df.selectExpr(*(f"{e.replace('AT(', 'element_at(').replace('DOUBLE[]', 'ARRAY<DOUBLE>')} AS {c}" for c, e in columns.items()))


def view_sql(name: str) -> str:
    """The view as DuckDB SQL."""
    base, columns, where = VIEWS[name]
    return "SELECT " + ", ".join(f"{e.replace('AT(', 'list_extract(')} AS {c}" for c, e in columns.items()) + f" FROM {base}" + (f" WHERE {where}" if where else "")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene points seen by the cameras: image coordinates within 1000 pixels of the centre. The cameras (one for each
    nation) travel as one array beside every point."""
    cameras = view(spark, sf_dir, "cameras").agg(F.collect_list(F.struct("image_id", "cx", "cy", "cz", "fx", "fy")).alias("cameras"))
    points = view(spark, sf_dir, "scene_points").crossJoin(F.broadcast(cameras)).select("*", F.inline("cameras"))
    seen = points.selectExpr("track_id", "image_id", "cx", "cy", "cz", "fx", "fy", "fx * (X - cx) / (cz - Z) AS u", "fy * (Y - cy) / (cz - Z) AS v", "X", "Y", "Z")
    return seen.where("abs(u) <= 1000 AND abs(v) <= 1000")


def observations_sql() -> str:
    return f"SELECT * FROM (SELECT track_id, image_id, cx, cy, cz, fx, fy, fx * (X - cx) / (cz - Z) AS u, fy * (Y - cy) / (cz - Z) AS v, X, Y, Z FROM ({view_sql('cameras')}) c, ({view_sql('scene_points')}) p) o WHERE abs(u) <= 1000 AND abs(v) <= 1000"


#: Metadata keys (fixed values) of the columns that a photo's XMP packet holds.
XMP = {"yaw": "GimbalYawDegree", "pitch": "GimbalPitchDegree", "roll": "GimbalRollDegree", "lat": "GpsLatitude", "lon": "GpsLongitude", "rel_alt": "RelativeAltitude", "abs_alt": "AbsoluteAltitude"}


def exif(width: int, height: int, focal: tuple[int, int], focal35: int) -> bytes:
    """An EXIF segment with the size in pixels, the focal length as a fraction and its 35 mm equivalent."""
    entries = [(0x920A, 5, 200), (0xA002, 4, width), (0xA003, 4, height), (0xA405, 3, focal35)]
    body = b"II*\0" + struct.pack("<IH", 8, 1) + struct.pack("<HHII", 0x8769, 4, 1, 26) + struct.pack("<I", 0)
    body += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", tag, kind, 1, value) for tag, kind, value in entries) + struct.pack("<I", 0)
    return b"Exif\0\0" + body.ljust(200, b"\0") + struct.pack("<II", *focal)


def photo_head(row: dict) -> bytes:
    """The head of a JPEG with a row's metadata; missing values are left out of the XMP packet."""
    values = " ".join(f'd:{key}="{row[c]!r}"' for c, key in XMP.items() if row[c] is not None)
    packet = f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"><rdf:Description xmlns:d="http://d/" {values}/></rdf:RDF></x:xmpmeta>'
    segments = [exif(int(row["width"]), int(row["height"]), (int(row["focal"] * 10), 10), int(row["focal35"])), b"http://ns.adobe.com/xap/1.0/\0" + packet.encode()]
    return b"\xff\xd8" + b"".join(b"\xff\xe1" + struct.pack(">H", len(s) + 2) + s for s in segments) + b"\xff\xd9"


def bitmap(img: np.ndarray) -> bytes:
    """A 24-bit bitmap file of blue-green-red pixels."""
    height, width = img.shape[:2]
    rows = np.zeros((height, -(-3 * width // 4) * 4), np.uint8)
    rows[:, : 3 * width] = img[::-1].reshape(height, -1)
    head = struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 0, 0, 0, 0)
    return b"BM" + head + rows.tobytes()


def _stored(rows: DataFrame, make: Callable[[dict], tuple[str, bytes]], name: str) -> str:
    """Write a file for each row, from the tasks, to a folder in the shared one; the folder."""
    folder = scratch(rows.sparkSession, name)

    def put(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                file, data = make({k: None if isinstance(v, float) and np.isnan(v) else v for k, v in row.items()})
                store.write_bytes(data, f"{folder}/{file}")
            yield pd.DataFrame({"n": [len(frame)]})

    rows.mapInPandas(put, "n long").write.format("noop").mode("overwrite").save()
    return folder


def photos(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a file for each row of the images view: its metadata, without a picture."""
    return _stored(view(spark, sf_dir, "images"), lambda row: (row["path"].rpartition("/")[2], photo_head(row)), "photos")


def bitmaps(spark: SparkSession, sf_dir: str) -> str:
    """A folder with a bitmap of nine by six pixels for each row of the images view; one in nine doesn't decode."""

    def make(row: dict) -> tuple[str, bytes]:
        i = row["image_id"]
        y, x, c = np.mgrid[0:6, 0:9, 0:3]
        img = ((i * 7 + x * 3 + y * 5 + c * 11) % 256).astype(np.uint8)
        return f"{i}.bmp", bitmap(img) if i % 9 != 4 else b"BM nothing"

    return _stored(view(spark, sf_dir, "images").select("image_id"), make, "bitmaps")
