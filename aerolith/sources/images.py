"""Image files: listing, validity, metadata and pixels."""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.runtime import ordered_ids

#: Accepted extensions (fixed values): lower case, or all upper case.
EXTENSIONS = (".jpg", ".jpeg", ".png", ".tiff", ".bmp")
#: Metadata keys (fixed values) and the columns they fill.
XMP_KEYS = {
    "GimbalYawDegree": "yaw",
    "GimbalPitchDegree": "pitch",
    "GimbalRollDegree": "roll",
    "GpsLatitude": "lat",
    "GpsLongitude": "lon",
    "RelativeAltitude": "rel_alt",
    "AbsoluteAltitude": "abs_alt",
}
EXIF_TAGS = {0xA002: "width", 0xA003: "height", 0x920A: "focal", 0xA405: "focal35"}
EXIF_POINTER = 0x8769
REQUIRED = [*XMP_KEYS.values(), "width", "height"]
COLUMNS = [*XMP_KEYS.values(), *EXIF_TAGS.values()]


def valid_extension(path: Column) -> Column:
    return geo.path_extension(path).isin(*EXTENSIONS, *(e.upper() for e in EXTENSIONS))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Path, size and time of the entries of a folder, without its subfolders; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select("path", "length", "modificationTime")


def _segments(f) -> Iterator[bytes]:
    """The APP1 segments of a JPEG file; whatever else stands before the picture is skipped, not read."""
    if f.read(2) != b"\xff\xd8":
        return
    while len(head := f.read(4)) == 4 and head[0] == 0xFF and head[1] not in (0xDA, 0xD9):
        n = max(struct.unpack_from(">H", head, 2)[0] - 2, 0)
        if head[1] == 0xE1:
            yield f.read(n)
        else:
            f.seek(n, 1)


def _exif(segment: bytes) -> dict[str, float]:
    tiff = segment[6:]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    out: dict[str, float] = {}
    if order is None:
        return out
    todo = [struct.unpack_from(order + "I", tiff, 4)[0]]
    while todo:
        at = todo.pop()
        (count,) = struct.unpack_from(order + "H", tiff, at)
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", tiff, at + 2 + 12 * k)
            value = at + 10 + 12 * k
            if tag == EXIF_POINTER:
                todo.append(struct.unpack_from(order + "I", tiff, value)[0])
            elif tag in EXIF_TAGS and n == 1:
                if kind == 3:
                    out[EXIF_TAGS[tag]] = float(struct.unpack_from(order + "H", tiff, value)[0])
                elif kind == 4:
                    out[EXIF_TAGS[tag]] = float(struct.unpack_from(order + "I", tiff, value)[0])
                elif kind == 5:
                    p, q = struct.unpack_from(order + "II", tiff, struct.unpack_from(order + "I", tiff, value)[0])
                    out[EXIF_TAGS[tag]] = p / q if q else None
    return out


def _xmp(data: bytes) -> dict[str, float]:
    m = re.search(rb"<x:xmpmeta.*?</x:xmpmeta>", data, re.S)
    out: dict[str, float] = {}
    if m:
        for node in ET.fromstring(m[0].decode("utf-8", "replace")).iter():
            for key, value in [*node.attrib.items(), (node.tag, node.text or "")]:
                name = key.rpartition("}")[2]
                if name in XMP_KEYS and re.fullmatch(r"\s*[+-]?\d+(\.\d*)?\s*", value):
                    out[XMP_KEYS[name]] = float(value)
    return out


def metadata_in(f) -> dict[str, float]:
    """The known EXIF and XMP values of an open file; what can't be read is absent. The whole file is read only where no
    segment at its head holds XMP."""
    out: dict[str, float] = {}
    for segment in _segments(f):
        try:
            if segment.startswith(b"Exif\0\0"):
                out |= _exif(segment)
            elif b"xmpmeta" in segment:
                out |= _xmp(segment)
        except (struct.error, ET.ParseError):
            continue
    if not any(c in out for c in XMP_KEYS.values()):
        f.seek(0)
        try:
            out |= _xmp(f.read())
        except ET.ParseError:
            pass
    return out


def metadata_of(data: bytes) -> dict[str, float]:
    return metadata_in(io.BytesIO(data))


def _opened(path: str):
    fs, place = pafs.FileSystem.from_uri(quote(path, safe="/:@"))
    return fs.open_input_file(place)


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and the metadata columns of each file with a valid extension; a missing key is null. The tasks open the
    files and read their heads; in a store that only Spark can open they get the files whole."""
    schema = "path string, " + ", ".join(f"{c} double" for c in COLUMNS)
    files = spark.read.format("binaryFile").load(folder).where(valid_extension(F.col("path")))
    scheme = urlsplit(spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).getUri().toString()).scheme
    direct = scheme in ("file", "hdfs", "s3", "gs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, found = batch.column(0).to_pylist(), []
            for k, path in enumerate(paths):
                with _opened(path) if direct else io.BytesIO(batch.column(1)[k].as_py()) as f:
                    found.append(metadata_in(f))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array([m.get(c) for m in found], pa.float64()) for c in COLUMNS)], names=["path", *COLUMNS])

    return files.select("path", *([] if direct else ["content"])).mapInArrow(run, schema)


def with_required(meta: DataFrame) -> DataFrame:
    """Rows that have every required key."""
    return meta.dropna(subset=REQUIRED)


def rejected(meta: DataFrame) -> DataFrame:
    """Rows that lack a required key, with the names of those missing."""
    missing = F.filter(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED)), lambda c: c.isNotNull())
    return meta.withColumn("missing", missing).where(F.size("missing") > 0).select("path", "missing")


def image_table(meta: DataFrame) -> DataFrame:
    """Valid images, numbered from 0 by path."""
    return ordered_ids(with_required(meta.where(valid_extension(F.col("path")))), "path", "image_id")


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images (blue, green, red); files that don't decode are dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")
