"""Media columns: a Spark data source over archives of losslessly stored payloads.

``store`` writes each text as an 8-bit greyscale PNG, 64 samples wide, into ZIP archives in the shared folder;
the manifest of the archives is a committed Parquet table, so what a failed task attempt leaves behind is never
read. ``MediaArchive`` plans byte ranges over those archives from their sizes alone: a partition is a stretch of the
manifest's rows with the bytes where it begins and ends, and there are at most ``PARTITIONS`` of them. A task opens each
of its archives once, reads the members whose headers start in its range, streams them through Arrow in batches of
bounded bytes, and retries a member on its own, by its offset, on a new handle when a read fails, falls short or gives a
wrong checksum.

Defined results: a null text is an empty payload of 64 zero bytes; null or repeated ``doc_id`` values are
carried; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from aerolith.llm.common import scratch

WIDTH = 64
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 8 << 20
#: Byte ranges grow beyond SPLIT_BYTES where there would be more partitions than this.
PARTITIONS = 50_000
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
PNG_MAGIC = b"\x89PNG\r\n\x1a\n"


def padded(data: bytes) -> bytes:
    """``data`` with zeros up to a positive multiple of 64 bytes."""
    return data.ljust(max(WIDTH, -(-len(data) // WIDTH) * WIDTH), b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(payload: bytes) -> bytes:
    """An 8-bit greyscale PNG with one row for every 64 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def samples(media: bytes) -> bytes:
    """The samples of a PNG that ``png`` made; every chunk's checksum is verified."""
    if media[:8] != PNG_MAGIC:
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[0] != WIDTH or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("unexpected PNG layout")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected PNG filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, standard deviation, entropy in bits and share of changes between neighbouring samples."""
    x = np.frombuffer(payload, np.uint8)
    n = len(x)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    total, squares = int(counts @ levels), int(counts @ (levels * levels))
    mean = total / n
    p = counts[counts > 0] / n
    changes = int(np.count_nonzero(x[1:] != x[:-1])) / max(n - 1, 1)
    return f"mean={mean:.4f};sd={math.sqrt(max(squares / n - mean * mean, 0)):.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};changes={changes:.4f}"


def _write_archives(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        buffer, archive, members = io.BytesIO(), None, 0

        def close() -> pa.RecordBatch:
            nonlocal buffer, archive, members
            archive.close()
            name, data = f"{uuid.uuid4().hex}.zip", buffer.getvalue()
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(data)
            row = pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "bytes": pa.array([len(data)], pa.int64()), "members": pa.array([members], pa.int64())})
            buffer, archive, members = io.BytesIO(), None, 0
            return row

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    data = (text or "").encode()
                    archive = archive or zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)
                    archive.writestr(zipfile.ZipInfo(f"{members}_{'' if doc_id is None else doc_id}_{len(data)}.png"), png(padded(data)))
                    members += 1
                    if buffer.tell() >= ARCHIVE_BYTES:
                        yield close()
        if archive is not None:
            yield close()

    return write


def store(docs: DataFrame) -> str:
    """Write every text into archives in the shared folder; the path of their manifest table."""
    folder = scratch(docs.sparkSession, "media")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows.mapInArrow(_write_archives(f"{folder}/archives"), "archive string, bytes long, members long").write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


class ByteRange(InputPartition):
    """Rows ``first`` to ``last`` of a manifest file: the first archive from byte ``low``, the last up to ``high``."""

    def __init__(self, manifest: str, first: int, last: int, low: int, high: int) -> None:
        self.manifest, self.first, self.last, self.low, self.high = manifest, first, last, low, high


class MediaArchive(DataSource):
    """``spark.read.format("media_archive").option("manifest", path)``: a row for each archive member."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(self.options)


SIZES = pa.schema([("archive", pa.string()), ("bytes", pa.int64())])
MEMBERS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), MEMBERS.types, strict=True)], schema=MEMBERS)


class Handle:
    """An archive opened for reading at offsets; after a failure it is opened anew."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.file = None

    def __enter__(self) -> Handle:
        return self

    def __exit__(self, *_) -> None:
        self.reopen()

    def reopen(self) -> None:
        """Close; the next read opens the archive again."""
        if self.file is not None:
            self.file.close()
        self.file = None

    def read(self, at: int, n: int) -> bytes:
        self.file = self.file or self.fs.open_input_file(self.path)
        self.file.seek(at)
        return self.file.read(n)

    def members(self) -> list[zipfile.ZipInfo]:
        """The directory of the archive; a failed read is tried again."""
        for attempt in range(ATTEMPTS):
            try:
                self.file = self.file or self.fs.open_input_file(self.path)
                with zipfile.ZipFile(_Kept(self.file)) as archive:
                    return archive.infolist()
            except (OSError, zipfile.BadZipFile) as e:
                self.reopen()
                if attempt + 1 == ATTEMPTS:
                    raise OSError(f"{self.path}: {e}") from e
        raise AssertionError


class _Kept:
    """A file for ``zipfile`` that stays open."""

    def __init__(self, file) -> None:
        self.read, self.seek, self.tell, self.seekable = file.read, file.seek, file.tell, lambda: True


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.manifest = options["manifest"]
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges from the archives' sizes, which are read as a stream: neither archives nor members are listed on
        the driver, which keeps a row for each partition."""
        fs, root = pafs.FileSystem.from_uri(self.manifest)
        files = sorted(f.path for f in pads.dataset(root, filesystem=fs, format="parquet", exclude_invalid_files=False, schema=SIZES).get_fragments())

        def sizes() -> Iterator[tuple[str, int, int]]:
            for file in files:
                row = 0
                for batch in pads.dataset(file, filesystem=fs, format="parquet").to_batches(columns=["bytes"]):
                    for size in batch.column(0).to_pylist():
                        yield file, row, size
                        row += 1

        split = max(self.split, -(-sum(size for _, _, size in sizes()) // PARTITIONS))
        found: list[ByteRange] = []
        room = 0  # bytes that the last partition still takes
        for file, row, size in sizes():
            at = 0
            if found and room > 0 and found[-1].manifest == file:
                at = min(room, size)
                found[-1].last, found[-1].high = row, at
                room -= at
            while at < size:
                end = min(at + split, size)
                found.append(ByteRange(file, row, row, at, end))
                room, at = split - (end - at), end
        return found or [ByteRange("", 0, -1, 0, 0)]

    @staticmethod
    def _member(handle: Handle, info: zipfile.ZipInfo) -> bytes:
        """One member, read at its offset; only this member is read again after a failure."""
        for attempt in range(ATTEMPTS):
            try:
                head = handle.read(info.header_offset, 30)
                if len(head) < 30 or head[:4] != b"PK\x03\x04":
                    raise OSError("no member starts here")
                name, extra = struct.unpack_from("<HH", head, 26)
                data = handle.read(info.header_offset + 30 + name + extra, info.compress_size)
                if len(data) != info.compress_size or zlib.crc32(data) != info.CRC:
                    raise OSError("damaged member")
                return data
            except OSError as e:
                handle.reopen()
                if attempt + 1 == ATTEMPTS:
                    raise OSError(f"{handle.path}, offset {info.header_offset}: {e}") from e
        raise AssertionError

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        if partition.last < partition.first:  # there is no archive
            return
        fs, _ = pafs.FileSystem.from_uri(self.manifest)
        table = pads.dataset(partition.manifest, filesystem=fs, format="parquet").to_table(columns=["archive", "bytes"])
        mine = table.slice(partition.first, partition.last - partition.first + 1).to_pydict()
        for k, (archive, size) in enumerate(zip(mine["archive"], mine["bytes"], strict=True), partition.first):
            low = partition.low if k == partition.first else 0
            high = partition.high if k == partition.last else size
            with Handle(archive) as handle:
                for info in handle.members():
                    if low <= info.header_offset < high:
                        data = self._member(handle, info)
                        _, doc_id, n = info.filename.removesuffix(".png").split("_")
                        rows.append((int(doc_id) if doc_id else None, int(n), data))
                        held += len(data)
                        if held >= BATCH_BYTES:
                            yield _rows(rows)
                            rows, held = [], 0
        if rows:
            yield _rows(rows)


def read_media(spark: SparkSession, manifest: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").option("manifest", manifest).option("splitBytes", str(split_bytes)).load()


DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            rows = []
            for doc_id, n, media in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                payload = samples(media)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), DIGEST.types, strict=True)], schema=DIGEST)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text, read the stored bytes back and describe them: one row per document."""
    kinds = {pa.int64(): "long", pa.string(): "string"}
    return read_media(docs.sparkSession, store(docs)).mapInArrow(_digest, ", ".join(f"{f.name} {kinds[f.type]}" for f in DIGEST))
