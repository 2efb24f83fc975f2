"""Suffix-array dedup with a run-length index.

Every byte that lies in a 200-byte string which also starts anywhere else is removed. Each 200-byte window is
owned by its minimizer: the 80-byte gram in it with the least hash, the leftmost on ties. Equal windows have
equal minimizers, so only the windows of equal grams need comparing. The windows that one gram occurrence owns
are consecutive; the bytes they cover are its span.

1. Occurrences of spans whose gram occurs once are left: their windows occur once. The others are grouped by
   (gram, span digest), so that copies of a span are handled once and get the result of their group.
2. One copy of each span, two where it occurs more than once, goes to a block with the other spans of its gram.
   The block builds a run-compressed Burrows-Wheeler transform of its spans and keeps suffix samples at the run
   ends only, with the length of the match across each run border; copies add to runs, hardly to their number.
   Matching statistics stream through the text from those samples, falling by one for each byte until the next
   sample lifts them; a window with a statistic of 200 or more occurs elsewhere.
3. Spans of one gram that are too many for a block are cut by where the gram stands in their windows, into ``SLOTS``
   stretches of offsets. Equal windows have the gram at one offset, so within a stretch they also agree in the bytes
   right before and after the gram that all its windows hold: the pieces go to blocks by these bytes and are indexed
   there. Only where even such a block is too large are its windows, then nearly the same, counted by digest.

Documents are stored once in order of a row number. What is known of them (wanted spans, marks) is stored beside them
in order of that number too; a task merges the two as it reads, so texts are never shuffled and a side file is read
once for each part of the documents.

Defined results: a null text counts as empty; texts under 200 bytes are kept as they are; null or repeated
``doc_id`` values are carried; repeated rows remove each other; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import scratch, written

LENGTH = 200
GRAM = 80
GRAMS = LENGTH - GRAM + 1
#: Texts are hashed this many bytes at a time; positions fit POSITION_BITS.
POSITION_BITS = 20
UNIT = 1 << (POSITION_BITS - 1)
#: Bytes of spans in one index.
BLOCK_BYTES = 1 << 19
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Stretches of gram offsets into which the spans of a gram are cut that fill more than a block.
SLOTS = 6


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2 ** 64 for i < n, by doubling."""
    out, step = np.ones(n, np.uint64), base
    done = 1
    while done < n:
        m = min(done, n - done)
        out[done : done + m] = out[:m] * np.uint64(step)
        done, step = done + m, step * step % (1 << 64)
    return out


_UP: list[np.ndarray] = []


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed polynomial hash of each ``gram`` bytes."""
    if not _UP:
        _UP.extend(_powers(b, 1 << POSITION_BITS) for b in (BASE, INVERSE))
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _UP[0][:n], out=prefix[1:])
    h = (prefix[gram:] - prefix[:-gram]) * _UP[1][: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def owners(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For the texts that stand one after another in ``data`` and end at ``ends``: the gram hash, the first and last
    window start of each run of windows with one minimizer, and the minimizer's place."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < length:
        return none
    h = gram_hashes(data, gram)
    mask = np.uint64((1 << POSITION_BITS) - 1)
    key = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    width, low = 1, key
    grams = length - gram + 1
    while 2 * width <= grams:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (grams - width)], low[grams - width :]) if grams > width else low
    valid = np.ones(len(low), bool)
    inside = np.zeros(len(data) + 1, np.int32)
    starts = np.maximum(ends - length + 1, np.concatenate([[0], ends[:-1]]))
    np.add.at(inside, starts, 1)  # windows from here on would cross the end of the text
    np.add.at(inside, ends, -1)
    valid = np.cumsum(inside[: len(low)]) == 0
    at = np.flatnonzero(valid)
    if not len(at):
        return none
    place = (low[at] & mask).astype(np.int64)
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return h[place[first]], at[first], at[last], place[first]


def _units(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Texts laid one after another in units of bounded bytes; a longer text continues in further units that
    overlap by ``length`` - 1 bytes. Yields the bytes, the ends, and (text, offset in it) for each part."""
    parts, size, where = [], 0, []
    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        for lo in range(0, len(t) - length + 1, UNIT // 2):
            part = t[lo : lo + UNIT // 2 + length - 1]
            if size + len(part) > UNIT and parts:
                yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), where
                parts, size, where = [], 0, []
            parts.append(part)
            where.append((k, lo))
            size += len(part)
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), where


SPANS = "row long, start int, width int, at int, gram long, digest long"


def _spans(length: int, gram: int):
    """Rows of ``SPANS`` from rows (row, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 256):
                part = batch.slice(cut, 256)
                ids, texts = part.column(0), part.column(1).to_pylist()
                for data, ends, where in _units(texts, length):
                    grams, first, last, place = owners(data, ends, length, gram)
                    buffer = data.tobytes()
                    digests = np.fromiter((xxhash.xxh3_64_intdigest(buffer[a : b + length]) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
                    piece = np.searchsorted(ends, first, side="right")
                    begins = np.concatenate([[0], ends[:-1]])
                    text = np.array([k for k, _ in where])[piece]
                    start = first - begins[piece] + np.array([lo for _, lo in where])[piece]
                    columns = [ids.take(pa.array(text)), pa.array(start, pa.int32()), pa.array(last - first, pa.int32()), pa.array(place - first, pa.int32()), pa.array(grams.view(np.int64)), pa.array(digests.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["row", "start", "width", "at", "gram", "digest"])

    return run


class RunIndex:
    """Run-length Burrows-Wheeler index of byte strings, with suffix samples at the ends of its runs.

    ``text`` holds the strings with a separator of its own after each, so no match crosses one. Suffixes are
    sorted by prefix doubling: two ranks and a position share one 64-bit key. The ranks of each doubling stay
    until the matches across run borders are measured; what remains are the runs, the samples and the lengths.
    """

    def __init__(self, strings: list[bytes], longest: int) -> None:
        k = len(strings)
        n = sum(map(len, strings)) + k
        text = np.empty(n, np.int64)
        at = 0
        for i, s in enumerate(strings):
            text[at : at + len(s)] = np.frombuffer(s, np.uint8).astype(np.int64) + k
            text[at + len(s)] = i
            at += len(s) + 1
        bits = max(int(n).bit_length(), (k + 256).bit_length())
        if 3 * bits > 63:
            raise ValueError("too many bytes for one index")
        ranks, step, order = [text], 1, np.arange(n)
        while True:
            nxt = np.zeros(n, np.int64)
            nxt[: n - step] = ranks[-1][step:] + 1
            key = np.sort((ranks[-1] << (2 * bits)) | (nxt << bits) | np.arange(n))
            order = key & ((1 << bits) - 1)
            pair = key >> bits
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(pair[1:] != pair[:-1])])
            if step * 2 > longest:
                break
            ranks.append(rank)
            step *= 2
        bwt = text[order - 1]
        head = np.flatnonzero(bwt[1:] != bwt[:-1]) + 1
        self.n, self.symbols, self.heads = n, bwt[np.concatenate([[0], head])], head
        #: Suffixes at the first row of each run but the first, and at the last row of the run before it.
        self.head_samples, self.tail_samples = order[head], order[head - 1]
        a, b, common = self.head_samples.copy(), self.tail_samples.copy(), np.zeros(len(head), np.int64)
        for i in range(len(ranks) - 1, -1, -1):
            for _ in range(2 if i == len(ranks) - 1 else 1):
                same = (a < n) & (b < n)
                same[same] = ranks[i][a[same]] == ranks[i][b[same]]
                common += same << i
                a, b = a + (same << i), b + (same << i)
        self.border = common

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match that starts there and elsewhere, streamed from the samples."""
        top = np.zeros(self.n, np.int64)
        np.maximum.at(top, self.head_samples, self.border)
        np.maximum.at(top, self.tail_samples, self.border)
        at = np.arange(self.n)
        return np.maximum(np.maximum.accumulate(top + at) - at, 0)


def repeated_windows(strings: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each string the starts of its windows of ``length`` bytes that also start elsewhere in the strings."""
    statistics = RunIndex(strings, max(map(len, strings)) + 1).matching_statistics()
    out, at = [], 0
    for s in strings:
        out.append(np.flatnonzero(statistics[at : at + len(s)] >= length))
        at += len(s) + 1
    return out


def _runs(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if len(starts):
        cut = np.flatnonzero(np.diff(starts) != 1)
        yield from zip(starts[np.concatenate([[0], cut + 1])].tolist(), starts[np.concatenate([cut, [len(starts) - 1]])].tolist(), strict=True)


class Beside:
    """A side table in files sorted by ``row``, read along with rows that mostly ascend. ``files`` has the URI, the
    lowest and the highest row of each; a row below the one before makes it look for its place anew."""

    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        self.files, self.before, self.batches, self.rows, self.columns = files, None, iter(()), np.zeros(0, np.int64), []

    def _batches(self, row: int) -> Iterator[pa.RecordBatch]:
        for uri, _, high in self.files:
            if high >= row:
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as f, pq.ParquetFile(f) as file:
                    at = file.schema_arrow.get_field_index("row")
                    useful = [g for g in range(file.num_row_groups) if (s := file.metadata.row_group(g).column(at).statistics) is None or not s.has_min_max or s.max >= row]
                    yield from file.iter_batches(1 << 15, row_groups=useful)

    def _next(self) -> bool:
        batch = next(self.batches, None)
        if batch is None:
            self.rows = np.zeros(0, np.int64)
            return False
        self.rows = batch.column("row").to_numpy()
        self.columns = [batch.column(c) for c in batch.schema.names if c != "row"]
        return True

    def get(self, row: int) -> list[tuple]:
        """The records of a row, without the row."""
        far = len(self.rows) and self.rows[-1] + (1 << 20) < row
        if self.before is None or row < self.before or far:
            self.batches = self._batches(row)
            self._next()
        self.before, found = row, []  # without rows the end has been reached
        while len(self.rows):
            low, high = np.searchsorted(self.rows, row), np.searchsorted(self.rows, row, side="right")
            if low < high:
                found += zip(*(c.slice(low, high - low).to_pylist() for c in self.columns), strict=True)
            if high < len(self.rows) or not self._next():
                break
        return found


def _write_beside(table: DataFrame, name: str) -> list[tuple[str, int, int]]:
    """Write a side table (with ``row``) for ``Beside``; its files with their lowest and highest rows, of which there
    are as many as shuffle partitions."""
    path = scratch(table.sparkSession, name)
    # Small row groups, so that a task skips most of a file that it shares with others.
    table.repartitionByRange("row").sortWithinPartitions("row").write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(path)
    stored = table.sparkSession.read.schema("row long").parquet(path)
    files = stored.groupBy(F.input_file_name().alias("file")).agg(F.min("row").alias("low"), F.max("row").alias("high"))
    return sorted(((r.file, r.low, r.high) for r in files.collect()), key=lambda x: x[1:])


SLICES = "gram long, digest long, copies int, at int, width int, hot boolean, span binary"


def _slices(files: list[tuple[str, int, int]], length: int):
    """The wanted spans' bytes, from rows (row, text as bytes) and the side table (start, width, at, gram, digest,
    copies, hot)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Beside(files)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, out = batch.slice(lo, 512), []
                for row, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    spans = wanted.get(row)
                    if spans:
                        text = text.as_py()
                        out += [(gram, digest, copies, at, width, hot, text[start : start + width + length]) for start, width, at, gram, digest, copies, hot in spans]
                columns = zip(*out, strict=True) if out else [[]] * 7
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["gram", "digest", "copies", "at", "width", "hot", "span"])

    return run


PIECES = "cell long, gram long, digest long, copies int, base int, span binary"
_PIECE_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())


def pieces_of(span: bytes, at: int, width: int, length: int, gram: int) -> Iterator[tuple[bytes, int, bytes]]:
    """For each stretch of gram offsets the bytes that its windows share, its first window and the bytes of its windows.
    The windows of ``span`` start at 0 to ``width``; the one at i has the gram at offset ``at`` - i."""
    offsets = length - gram + 1
    for k in range(SLOTS):
        low, high = offsets * k // SLOTS, offsets * (k + 1) // SLOTS  # offsets low to high - 1
        first, last = max(0, at - high + 1), min(width, at - low)
        if first <= last:
            shared = span[at - low : at + gram + length - gram - (high - 1)]
            yield bytes([k]) + shared, first, span[first : last + length]


def _cut_pieces(length: int, gram: int):
    """Rows of ``PIECES`` from rows (gram, digest, copies, at, width, span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out = []
                for g, digest, copies, at, width, span in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns), strict=True):
                    for shared, base, piece in pieces_of(span, at, width, length, gram):
                        cell = xxhash.xxh3_64_intdigest(shared, g & 0xFFFFFFFFFFFFFFFF)
                        out.append((cell - (1 << 64) if cell >> 63 else cell, g, digest, copies, base, piece))
                columns = zip(*out, strict=True) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _PIECE_TYPES, strict=True)], names=["cell", "gram", "digest", "copies", "base", "span"])

    return run


FOUND = "gram long, digest long, first int, last int"


def _match_blocks(length: int, block_bytes: int):
    """Rows of ``FOUND`` (first and last repeated window of a span, counted from its start) from rows of ``PIECES`` that
    come sorted by cell; cells fill blocks one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def match() -> pa.RecordBatch:
            strings = [r[5] for r in held] + [r[5] for r in held if r[3] > 1]
            rows = []
            if len(strings) > 1:
                for (_, gram, digest, _, base, _), found in zip(held, repeated_windows(strings, length), strict=False):
                    rows += [(gram, digest, base + a, base + b) for a, b in _runs(found)]
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["gram", "digest", "first", "last"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= block_bytes and row[0] != held[-1][0]:
                    yield match()
                    held, size = [], 0
                held.append(row)
                size += row[3] * (len(row[5]) + 1)
        yield match()

    return run


def _windows(length: int):
    """A row (gram, digest, at, copies, window digest) for each window in rows (gram, digest, copies, base, span)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 512):
                columns = (c.to_pylist() for c in batch.slice(cut, 512).columns)
                rows = [(g, d, base + o, n, xxhash.xxh3_128_digest(t[o : o + length])) for g, d, n, base, t in zip(*columns, strict=True) for o in range(len(t) - length + 1)]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["gram", "digest", "at", "copies", "window"])

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _cut(files: list[tuple[str, int, int]], length: int):
    """Result rows from rows (doc_id, row, text as bytes) and the side table of marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Beside(files)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part, rows = batch.slice(lo, 512), []
                for doc_id, row, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    kept, at, removed, spans, end = [], 0, 0, 0, -1
                    for a, last in sorted(marks.get(row)):
                        b = last + length
                        if a > end:
                            kept.append(text[at:a])
                            spans += 1
                            end = a
                        removed += max(0, b - max(a, end))
                        at = end = max(end, b)
                    kept.append(text[at:])
                    rows.append((doc_id, len(text), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT.types, strict=True)], schema=RESULT)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = written(docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.monotonically_increasing_id().alias("row")), "documents")

    spans = written(rows.where(F.octet_length("text") >= length).select("row", "text").mapInArrow(_spans(length, gram), SPANS), "spans")
    # Written before and after the join, so that nothing binds its sides and hot grams can be split.
    often = written(spans.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), "often")
    spans = written(spans.join(often, "gram"), "repeated")
    kind, place = ["gram", "digest"], F.struct("row", "start", "width", "at")
    distinct = written(spans.groupBy(*kind).agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("copies"), F.min(place).alias("one")), "distinct")

    # Spans of a gram that fills more than a block are hot.
    volume = distinct.groupBy("gram").agg(F.sum((F.col("one.width") + length + 1) * F.col("copies")).alias("bytes"))
    wanted = distinct.join(written(volume, "volume"), "gram").select("one.row", "one.start", "one.width", "one.at", *kind, "copies", (F.col("bytes") > block_bytes).alias("hot"))
    slices = written(rows.select("row", "text").mapInArrow(_slices(_write_beside(wanted, "wanted"), length), SLICES), "slices")
    piece = ["cell", *kind, "copies", "base", "span"]
    pieces = slices.where("NOT hot").select(F.xxhash64("gram").alias("cell"), *kind, "copies", F.lit(0).alias("base"), "span")
    hot = slices.where("hot")
    digests = []
    if not hot.isEmpty():
        cut = written(hot.select(*kind, "copies", "at", "width", "span").mapInArrow(_cut_pieces(length, gram), PIECES), "pieces")
        over = written(cut.groupBy("cell").agg(F.sum((F.octet_length("span") + 1) * F.col("copies")).alias("bytes")).where(F.col("bytes") > block_bytes).select("cell"), "over")
        pieces = pieces.union(cut.join(over, "cell", "left_anti").select(*piece))
        # The windows of cells that are too large even so meet again by digest.
        windows = cut.join(over, "cell", "left_semi").select(*kind, "copies", "base", "span").mapInArrow(_windows(length), "gram long, digest long, at int, copies int, window binary")
        windows = written(windows, "windows")
        again = written(windows.groupBy("window").agg(F.sum("copies").alias("n")).where("n > 1").select("window"), "again")
        digests = [windows.join(again, "window", "left_semi").select(*kind, F.col("at").alias("first"), F.col("at").alias("last"))]
    found = pieces.select(*piece).repartition("cell").sortWithinPartitions("cell").mapInArrow(_match_blocks(length, block_bytes), FOUND)
    for more in digests:
        found = found.union(more)

    # Every copy of a span has the result of its group.
    marks = spans.join(written(found, "found"), kind).select("row", (F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    return rows.select("doc_id", "row", "text").mapInArrow(_cut(_write_beside(marks, "marks"), length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
