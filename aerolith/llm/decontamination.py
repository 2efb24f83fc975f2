"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared as lower-cased bytes with runs of ASCII punctuation and white space as one space.
An item of m bytes may differ by m // 10 edits. Texts and items have a space before and after, so that an occurrence
begins and ends at whole words; a missing border is an edit. An item is cut into one piece more than its budget, so an
occurrence within the budget holds one piece unchanged: an Aho-Corasick automaton over all pieces finds these hits in
one pass. Each hit climbs a binary tree of neighbouring pieces, where p pieces may have p - 1 errors; some hit of a true
occurrence passes every level. A node is tested once for each stretch of text as long as its errors, with Myers'
bit-parallel edit distance, up to the first place within its errors; the root, the whole item, over the whole stretch.

The items are written once to the shared folder in blocks of bounded bytes. A task holds a bounded number of bytes of
documents and takes the blocks through them one after another, so the documents are read once whatever the benchmark's
size.

Defined results: null or empty texts match nothing; items that are null or without letters or digits are skipped;
``drop_leaks`` also skips items of under ``LEAST_BYTES`` compared bytes, which are no passages; null or repeated
``doc_id`` or ``item_id`` values are carried; repeated documents repeat their rows, items equal in id and text are one,
equal texts are reported under each id; an empty table on either side gives no matches; other columns, whatever their
names, are ignored by ``find_leaks`` and kept by ``drop_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import scratch, written

#: One edit is allowed for each so many bytes of an item.
BYTES_PER_EDIT = 10
#: Bytes of items in one automaton, and of documents that a task takes the blocks through.
BLOCK_BYTES = 1 << 20
HELD_BYTES = 32 << 20
#: ``drop_leaks`` takes items of fewer compared bytes for phrases of the language, not for leaked passages.
LEAST_BYTES = 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def normalised(data: bytes | None) -> str:
    """The compared form of UTF-8 bytes, one character for each byte."""
    return b" ".join((data or b"").translate(_TABLE).split()).decode("latin-1")


class Pattern:
    """Myers' bit vectors for one pattern."""

    def __init__(self, pattern: str) -> None:
        self.m = len(pattern)
        self.top = 1 << (self.m - 1)
        self.full = (1 << self.m) - 1
        self.peq: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, text: str, enough: int = -1) -> tuple[int, int]:
        """The least edit distance of the pattern to any substring of ``text``, and the end of the first such; the first
        distance of at most ``enough`` will do."""
        pv, mv, score, full, top, peq = self.full, 0, self.m, self.full, self.top, self.peq
        least, end = score, 0
        for at, c in enumerate(text, 1):
            eq = peq.get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | (full & ~(xh | pv))
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
                if score < least:
                    least, end = score, at
                    if least <= enough:
                        break
            ph <<= 1
            mh <<= 1
            pv = (mh | ~(xv | ph)) & full
            mv = ph & xv & full
        return least, end


class Node:
    """Pieces ``lo`` to ``hi`` of an item: p pieces may have p - 1 errors."""

    __slots__ = ("start", "end", "errors", "parent", "text", "_pattern")

    def __init__(self, start: int, end: int, errors: int, parent: Node | None, text: str) -> None:
        self.start, self.end, self.errors, self.parent, self.text, self._pattern = start, end, errors, parent, text, None

    @property
    def pattern(self) -> Pattern:
        self._pattern = self._pattern or Pattern(self.text[self.start : self.end])
        return self._pattern


def bordered(text: str) -> str:
    return f" {text} " if text else ""


class Items:
    """The automaton over the pieces of a block of items (compared forms), with the trees that verify hits."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.roots: list[Node] = []
        pieces: dict[str, list[tuple[int, Node]]] = {}
        for at, (_, text) in enumerate(items):
            budget, whole = len(text) // BYTES_PER_EDIT, bordered(text)
            cuts = [len(whole) * k // (budget + 1) for k in range(budget + 2)]
            self._tree(whole, cuts, 0, budget + 1, None, at, pieces)
        self.automaton = ahocorasick.Automaton()
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if pieces:
            self.automaton.make_automaton()

    def _tree(self, text, cuts, lo, hi, parent, at, pieces) -> None:
        node = Node(cuts[lo], cuts[hi], hi - lo - 1, parent, text)
        if parent is None:
            self.roots.append(node)
        if hi - lo == 1:
            pieces.setdefault(text[node.start : node.end], []).append((at, node))
            return
        mid = (lo + hi) // 2
        self._tree(text, cuts, lo, mid, node, at, pieces)
        self._tree(text, cuts, mid, hi, node, at, pieces)

    def matches(self, text: str) -> dict[int, tuple[int, int]]:
        """By item: the least distance within the budget to a stretch of a compared text, and the first place where
        such a stretch ends, counted in the text with its borders."""
        found: dict[int, tuple[int, int]] = {}
        if not self.roots or not text:
            return found
        text, tested = bordered(text), {}
        for last, (length, uses) in self.automaton.iter(text):
            for at, leaf in uses:
                start = last + 1 - length - leaf.start  # where the item would start without edits before the hit
                node = leaf if leaf.parent is None else leaf.parent
                while node is not None:
                    k = node.errors
                    cell = start // (k + 1)
                    passed = tested.get((node, cell))
                    if passed is None:
                        window = text[max(cell * (k + 1) + node.start - k, 0) : (cell + 1) * (k + 1) + node.end + k]
                        if node.parent is None:
                            distance, end = node.pattern.best(window)
                            passed = distance <= k
                            if passed:
                                place = distance, max(cell * (k + 1) - k, 0) + end
                                found[at] = min(found.get(at, place), place)
                        else:
                            passed = node.pattern.best(window, k)[0] <= k
                        tested[node, cell] = passed
                    if not passed:
                        break
                    node = node.parent
        return found


@lru_cache(maxsize=2)
def compiled(path: str, block: int, least: int) -> Items:
    """The automaton of a stored block, built where it is used; a worker keeps the last two."""
    fs, root = pafs.FileSystem.from_uri(path)
    table = pads.dataset(f"{root}/block={block}", filesystem=fs, format="parquet").to_table(columns=["item_id", "text"])
    items = ((i, normalised(t)) for i, t in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True))
    return Items(sorted((x for x in items if len(x[1]) >= max(least, 1)), key=repr))


def _store(benchmark: DataFrame) -> tuple[str, list[int]]:
    """The different items, written in blocks of about ``BLOCK_BYTES``: the folder and the blocks' numbers."""
    rows = written(benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text")).where("text is not null").distinct(), "benchmark")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    path = scratch(benchmark.sparkSession, "items")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int"))
    rows.repartition(n, "block").write.partitionBy("block").parquet(path)
    return path, sorted(r.block for r in rows.select("block").distinct().collect())  # a number for each block


def _held(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, list[str]]]:
    """Rows of up to ``HELD_BYTES`` of texts, or one row more, with the compared forms of the texts."""
    parts, texts, size = [], [], 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            parts.append(part)
            texts += [normalised(t) for t in part.column(column).cast(pa.binary()).to_pylist()]
            size += sum(map(len, texts[-part.num_rows :]))
            if size >= HELD_BYTES:
                yield pa.Table.from_batches(parts), texts
                parts, texts, size = [], [], 0
    if parts:
        yield pa.Table.from_batches(parts), texts


LEAKS = pa.schema([(c, pa.int64()) for c in ("doc_id", "item_id", "distance", "budget", "end_byte")])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance, budget, end_byte`` (in the compared form with its borders) for each item that a
    text holds."""
    path, blocks = _store(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _held(batches, 1):
            ids = table.column(0).to_pylist()
            for block in blocks:
                items, out = compiled(path, block, 1), []
                for doc_id, text in zip(ids, texts, strict=True):
                    out += [(doc_id, items.ids[at], d, items.roots[at].errors, end) for at, (d, end) in sorted(items.matches(text).items())]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], schema=LEAKS)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in LEAKS.names))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no item of ``least`` compared bytes or more, with all their columns."""
    at = docs.columns.index("text")
    path, blocks = _store(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, texts in _held(batches, at):
            clean = [True] * len(texts)
            for block in blocks:
                items = compiled(path, block, least)
                clean = [c and not items.matches(t) for c, t in zip(clean, texts, strict=True)]
            yield from table.filter(pa.array(clean, pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)
