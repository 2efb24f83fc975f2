"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint takes, bit by bit, the majority of the XXH64 hashes (seed 42) of a text's word shingles. Candidates meet
in buckets, and inside a bucket the comparison is bit-sliced: 64 fingerprints stand side by side in the lanes of 64-bit
words, one word for each bit; XOR with a query's bit gives 64 difference bits at once, which carry-save adders sum into
counter planes; a pair of blocks is abandoned once all lanes of all its queries have passed the radius. Buckets of more
than two tiles are dealt out over pairs of tiles, so that no task holds a bucket of unbounded size; every pair of tiles
meets, so no link is lost. A task passes on a spanning forest of the links it finds, and connected components are
contracted over written tables.

* ``near_duplicates`` links fingerprints (64 bits, four words) that differ in at most four bits. Such fingerprints
  agree on B - 4 of B bit blocks at least, so each distinct fingerprint goes to the buckets of all choices of that many
  blocks; B grows with their number, so that a bucket's key keeps about as many bits as the number has.
* ``keep_one`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Such sets share
  one of ``BANDS`` hashes of ``BAND_ROWS`` minima (missed with a probability of 7e-6 at 0.8, computed for independent
  minima); mates in a band whose fingerprints (128 bits) are within ``WIDE`` bits are of one family (at 0.8 a pair's
  distance is near 19, with a deviation of 4). Inside a family, dealt over pairs of tiles of bounded bytes, the exact
  similarity of all pairs within that radius decides.

Defined results: a text without words (null, empty, blank) has fingerprint 0 and links like any other; for
``keep_one`` texts of the same lower-cased words are alike, so all texts without words are; null ``doc_id`` values are
never a component's name unless the whole component has none (then it is null); repeated rows are equal texts and share
a component; an empty table gives an empty result; other columns, whatever their names, are ignored by
``near_duplicates`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import components, packed, written

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 4
#: Up to this many distinct fingerprints, so many bit blocks.
BLOCKS_BY_COUNT = ((1 << 22, 6), (1 << 27, 7), (1 << 62, 8))
TILE = 4096
LANES = 64
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Steps of the carry-save adders between two looks at the radius, and pairs of blocks compared at a time.
LOOK, PAIRS = 4, 64
#: Rows that a task compares at a time, or one group more.
HELD_ROWS = 1 << 13

#: ``keep_one``: words of a shingle, least similarity as a fraction, bands of minima, radius of 128 bits, and bytes of
#: shingle hashes in a tile.
PIPELINE_WORDS = 5
ALIKE = (4, 5)
BANDS, BAND_ROWS = 30, 5
WIDE = 44
TILE_BYTES = 16 << 20
_RNG = np.random.default_rng(11)
_FLIP = _RNG.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32)
_TIMES = _RNG.integers(0, 1 << 32, (BANDS * BAND_ROWS, 1), dtype=np.uint32) | np.uint32(1)


def words_of(data: bytes | None) -> list[bytes]:
    """The words of UTF-8 bytes; bytes lower-case and split as ASCII does."""
    return (data or b"").lower().split()


def shingles(parts: list[bytes], words: int) -> np.ndarray:
    """The XXH64 hashes of a text's shingles, repeats included; fewer words are one shingle, none are none."""
    n = len(parts)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if n <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: n - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, n - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in over half of ``hashes``; 0 for none."""
    votes = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 8192):
        votes += np.unpackbits(hashes[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(data: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The SimHash of a text's UTF-8 bytes."""
    return majority(shingles(words_of(data), words))


def _csa(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save: three planes of one weight as one of that weight and one of twice the weight."""
    half = x ^ y
    return half ^ z, (x & y) | (half & z)


class Slices:
    """Fingerprints (n, words) in vertical layout: plane b of block k holds bit b of its 64 lanes."""

    def __init__(self, prints: np.ndarray) -> None:
        prints = prints.reshape(len(prints), -1)
        self.n, words = prints.shape
        self.bits, self.blocks = 64 * words, -(-self.n // LANES)
        lanes = np.zeros((self.blocks * LANES, words), np.uint64)
        lanes[: self.n] = prints
        bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").reshape(self.blocks, LANES, self.bits)
        #: planes[b, k]: bit b of the lanes of block k; lane_bits[b, k, lane]: bit b of one lane
        self.lane_bits = np.ascontiguousarray(bits.transpose(2, 0, 1))
        self.planes = np.ascontiguousarray(np.packbits(self.lane_bits, axis=2, bitorder="little")).view(np.uint64).reshape(self.bits, self.blocks)

    def differing(self, bit: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each lane of blocks ``a`` as a query, all ones where its bit is set, the lanes of ``b`` that differ."""
        return np.negative(self.lane_bits[bit][a].astype(np.uint64)) ^ self.planes[bit][b][:, None]

    def within(self, a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j) at distance ``radius`` or less, i in blocks ``a``, j in the blocks ``b`` beside them."""
        for lo in range(0, len(a), PAIRS):
            yield self._within(a[lo : lo + PAIRS], b[lo : lo + PAIRS], radius)

    def _within(self, a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        shape, none = (len(a), LANES), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        count = [np.zeros(shape, np.uint64) for _ in range(max(3, radius.bit_length()))]
        dead = np.zeros(shape, np.uint64)

        def over() -> np.ndarray:
            """Lanes whose count is above the radius, compared from the highest plane down."""
            more, equal = dead, ONES
            for k in range(len(count) - 1, -1, -1):
                if radius >> k & 1:
                    equal = equal & count[k]
                else:
                    more, equal = more | (equal & count[k]), equal & ~count[k]
            return more

        for step, bit in enumerate(range(0, self.bits, 7), 1):
            x = [self.differing(i, a, b) if i < self.bits else np.zeros(1, np.uint64) for i in range(bit, bit + 7)]
            s1, k1 = _csa(*x[:3])
            s2, k2 = _csa(*x[3:6])
            one, k3 = _csa(s1, s2, x[6])
            two, four = _csa(k1, k2, k3)
            carry = count[0] & one
            count[0] = count[0] ^ one
            count[1], carry = _csa(count[1], two, carry)
            count[2], carry = _csa(count[2], four, carry)
            for k in range(3, len(count)):
                count[k], carry = count[k] ^ carry, count[k] & carry
            dead = dead | carry
            if step % LOOK == 0 or bit + 7 >= self.bits:
                dead = over()
                alive = ~(dead == ONES).all(axis=1)
                if not alive.any():
                    return none
                if alive.sum() < 0.75 * len(a):
                    a, b, dead = a[alive], b[alive], dead[alive]
                    count = [c[alive] for c in count]
        close = ~dead
        pair, query = np.nonzero(close)
        if not len(pair):
            return none
        hits = np.unpackbits(close[pair, query].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(hits)
        i, j = a[pair[at]] * LANES + query[at], b[pair[at]] * LANES + lane
        real = (i < self.n) & (j < self.n)
        return i[real], j[real]


class Forest:
    """Union-find over row numbers; whole arrays of edges are first thinned to those that still join something."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            r = self.roots()
            p, q = r[i], r[j]
            apart = p != q
            if not apart.any():
                return
            i, j, p, q = i[apart], j[apart], p[apart], q[apart]
            np.minimum.at(self.parent, np.maximum(p, q), np.minimum(p, q))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A row for each tree edge: child and root."""
        roots = self.roots()
        child = np.flatnonzero(roots != np.arange(len(roots)))
        return child, roots[child]


def block_pairs(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of blocks of 64 rows that hold rows of one group; rows of a group stand together."""
    n = len(groups)
    first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    last = np.concatenate([first[1:], [n]]) - 1
    a, b = [np.arange(-(-n // LANES))], [np.arange(-(-n // LANES))]
    for lo, hi in zip(first // LANES, last // LANES, strict=True):
        if hi > lo:  # a group over several blocks: each pair of them
            i, j = np.triu_indices(hi - lo + 1, 1)
            a.append(i + lo)
            b.append(j + lo)
    pairs = np.unique(np.concatenate(a) * (n // LANES + 1) + np.concatenate(b))
    return pairs // (n // LANES + 1), pairs % (n // LANES + 1)


def near_sizes(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The sizes alone rule out a similarity where the smaller set is under that share of the larger."""
    return np.minimum(n, m) * ALIKE[1] >= np.maximum(n, m) * ALIKE[0]


def linked(prints: np.ndarray, groups: np.ndarray, radius: int = RADIUS, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as row numbers, of the links between fingerprints of the same group and near ``sizes``."""
    forest = Forest(len(prints))
    for i, j in Slices(prints).within(*block_pairs(groups), radius):
        real = (i != j) & (groups[i] == groups[j])
        if sizes is not None:
            real &= near_sizes(sizes[i], sizes[j])
        forest.add(i[real], j[real])
    return forest.links()


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many hashes the sets ``i`` and ``j`` share, pair by pair: products of 0/1 matrices over the shared hashes."""
    sides = []
    for rows in (np.unique(i), np.unique(j)):
        sides.append((rows, np.concatenate([sets[r] for r in rows]), np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])))
    (rows_a, hash_a, at_a), (rows_b, hash_b, at_b) = sides
    shared = np.intersect1d(hash_a, hash_b)
    common = np.zeros((len(rows_a), len(rows_b)), np.float32)
    for lo in range(0, len(shared), 1 << 14):
        part, flat = shared[lo : lo + (1 << 14)], []
        for rows, hashes, at in sides:
            place = np.minimum(np.searchsorted(part, hashes), len(part) - 1)
            hit = part[place] == hashes
            m = np.zeros((len(rows), len(part)), np.float32)
            m[at[hit], place[hit]] = 1
            flat.append(m)
        common += flat[0] @ flat[1].T
    return common[np.searchsorted(rows_a, i), np.searchsorted(rows_b, j)].astype(np.int64)


def alike(prints: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as row numbers, of the pairs of sets with a Jaccard similarity of 0.8 or more. Bit-sliced
    distances rule most pairs out; the others are counted exactly, 64 by 64, unless links already join them."""
    forest, size = Forest(len(sets)), np.array([len(s) for s in sets])
    for i, j in Slices(prints).within(*np.triu_indices(-(-len(sets) // LANES)), WIDE):
        real = (i < j) & near_sizes(size[i], size[j])
        i, j = i[real], j[real]
        block = i // LANES * len(sets) + j // LANES
        order = np.argsort(block, kind="stable")
        i, j, block = i[order], j[order], block[order]
        for part in np.split(np.arange(len(i)), np.flatnonzero(np.diff(block)) + 1):
            roots = forest.roots()
            part = part[roots[i[part]] != roots[j[part]]]
            if len(part):
                x, y = i[part], j[part]
                both = overlaps(sets, x, y)
                link = both * ALIKE[1] >= (size[x] + size[y] - both) * ALIKE[0]
                forest.add(x[link], y[link])
    return forest.links()


def _by_group(batches: Iterator[pa.RecordBatch], rows: int, weight: int | None = None) -> Iterator[pa.Table]:
    """Rows that come sorted by their first column, cut between groups into tables of ``rows`` rows, or as many bytes
    of column ``weight``, or one group more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows if weight is None else batch.column(weight).nbytes
        if n >= rows:
            table = pa.Table.from_batches(held)
            groups = table.column(0).to_numpy()
            cut = int(np.searchsorted(groups, groups[-1]))
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
            held, n = rest.to_batches(), rest.num_rows if weight is None else rest.column(weight).nbytes
    if held:
        yield pa.Table.from_batches(held)


def _edges(ids: np.ndarray, child: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[child]), pa.array(ids[root])], names=["a", "b"])


def _forests(radius: int, words: list[str], size: str | None = None) -> Callable:
    """Links ``(a, b)`` from rows ``(group, id, ...)`` sorted by group, whose columns ``words`` are the fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_group(batches, HELD_ROWS):
            if table.num_rows:
                prints = np.column_stack([table.column(w).to_numpy() for w in words]).view(np.uint64)
                sizes = table.column(size).to_numpy() if size else None
                yield _edges(table.column("id").to_numpy(), *linked(prints, table.column("group").to_numpy(), radius, sizes))

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows ``(group, id, lo, hi, set)`` sorted by group: the pairs of each group that are alike."""
    for table in _by_group(batches, 2 * TILE_BYTES, 4):
        groups = table.column("group").to_numpy()
        cuts = np.flatnonzero(np.diff(groups)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(groups)], strict=True):
            part = table.slice(at, end - at)
            if part.num_rows > 1:
                prints = np.column_stack([part.column(w).to_numpy() for w in ("lo", "hi")]).view(np.uint64)
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in part.column("set")]
                yield _edges(part.column("id").to_numpy(), *alike(prints, sets))


def _dealt(rows: DataFrame, tiles: DataFrame) -> DataFrame:
    """``rows`` (``bucket``, ``id``) with the ``group`` in which they meet: their bucket, or where ``tiles`` (``bucket``,
    ``tiles``) gives a bucket several, each pair of its tiles. Buckets that ``tiles`` lacks are left out. ``tiles`` is
    a written table and the join always shuffles both sides, so that hot buckets can be split."""
    rows = rows.join(tiles.hint("merge"), "bucket").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: (F.col("tiles") == 1) | (o != F.col("mine")))
    rows = rows.withColumn("other", F.explode(others))
    return rows.withColumn("group", F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other"))).drop("bucket", "tiles", "mine", "other")


def _tiles(share: Column) -> Column:
    """A number of tiles from a bucket's share of one: up to two are compared as one group."""
    return F.when(share <= 2, F.lit(1)).otherwise(F.ceil(share)).cast("int").alias("tiles")


def _met(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("group", "id", *columns).repartition("group").sortWithinPartitions("group")


def bucket_keys(fp: Column, blocks: int, radius: int = RADIUS) -> list[Column]:
    """A number for each choice of ``blocks - radius`` of the bit blocks, holding their bits."""
    edge = [64 * k // blocks for k in range(blocks + 1)]
    out = []
    for table, choice in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(table).cast("long")
        for k in choice:
            width = edge[k + 1] - edge[k]
            key = F.shiftleft(key, width) + F.shiftright(fp, edge[k]).bitwiseAND(F.lit((1 << width) - 1))
        out.append(key)
    return out


def classes(prints: DataFrame, tile: int = TILE, blocks: int | None = None) -> DataFrame:
    """``(fp, root)`` for the distinct fingerprints (column ``fp``) that have a link; root is one of its class."""
    distinct = written(prints.select("fp").distinct(), "distinct")
    n = distinct.count()
    blocks = blocks or next(b for most, b in BLOCKS_BY_COUNT if n <= most)
    rows = distinct.select(F.col("fp").alias("id"), F.explode(F.array(*bucket_keys(F.col("fp"), blocks))).alias("bucket"))
    tiles = written(rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket", _tiles(F.col("m") / tile)), "buckets")
    links = _met(_dealt(rows, tiles)).mapInArrow(_forests(RADIUS, ["id"]), "a long, b long")
    return components(links, "simhash").select(F.col("node").alias("fp"), "root")


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            prints = np.array([fingerprint(t) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    text = F.col("text").cast("string").cast("binary")
    rows = written(docs.select(F.col("doc_id").cast("long"), text).mapInArrow(_printed, "doc_id long, fp long"), "prints")
    named = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    # Written before and after the grouping, so that the joins are of plain shuffles and a hot class can be split.
    named = written(named.join(classes(rows), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    lowest = written(named.groupBy("root").agg(F.min("low").alias("component_id")), "lowest")
    named = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- the pipeline's stage


def bands(hashes: np.ndarray) -> list[int]:
    """The bands' hashes (as signed longs) of a set of shingles; none of an empty one."""
    if not len(hashes):
        return []
    short = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * BAND_ROWS, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(short), 256):
        x = short[None, lo : lo + 256] ^ _FLIP
        x *= _TIMES
        np.minimum(low, x.min(axis=1), out=low)
    rows = low.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _second(hashes: np.ndarray) -> np.ndarray:
    """Other hashes of the same shingles, for the second half of a fingerprint."""
    h = hashes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _sketch(data: bytes | None) -> tuple[np.ndarray, int, int]:
    """The sorted set of a text's shingle hashes and the halves of its fingerprint."""
    hashes = np.unique(shingles(words_of(data), PIPELINE_WORDS))
    return hashes, majority(hashes), majority(_second(hashes))


def _signed(numbers: list[int]) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


SKETCH = "row long, key binary, n long, lo long, hi long, bands array<long>"


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``SKETCH`` from rows (row, text as bytes, ...): a digest of the words, the number of different shingles,
    the fingerprint's halves and the bands; further columns follow."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts = part.column(1).to_pylist()
            keys = [xxhash.xxh3_128_digest(b" ".join(words_of(t))) for t in texts]
            sets, low, high = zip(*map(_sketch, texts), strict=True)
            columns = [part.column(0), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), _signed(low), _signed(high), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
            names = ["row", "key", "n", "lo", "hi", "bands"]
            yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names=[*names, *part.schema.names[2:]])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, bucket, lo, hi, set) from rows (id, bucket, text as bytes)."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            sets, low, high = zip(*map(_sketch, part.column(2).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), _signed(low), _signed(high), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "bucket", "lo", "hi", "set"])


def resembling(sketches: DataFrame, texts: DataFrame, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """``(node, root)`` of the rows that are alike. ``sketches`` has ``id, n, lo, hi, bands`` with a row for each
    different text, ``texts`` has ``id, text`` as bytes; both are written tables."""
    rows = sketches.select("id", F.explode("bands").alias("bucket"))
    mates = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket", _tiles(F.col("m") / tile))
    mates = written(packed(mates), "bands")
    # Fingerprints join the rows only once those without a mate are gone.
    mates = _dealt(rows, mates).join(sketches.select("id", "n", "lo", "hi"), "id")
    close = _met(mates, "n", "lo", "hi").mapInArrow(_forests(WIDE, ["lo", "hi"], "n"), "a long, b long")
    family = written(packed(components(close, "families").select(F.col("node").alias("id"), F.col("root").alias("bucket"))), "families")
    member = texts.join(family, "id").select("id", "bucket", "text").mapInArrow(_sets, "id long, bucket long, lo long, hi long, set binary")
    member = written(packed(member), "sets")
    share = F.greatest(F.sum(F.octet_length("set")) / tile_bytes, F.count("*") / tile)
    sizes = written(packed(member.groupBy("bucket").agg(_tiles(share))), "families")
    links = _met(_dealt(member, sizes), "lo", "hi", "set").mapInArrow(_verified, "a long, b long")
    return components(links, "resemblance")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the one with the smallest ``doc_id`` stays
    (null last; of rows with equal ``doc_id`` the first written)."""
    text = F.col("text").cast("string").cast("binary")
    rows = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text")), "rows")
    kind = rows.schema["doc_id"].dataType.simpleString()
    sketches = written(rows.select("row", "text", "doc_id").mapInArrow(_sketched, f"{SKETCH}, doc_id {kind}"), "sketches")
    mine = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    same = sketches.groupBy("key").agg(F.min("row").alias("id"), mine.alias("best"), F.min_by(F.struct("n", "lo", "hi", "bands"), "row").alias("s"))
    named = written(packed(same.select("id", "best", "s.*")), "texts")
    root = resembling(named, rows.select(F.col("row").alias("id"), "text")).withColumnRenamed("node", "id")
    best = named.select("id", "best").join(root, "id", "left").groupBy(F.coalesce("root", "id")).agg(F.min("best").alias("best"))
    return packed(rows.join(best.select(F.col("best.row").alias("row")), "row", "left_semi").select("doc.*"))
