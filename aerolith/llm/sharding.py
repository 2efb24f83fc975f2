"""Sharding: best-fit-decreasing bin packing of indivisible groups.

Groups of equal texts are sized and counted by size class. The classes, largest first, enter the bin with the
tightest remaining capacity that takes them; the bins stand in a balanced search tree. Only the histogram of
size classes reaches the driver: sizes below 1024 are a class each, larger ones are rounded up to eleven
significant bits, so there are at most 1024 * 54 classes whatever the data. Within a class groups count as equal, each
as the largest size of the class: a bin is never overfull, and at most one part in 1024 of it stays empty for that
reason. Groups find their bin again by their rank within the class.

Defined results: a null text counts as the empty one (size 1, CRC 0); null or repeated ``doc_id`` values are
carried as they are; repeated rows stay together, being equal texts; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import gapless, numbered

SHARDS = 8
#: Sizes keep this many bits below the leading one.
CLASS_BITS = 10
#: Ranks of a class in which its groups meet their runs, and stretches of a run made at a time.
STRETCH, STEP = 64, 1 << 16


class CapacityTree:
    """Treap of ``(remaining capacity, bin)``: a search tree kept balanced by random heap priorities."""

    def __init__(self) -> None:
        self._root = None
        self._rng = random.Random(7)

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def _split(self, node, key):
        """The nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def add(self, remaining: int, bin_id: int) -> None:
        key = (remaining, bin_id)
        low, high = self._split(self._root, key)
        self._root = self._merge(self._merge(low, [key, self._rng.random(), None, None]), high)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Remove and return the bin with the least remaining capacity of at least ``size``."""
        low, high = self._split(self._root, (size, -1))
        key = None
        if high is not None:
            at = high
            while at[2] is not None:
                at = at[2]
            key = at[0]
            _, high = self._split(high, (key[0], key[1] + 1))
        self._root = self._merge(low, high)
        return key


def best_fit_decreasing(histogram: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Place ``(size, count)`` classes into bins of ``capacity``.

    Returns runs ``(size, first rank, last rank + 1, bin)`` and the number of bins. Items of one class that
    follow each other into the same bin are one run, which is what best fit does with equal sizes: the bin it
    has just used stays the tightest while it still fits. An item above the capacity gets a bin of its own.
    """
    tree, bins, runs = CapacityTree(), 0, []
    for size, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            found = tree.take_tightest(size)
            if found is None:
                found, bins = (max(capacity, size), bins), bins + 1
            remaining, b = found
            n = min(count - rank, remaining // size)
            runs.append((size, rank, rank + n, b))
            tree.add(remaining - n * size, b)
            rank += n
    return runs, bins


def fit_into(histogram: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """Best-fit-decreasing runs for the smallest capacity, by bisection, that needs at most ``shards`` bins.

    Mean load plus the largest size always suffices: a further bin would mean that every bin is fuller than
    the mean.
    """
    if not histogram:
        return []
    total, largest = sum(s * c for s, c in histogram), max(s for s, _ in histogram)
    low, high = max(-(-total // shards), largest), -(-total // shards) + largest
    best = best_fit_decreasing(histogram, high)[0]
    while low < high:
        mid = (low + high) // 2
        runs, bins = best_fit_decreasing(histogram, mid)
        if bins <= shards:
            best, high = runs, mid
        else:
            low = mid + 1
    return best


def size_class(size: F.Column) -> F.Column:
    """``size`` rounded up to eleven significant bits."""
    shift = F.greatest(F.length(F.bin(size)) - (CLASS_BITS + 1), F.lit(0))
    step = F.pow(F.lit(2.0), shift).cast("long")
    return F.ceil(size / step).cast("long") * step


def shard_groups(groups: DataFrame, size: str, shards: int = SHARDS, capacity: int | None = None) -> DataFrame:
    """Add ``shard`` to a table of indivisible groups of ``size`` >= 1.

    With ``capacity`` the number of shards is what best fit decreasing needs; otherwise the sizes of
    ``shards`` shards are made near equal.
    """
    spark = groups.sparkSession
    groups = numbered(groups.withColumn("__class", size_class(F.col(size))), "groups")
    histogram = [(r[0], r[1]) for r in groups.groupBy("__class").count().collect()]
    runs = best_fit_decreasing(histogram, capacity)[0] if capacity else fit_into(histogram, shards)
    plan = spark.createDataFrame(runs, "__class long, __low long, __high long, shard int")
    ranked = gapless(groups, "__class", "__rank")
    if not capacity:
        # A class visits a bin at most once: the plan has at most 1024 * 54 classes times ``shards`` rows.
        placed = ranked.join(F.broadcast(plan), "__class")
    else:
        # Groups and runs meet in stretches of STRETCH ranks; a run goes to each stretch that it touches (taken in two
        # steps, so that no array grows with it). So a group meets at most STRETCH runs, however many its class has.
        low, high = F.floor(F.col("__low") / STRETCH), F.floor((F.col("__high") - 1) / STRETCH)
        plan = plan.withColumn("__from", F.explode(F.sequence(low, high, F.lit(STEP).cast("long"))))
        plan = plan.withColumn("__stretch", F.explode(F.sequence(F.col("__from"), F.least(high, F.col("__from") + STEP - 1)))).drop("__from")
        placed = ranked.withColumn("__stretch", F.floor(F.col("__rank") / STRETCH)).join(plan, ["__class", "__stretch"]).drop("__stretch")
    placed = placed.where("__rank >= __low and __rank < __high")
    return placed.drop("__class", "__rank", "__low", "__high", "__pid", "__seq")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every row: equal texts share a shard, shard sizes are near
    equal, and slots count 0, 1, 2, ... within a shard."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("__hash"))
    rows = numbered(rows, "sizes")
    key = ["__hash", "text_crc32", "size"]
    groups = rows.groupBy(key).agg(F.count("*").alias("__copies")).withColumn("__bytes", F.col("__copies") * F.col("size"))
    placed = rows.join(shard_groups(groups, "__bytes", shards).select(*key, "shard"), key)
    return gapless(placed, "shard", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
