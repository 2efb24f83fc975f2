import zlib
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from aerolith.llm import queries, sharding
from aerolith.llm.sharding import CapacityTree, best_fit_decreasing, fit_into, shard_documents
from tests.conftest import SF


@given(st.lists(st.tuples(st.integers(1, 60), st.integers(1, 5)), max_size=12, unique_by=lambda x: x[0]), st.integers(20, 60))
def test_runs_equal_best_fit_decreasing_item_by_item(histogram, capacity):
    bins = []
    for size in sorted((s for s, c in histogram for _ in range(c)), reverse=True):
        fits = [(r, b) for b, r in enumerate(bins) if r >= size]
        if fits:
            bins[min(fits)[1]] -= size
        else:
            bins.append(max(capacity, size) - size)
    runs, n = best_fit_decreasing(histogram, capacity)
    left = defaultdict(int)
    for size, low, high, b in runs:
        left[b] += size * (high - low)
    assert n == len(bins)
    oversize = [max(capacity, next(s for s, *_, b in runs if b == k)) for k in range(n)]
    assert [oversize[b] - left[b] for b in range(n)] == bins


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 9)), unique=True, min_size=1), st.integers(0, 31))
def test_capacity_tree_takes_the_tightest(keys, size):
    tree = CapacityTree()
    for k in keys:
        tree.add(*k)
    assert tree.take_tightest(size) == min((k for k in keys if k[0] >= size), default=None)


@given(st.lists(st.tuples(st.integers(1, 500), st.integers(1, 9)), max_size=20, unique_by=lambda x: x[0]), st.integers(1, 9))
def test_never_more_shards_than_asked(histogram, shards):
    runs = fit_into(histogram, shards)
    assert len({r[3] for r in runs}) <= shards
    assert sum(h - low for _, low, h, _ in runs) == sum(c for _, c in histogram)


def check(rows, texts, shards=8):
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        by_text[r.size, r.text_crc32].add(r.shard)
    assert len(rows) == len(texts)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())
    expected = sorted((-1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.size, r.text_crc32) for r in rows) == expected
    return by_shard


def test_odd_rows(make_docs, odd_rows):
    check(shard_documents(make_docs(odd_rows)).collect(), odd_rows)


def test_empty(make_docs):
    assert shard_documents(make_docs([])).count() == 0


def test_query_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op2_sharding(spark, SF).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    loads = defaultdict(int)
    for r in rows:
        loads[r.shard] += r.size
    assert sorted(loads) == list(range(8)) and max(loads.values()) <= 1.01 * max(sum(loads.values()) / 8, max(r.size for r in rows))


def test_groups_of_one_size_into_many_bins(spark):
    """A class that visits many bins: every group gets its one bin, no bin is overfull, and each is used."""
    groups = spark.range(5000).select("id", F.lit(1000).alias("size")).union(spark.range(9000, 9100).select("id", F.lit(300).alias("size")))
    rows = sharding.shard_groups(groups, "size", capacity=7300).collect()
    assert len(rows) == 5100 and len({r.id for r in rows}) == 5100
    load = Counter()
    for r in rows:
        load[r.shard] += r.size
    assert max(load.values()) <= 7300 and len(load) == 715
    one = sharding.shard_groups(groups, "size", capacity=1 << 40).collect()
    assert {r.shard for r in one} == {0} and len(one) == 5100
