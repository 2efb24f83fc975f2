import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import xxhash

from aerolith import runtime
from aerolith.llm import packing, queries, simhash
from tests.conftest import SF


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = [brute_print(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        ids[find(i)].append(doc)
    low = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(d, f"{prints[i]:016x}", low[find(i)]) for i, (d, _) in enumerate(rows)]


def key(rows):
    return sorted((str(a), b, str(c)) for a, b, c in rows)


def near(seed=5, n=60):
    rng = random.Random(seed)
    words = [f"w{rng.randrange(400)}" for _ in range(300)]
    rows = []
    for i in range(n):
        own = list(words)
        for _ in range(i % 6):
            own[rng.randrange(300)] = f"x{rng.randrange(99)}"
        rows.append((1000 + i, " ".join(own)))
    return rows


def test_components_equal_brute_force(make_docs, odd_rows):
    rows = [*odd_rows, *near()]
    got = [tuple(r) for r in simhash.near_duplicates(make_docs(rows)).collect()]
    assert key(got) == key(brute_components(rows))


def test_query_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert key(tuple(r) for r in queries.op7_simhash(spark, SF).collect()) == key(brute_components(docs))


def test_bit_sliced_pairs_equal_popcount():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    prints = np.repeat(base, 15)
    for i in range(len(prints)):
        for b in rng.choice(64, rng.integers(0, 8), replace=False):
            prints[i] ^= np.uint64(1) << np.uint64(b)
    blocks = -(-len(prints) // 64)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(blocks), np.arange(blocks)))
    for radius in (0, 1, 2, 3, 4, 7, 20, 31):
        got = {(int(i), int(j)) for x, y in simhash.Slices(prints).within(a, b, radius) for i, j in zip(x, y, strict=True)}
        assert got == {(i, j) for i in range(len(prints)) for j in range(len(prints)) if (int(prints[i]) ^ int(prints[j])).bit_count() <= radius}
    long = np.column_stack([prints, prints[::-1]])
    far = np.bitwise_count(long[:, None] ^ long[None]).sum(axis=2)
    for radius in (5, 44, 64):
        got = {(int(i), int(j)) for x, y in simhash.Slices(long).within(a, b, radius) for i, j in zip(x, y, strict=True)}
        assert got == set(zip(*(v.tolist() for v in np.nonzero(far <= radius)), strict=True))


def test_tiles_lose_no_link(spark):
    rng = np.random.default_rng(2)
    prints = {int(p) for p in rng.integers(0, 1 << 12, 300)} | {(1 << 40) + (1 << i) for i in range(30)}
    prints = np.array(sorted(prints), np.int64)
    df = spark.createDataFrame([(int(p),) for p in prints], "fp long")
    roots = [{r.fp: r.root for r in simhash.classes(df, *how).collect()} for how in ((4096,), (4,), (64, 7), (64, 8))]
    same = [{frozenset(k for k in r if r[k] == v) for v in r.values()} for r in roots]
    assert all(s == same[0] for s in same) and len(same[0]) >= 1


def brute_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """The smallest doc_id of each component of pairs at Jaccard 0.8 or more (sets without shingles are equal)."""
    sets, parent = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    best = {}
    for i, (doc, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (doc is None, doc or 0))
    return sorted("None" if none else str(doc) for none, doc in best.values())


def edited(seed=6, families=12, copies=8):
    """Copies at similarities around 0.8, and chains of copies of copies."""
    rng = random.Random(seed)
    rows = []
    for f in range(families):
        base = [f"f{f}w{rng.randrange(900)}" for _ in range(rng.choice([12, 60, 200, 400]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randrange(1 + len(own) // 30)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
            rows.append((1000 + len(rows), " ".join(own)))
            if f % 3 == 0:
                base = own
    rng.shuffle(rows)
    return rows


def kept(docs):
    return sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect())


def test_one_of_each_component_stays_as_by_brute_force(spark, make_docs, odd_rows):
    rows = [*odd_rows, *edited()]
    want = brute_kept(rows)
    assert len(set(want)) < len({d for d, _ in rows})
    assert kept(make_docs(rows)) == want


def test_one_of_each_component_stays_as_by_brute_force_on_documents(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    assert kept(docs) == brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_families_over_several_tiles(spark, make_docs):
    """A family that is dealt over pairs of small tiles gives the same classes."""
    rows = edited(seed=7, families=3, copies=40)
    table = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in rows], "row long, text binary")
    one = table.mapInArrow(simhash._sketched, simhash.SKETCH).withColumnRenamed("row", "id")
    found = []
    for tile, size in ((8, 1 << 30), (1 << 20, 1 << 14), (1 << 20, 1 << 30)):
        root = {r.node: r.root for r in simhash.resembling(one, table.withColumnRenamed("row", "id"), tile, size).collect()}
        found.append({frozenset(k for k in root if root[k] == v) for v in root.values()})
    assert found[0] == found[1] == found[2] and len(found[0]) > 2


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, "x", 1), (2, "A  b", 5, 6, "y", 2)], "doc_id long, text string, __fp int, row int, `doc` string, bands int")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and [tuple(r) for r in out.collect()] == [(1, "a b", 5, 6, "x", 1)]


def test_empty(make_docs):
    assert simhash.near_duplicates(make_docs([])).count() == 0
    assert simhash.keep_one(make_docs([])).count() == 0


def test_files_do_not_grow_with_the_shuffle_partitions(spark, make_docs, monkeypatch):
    """Where Spark merges no small partitions, tables after a shuffle still make a file for each core at most."""
    rows, made = edited(seed=8, families=6, copies=5), []
    docs = make_docs(rows)
    want = kept(docs)
    scratch, cores = runtime.scratch, spark.sparkContext.defaultParallelism
    monkeypatch.setattr(runtime, "scratch", lambda *a: made.append(scratch(*a)) or made[-1])
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merging, "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        assert kept(docs) == want
        assert simhash.keep_one(docs).rdd.getNumPartitions() <= cores
        assert packing.pack(docs).rdd.getNumPartitions() <= cores
    finally:
        spark.conf.unset(merging)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = [len(list(Path(folder.removeprefix("file://")).glob("part-*"))) for folder in made]
    assert len(files) > 10 and max(files) <= cores
