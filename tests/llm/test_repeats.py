import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from aerolith.llm import queries, repeats
from tests.conftest import SF


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        gone = gone[: len(b)]
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((str(i), len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abéd") for _ in range(rng.randrange(1, 6)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(40):
        own = [word() for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            own.insert(rng.randrange(len(own)), passage[rng.randrange(40) : len(passage) - rng.randrange(40)])
        if i % 7 == 0:
            own += ["ab"] * 150
        rows.append((i, " ".join(own)))
    rows += [(100 + i, rows[i][1]) for i in (1, 2, 3)]
    rows += [(200 + i, rows[i][1].replace("a", "b", 3)) for i in range(5)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [300, 1 << 19])
def test_equals_brute_force(make_docs, odd_rows, seed, block):
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000] + corpus(seed)
    assert got(repeats.remove_repeats(make_docs(rows), 60, 24, block)) == brute(rows, 60)


def test_production_parameters(make_docs):
    rows = corpus(9)
    assert got(repeats.remove_repeats(make_docs(rows))) == brute(rows, 200)


def test_long_and_periodic_texts(make_docs):
    rng = random.Random(4)
    long_text = "".join(rng.choice("abcdefgh") for _ in range(700_000))
    rows = [(1, long_text), (2, long_text[600_000:] + long_text[:150]), (3, "xy" * 2000), (None, "xy" * 101), (3, "xy" * 2000)]
    result = {(str(r.doc_id), r.n_bytes): r.n_removed for r in repeats.remove_repeats(make_docs(rows)).collect()}
    assert result == {("1", 700_000): 100_000, ("2", 100_150): 100_000, ("3", 4000): 4000, ("None", 202): 202}


def test_query_on_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op8_repeats(spark, SF)) == brute(docs, 200)


def test_run_index():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 50))) for _ in range(30)]
    at = defaultdict(set)
    for i, s in enumerate(strings):
        for k in range(len(s)):
            for n in range(1, len(s) - k + 1):
                at[s[k : k + n]].add((i, k))
    want = [max((n for n in range(1, len(s) - k + 1) if len(at[s[k : k + n]]) > 1), default=0) for s in strings for k in range(len(s))]
    index = repeats.RunIndex(strings, 51)
    statistics = index.matching_statistics()
    keep = np.concatenate([[True] * len(s) + [False] for s in strings])
    assert statistics[keep].tolist() == want
    assert len(index.head_samples) == len(index.symbols) - 1 < index.n


def test_empty(make_docs):
    assert repeats.remove_repeats(make_docs([])).count() == 0


def test_hot_grams_come_through_the_index(make_docs, monkeypatch):
    """A phrase in many contexts, some of them shared, fills more than a block, but no cell of its pieces does."""

    def none(length):
        def run(batches):
            for batch in batches:
                assert not batch.num_rows
            return iter(())

        return run

    monkeypatch.setattr(repeats, "_windows", none)
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    phrase, rows = "the very same phrase of all", []
    shared = [(noise(50), noise(50)) for _ in range(12)]
    for i in range(150):
        before, after = (noise(50), noise(50)) if i % 3 else shared[rng.randrange(12)]
        cut = rng.randrange(50) if i % 5 == 0 else 0
        rows.append((i, noise(40) + before[cut:] + phrase + after[: 50 - cut] + noise(40)))
    assert sum(len(t) for _, t in rows) > 10_000
    assert got(repeats.remove_repeats(make_docs(rows), 60, 24, 4000)) == brute(rows, 60)


def test_side_rows_in_any_order(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(50) * (1 << 33) + rng.randrange(300), k) for k in range(5000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    files = repeats._write_beside(spark.createDataFrame(rows, "row long, k int").repartition(4), "side")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) > 1
    want = defaultdict(list)
    for row, k in rows:
        want[row].append((k,))
    beside = repeats.Beside(files)
    ascending = sorted(want) + [7 * (1 << 33) + 299 + i for i in range(3)]
    for order in (sorted(ascending), rng.sample(ascending, 200), sorted(want)[1000:2000], [0, 1, 2, 0]):
        for row in order:
            assert sorted(beside.get(row)) == sorted(want.get(row, []))
    assert repeats.Beside([]).get(5) == []
    opened = []
    beside._batches = lambda row: (opened.append(row), iter(()))[1]
    assert all(beside.get((1 << 40) + i) == [] for i in range(100)) and len(opened) <= 1
