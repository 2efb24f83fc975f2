import random
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from aerolith.llm import decontamination as d
from aerolith.llm import queries
from tests.conftest import SF

ITEM = "The quick onerble foxes jumped over seventeen lazy dogs, and then (slowly) walked back home again while singing."
BENCH = "item_id long, text string, doc_id string"


def brute(pattern, text):
    """Least distance of the pattern to a substring, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@settings(max_examples=200)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90))
def test_myers_equals_the_table(pattern, text):
    assert d.Pattern(pattern).best(text)[0] == brute(pattern, text)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_no_occurrence_within_the_budget_is_missed(seed):
    rng = random.Random(seed)
    item = "".join(rng.choice("abcd ") for _ in range(rng.randrange(20, 120))).strip() or "x"
    own = list(item)
    for _ in range(rng.randrange(0, len(item) // 10 + 3)):
        at = rng.randrange(len(own))
        own[at : at + rng.randrange(2)] = [rng.choice("abcd")] * rng.randrange(3)
    text = "".join(rng.choice("abcd ") for _ in range(60)) + "".join(own) + "".join(rng.choice("abcd ") for _ in range(60))
    item, text = (d.normalised(x.encode()) for x in (item, text))
    budget, (best, end) = len(item) // 10, d.Pattern(d.bordered(item)).best(d.bordered(text))
    assert best == brute(d.bordered(item), d.bordered(text))
    assert d.Items([(7, item)]).matches(text) == ({0: (best, end)} if best <= budget else {})


def test_items_begin_and_end_at_words(spark, make_docs):
    bench = spark.createDataFrame([(1, "yes", ""), (2, "a", ""), (3, "the word", "")], BENCH)
    docs = make_docs([(1, "Many eyesores"), (2, "Yes, a word"), (3, "tithe words"), (4, "the... WORD")])
    assert {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()} == {(2, 1), (2, 2), (4, 3)}
    assert d.drop_leaks(docs, bench).count() == 4 and d.drop_leaks(docs, bench, least=8).count() == 3


def test_a_long_item_finishes():
    rng = random.Random(2)
    item = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(9000))[:50_000].strip()
    own = list(item)
    for _ in range(300):
        own[rng.randrange(len(own))] = "x"
    text = "before " + "".join(own) + " after " + item[10_000:30_000]
    began = time.perf_counter()
    (distance, end), = d.Items([(1, item)]).matches(text).values()
    assert 0 < distance <= 300 and abs(end - len(" before " + item + " ")) <= 1
    assert time.perf_counter() - began < 120


def test_query_equals_a_scan_of_whole_texts(spark):
    """Every item against every whole document of the smallest table, without pieces."""
    items = [(r.item_id, d.normalised(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {r.doc_id: d.normalised((r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id): (r.distance, r.end_byte) for r in queries.op1_decontamination(spark, SF).collect()}
    assert len({i for i, _ in got}) >= 3
    short = {i for i, t in docs.items() if len(t) < 1500 or i in {doc for doc, _ in got if len(docs[doc]) < 6000}}
    want = {}
    for i in short:
        for item, text in items:
            best = d.Pattern(d.bordered(text)).best(d.bordered(docs[i]))
            if best[0] <= len(text) // 10:
                want[i, item] = best
    assert {k: v for k, v in got.items() if k[0] in short} == want


def test_documents(spark, make_docs, odd_rows):
    edited = ITEM.replace("jumped", "jumpd").replace("seventeen", "sevenTEEN!!").replace("slowly", "slowely")
    far = " ".join(w[::-1] for w in ITEM.split())
    rows = [*odd_rows, (20, f"before {ITEM} after"), (21, "x " * 9000 + edited), (22, far), (23, ITEM[:60])]
    bench = spark.createDataFrame([(1, ITEM, "a"), (2, None, "b"), (3, "", "c"), (4, "...", "d"), (5, ITEM, "e"), (None, "an item that is nowhere to be found", "f")], BENCH)
    got = d.find_leaks(make_docs(rows), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(20, 1, 0), (20, 5, 0), (21, 1, 2), (21, 5, 2)]
    kept = d.drop_leaks(make_docs(rows), bench)
    assert kept.columns == make_docs(rows).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in (20, 21))


def test_blocks_of_items(spark, make_docs, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 100)
    monkeypatch.setattr(d, "HELD_BYTES", 300)
    bench = spark.createDataFrame([(i, f"{ITEM} number {i * 1117}", "") for i in range(8)], BENCH)
    docs = make_docs([(i, f"start {ITEM} number {i * 1117} end") for i in range(8)])
    got = {(r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect() if r.distance == 0}
    assert got == {(i, i) for i in range(8)}
    assert d.drop_leaks(docs, bench).count() == 0


def test_empty_tables(spark, make_docs, odd_rows):
    none = spark.createDataFrame([], BENCH)
    assert d.find_leaks(make_docs(odd_rows), none).count() == 0
    assert d.drop_leaks(make_docs(odd_rows), none).count() == len(odd_rows)
    assert d.find_leaks(make_docs([]), spark.createDataFrame([(1, ITEM, "")], BENCH)).count() == 0
