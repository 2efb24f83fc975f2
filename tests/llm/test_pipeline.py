import pytest

import corpus_pipeline
from aerolith.llm import decontamination, pii
from tests.conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_leaks", "personal_data", "pack_sequences"]
    sizes, before = [], docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns
        before = spark.createDataFrame(after.collect(), docs.schema)
        sizes.append(before.count())
    assert docs.count() >= sizes[0] > sizes[1] > sizes[2] == sizes[3]
    texts = [r.text for r in before.collect()]
    assert not any(pii.spans(t) for t in texts)
    items = decontamination.Items([(r.item_id, decontamination.normalised(r.text.encode())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert not any(items.matches(decontamination.normalised(t.encode())) for t in texts)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, bucket string, __key string, spans string, item_id long"
BENCH = "item_id long, text string, doc_id string"
ITEM = "a passage of the benchmark that nobody should ever train on, with a comma"


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of tables, whose documents have columns that clash with those that the stages work with."""

    def make(rows, items):
        docs = [(i, t, lang, "s", len(t or ""), 1, "b", "k", "z", 7) for i, t, lang in rows]
        spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(items, BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return make


def sentences():
    """Clean documents in two languages, far apart from each other."""
    en, de = "the house stands near river and many people walk there in summer".split(), "das haus steht nahe fluss und viele menschen gehen dort im sommer".split()
    for i in range(60):
        for lang, words in (("en", en), ("de", de)):
            yield (2 * i + (lang == "de"), " ".join(words[(i * 7 + k * k + i * k) % len(words)] + ("" if k % 5 else f" {i * 31 + k}") for k in range(40)), lang)


def test_odd_documents(spark, folder, odd_rows):
    clean = list(sentences())
    odd = [(None if i is None else 1000 + i, t, None) for i, t in odd_rows]
    planted = [(2000, f"{clean[0][1]} {ITEM} end", "en"), (2001, clean[4][1], "en"), (2002, f"{' '.join(clean[6][1].split()[::-1])} mail a.b@c.org", None)]
    where = folder(clean + odd + planted, [(1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (4, "the", "x"), (1, ITEM, "x"), (None, "not there at all, nowhere", "x")])
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, where)
        assert after.columns == docs.columns
        docs = spark.createDataFrame(after.collect(), docs.schema)
        kept[name] = {r.doc_id for r in docs.collect()}
    ids = {i for i, _, _ in clean}
    assert all(len(ids - found) <= 1 for found in kept.values())  # one of them and 2001 are equal texts
    assert not kept["language_id"] & {1000, 1001, 1007} and 2000 in kept["near_duplicates"] and 2000 not in kept["benchmark_leaks"]
    assert not {4, 2001} <= kept["near_duplicates"]
    assert "[EMAIL]" in next(r.text for r in docs.collect() if r.doc_id == 2002)
    rows = corpus_pipeline.run(spark, where).collect()
    assert {r.doc_id for r in rows} == kept["personal_data"]


@pytest.mark.parametrize("what", ["documents", "benchmark", "both"])
def test_empty_tables(spark, folder, what):
    clean = list(sentences())
    where = folder([] if what != "benchmark" else clean, [] if what != "documents" else [(1, ITEM, "x")])
    rows = corpus_pipeline.run(spark, where).collect()
    assert len({r.doc_id for r in rows}) == (len(clean) if what == "benchmark" else 0)
