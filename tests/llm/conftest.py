import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, spans string, key int, kind string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows of (doc_id, text) with columns whose names clash with those of results."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", "z", 1, "k") for i, t in rows], SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(20000))
    return [(0, None), (1, ""), (2, "a"), (3, "Ünï 😀 text"), (3, "Ünï 😀 text"), (4, long_text), (5, long_text), (None, "no id here"), (None, None), (6, "a"), (7, " \t\n ")]
