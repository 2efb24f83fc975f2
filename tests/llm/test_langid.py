import zlib

import numpy as np
import pytest

from aerolith.llm import langid, queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def predicted(spark):
    return {r.doc_id: r for r in queries.op5_language_id(spark, SF.replace("0.001", "0.01")).collect()}


@pytest.fixture(scope="module")
def truth(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").collect()}


def test_held_out_accuracy(predicted, truth):
    assert predicted.keys() == truth.keys()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in predicted.items())
    held = [i for i, r in predicted.items() if r.held_out]
    assert np.mean([predicted[i].lang_pred == truth[i].lang for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in predicted.values())


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in langid.new_weights(rng, 3, 4).items()}
    codes, label = rng.integers(97, 110, (12, 5)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    counts = rng.random(codes.shape) < 0.8
    _, g = langid.gradients(w, codes, label, counts)
    for name in w:
        for _ in range(4):
            at = tuple(rng.integers(n) for n in w[name].shape)
            if name[0] == "T":
                at = (codes[rng.integers(12), rng.integers(5)], at[1])
            old, ends = w[name][at], []
            for step in (1e-6, -1e-6):
                w[name][at] = old + step
                ends.append(langid.gradients(w, codes, label, counts)[0])
            w[name][at] = old
            assert abs((ends[0] - ends[1]) / 2e-6 - g[name][at]) < 1e-5, (name, at)


def plain_states(w, d, data):
    h, out = np.zeros(w[f"Ur{d}"].shape[0]), {}
    for t in range(len(data)) if d == "0" else range(len(data) - 1, -1, -1):
        gate = lambda g: np.clip((w[f"T{g}{d}"][data[t]] + h @ w[f"U{g}{d}"]) / 4 + 0.5, 0, 1)  # noqa: B023, E731
        r, z = gate("r"), gate("z")
        n = np.clip(w[f"Tn{d}"][data[t]] + r * (h @ w[f"Un{d}"]), -1, 1)
        h = out[t] = (1 - z) * n + z * h
    return np.array([out[t] for t in range(len(data))])


def test_probabilities_equal_a_plain_network():
    rng = np.random.default_rng(1)
    w = langid.new_weights(rng, 3)
    data = rng.integers(0, 256, 20).astype(np.uint8)
    s = plain_states(w, "0", data) @ w["V0"] + plain_states(w, "1", data) @ w["V1"] + w["c"]
    p = np.exp(s) / np.exp(s).sum(axis=1, keepdims=True)
    assert np.allclose(langid.probabilities(w, data[:, None])[:, 0], p, atol=1e-5)


def test_batching_does_not_matter():
    model = (["a", "b"], langid.new_weights(np.random.default_rng(2), 2))
    texts = ["some text", "", "1 2 3", "word " * 30_000, "other"]
    together = langid.label_documents(model, texts)
    assert together == [langid.label_documents(model, [t])[0] for t in texts]
    assert together[1] == together[2] == ("und", 0.0)


def test_odd_rows(make_docs, odd_rows):
    rows = langid.identify(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    assert {r.doc_id: r.lang_pred for r in rows if r.doc_id in (0, 1, 7)} == {0: "und", 1: "und", 7: "und"}
    assert all(not r.held_out for r in rows if r.doc_id is None)
    kept = langid.keep_identified(make_docs(odd_rows))
    assert kept.columns == make_docs([]).columns and not {r.doc_id for r in kept.collect()} & {0, 1, 7}


def test_nothing_to_learn_from(make_docs, spark):
    assert langid.identify(make_docs([])).count() == 0
    unlabelled = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in langid.identify(unlabelled).collect()] == [("und", 0.0)]


def test_gibberish_and_foreign_scripts_go(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    rng = np.random.default_rng(4)
    letters, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
    words = lambda signs, n: " ".join("".join(rng.choice(list(signs), rng.integers(3, 9))) for _ in range(n))
    odd = [words(s, n) for s in (letters, cyrillic) for n in (30, 40, 400)] + ["".join(chr(c) for c in rng.integers(0x4E00, 0x9FA0, n)) for n in (40, 400)]
    short = ["This work is licensed under the GNU General Public License, version 3.", "Hello there", "A short line.", "Guten Tag", "Buenos días", "Merci beaucoup", "Thank you very much"]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema)
    planted = spark.createDataFrame([(10**9 + i, t, None, "planted", len(t)) for i, t in enumerate(odd + short)], columns)
    kept = {r.doc_id for r in langid.keep_identified(docs.union(planted)).collect()}
    assert kept & {10**9 + i for i in range(len(odd) + len(short))} == {10**9 + len(odd) + i for i in range(len(short))}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert kept >= {i for i, t in texts.items() if langid.has_letter(t or "")}


def test_letters_are_letters():
    """Fractions, raised digits and Roman numeral signs are numbers; marks and symbols are no letters either."""
    model = (["a", "b"], langid.new_weights(np.random.default_rng(2), 2))
    texts = ["½ ² Ⅷ", "①②", "€ 12 %", "\u0301", "ß", "漢", "ª", "½a"]
    assert [x[0] != "und" for x in langid.label_documents(model, texts)] == [False] * 4 + [True] * 4
    for t in (*texts, "né ½ €uro 漢"):
        assert len(langid.lettered(t)) == len(t.encode())
        sums, counts = langid.pooled(model[1], [t])
        assert counts[0] == sum(len(c.encode()) for c in t if c.isalpha())


def test_the_sample_counts_texts_with_letters_only(spark):
    rows = [(i, f"some words here {i}" if i % 50 == 0 else None, "xx") for i in range(5000)] + [(9000 + i, "autre texte", "yy") for i in range(10)]
    sample = langid.drawn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    usable = [i for i in range(0, 5000, 50) if zlib.crc32(str(i).encode()) % 5]
    assert sum(l == "xx" for _, l in sample) == len(usable)


def test_the_number_of_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = [(1000 * k + i, f"text {k} {i}", f"l{k}") for k in range(5) for i in range(30 + 60 * k)]
    assert {l for _, l in langid.drawn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))} == {"l3", "l4"}
