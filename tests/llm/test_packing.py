import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from aerolith.llm import packing, queries
from tests.conftest import SF


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.tokenizer_path())


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abtheSRDLLVMÉßİıŒ'’.,-_!?0123 \n\t\x85\xa0\x1c<|>"), st.characters()), max_size=60))
def test_ids_equal_the_tokenizer(tokenizer, encoder, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    assert ids(encoder, text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_what_a_worker_remembers_is_bounded(tokenizer, monkeypatch):
    encoder = packing.Encoder(packing.tokenizer_path())
    monkeypatch.setattr(packing, "MEMORY_BYTES", 50_000)
    rng = np.random.default_rng(1)
    for k in range(30):
        text = " ".join(["x" * 3000 + str(k)] + ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 90)))) for _ in range(40)])
        assert ids(encoder, text) == tokenizer.encode(text, add_special_tokens=False).ids
        assert max(map(len, encoder.known), default=0) <= packing.LONGEST
        assert sum(len(c) + len(v) + packing.ENTRY_BYTES for c, v in encoder.known.items()) == encoder.held < 50_000 + 40 * 600


def test_special_strings(tokenizer, encoder):
    for text in ("a <|endoftext|> b", "it's we'll I'M don't 'twas l'été", "ΣΑΣ Straße ﬁ é é", "", " \n"):
        assert ids(encoder, text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_every_token_is_reached_from_its_own_bytes(encoder):
    """By the list of merges, as the tokenizer applies it: then merging by rank is the same."""
    with open(packing.tokenizer_path(), encoding="utf-8") as f:
        model = json.load(f)["model"]
    merges = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
    for token in model["vocab"]:
        if token in ("<|startoftext|>", "<|endoftext|>"):
            continue
        end = token.endswith("</w>") and len(token) > 4
        parts = list(token.removesuffix("</w>") if end else token)
        if end:
            parts[-1] += "</w>"
        while len(parts) > 1:
            rank, at = min((merges.get(p, 1 << 30), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            assert rank < 1 << 30, token
            parts[at : at + 2] = ["".join(parts[at : at + 2])]


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=30))
def test_plan_places_each_piece_once(histogram):
    patterns = packing.shortest_pack_first(histogram, 64)
    placed = Counter()
    for lengths, count in patterns:
        assert sum(lengths) <= 64 and count > 0
        for v in lengths:
            placed[v] += count
    assert placed == Counter(histogram)
    spots = set()
    for length, rows in packing.places(patterns).items():
        for rank in range(histogram[length]):
            first, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, side="right") - 1]
            spots.add((sequence + rank - first, offset))
    assert len(spots) == sum(histogram.values())


def check(rows, texts, tokenizer):
    want = Counter()
    for doc_id, text in texts:
        full = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[doc_id, len(full), zlib.crc32(np.array(full, "<u4").tobytes())] += 1
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 2048
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for doc_id, n, _ in want:
        pieces = by_doc[doc_id, n]
        assert sum(p[1] for p in pieces) == n * sum(c for (d, m, _), c in want.items() if (d, m) == (doc_id, n))
        if n <= 2048:
            assert {p[2] for p in pieces} == {c for d, m, c in want if (d, m) == (doc_id, n)}
    total = sum(r.length for r in rows)
    return (sum(2048 - sum(n for _, n in p) for p in by_sequence.values()) / total) if rows else 0


def test_odd_rows(make_docs, odd_rows, tokenizer):
    check(packing.pack(make_docs(odd_rows)).collect(), odd_rows, tokenizer)


def test_pieces_hold_the_ids(make_docs, odd_rows, tokenizer):
    long_id, long_text = next((i, t) for i, t in odd_rows if t and len(t) > 10_000)
    full = np.array([*tokenizer.encode(long_text, add_special_tokens=False).ids, 1], "<u4")
    for r in packing.pack(make_docs([(long_id, long_text)])).collect():
        assert r.ids_crc32 == zlib.crc32(full[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(full)


def test_query_on_documents(spark, tokenizer):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check(queries.op3_packing(spark, SF).collect(), texts, tokenizer) < 0.03


def test_empty(make_docs):
    assert packing.pack(make_docs([])).count() == 0
