import itertools
import random

import numpy as np
import pytest

from aerolith.llm import chat, queries
from tests.conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string, chunk string, rendered string"


def model(seed=0):
    rng = np.random.default_rng(seed)
    return chat.Model(rng.integers(0, 50, (4, 3)).astype(float), rng.integers(0, 50, (3, 2, chat.FEATURES)).astype(float))


def brute(m, emissions):
    def score(path):
        steps = zip([chat.START, *path], path, strict=False)
        return sum(m.step[a, b] for a, b in steps) + sum(e[s] for e, s in zip(emissions, path, strict=True))

    return max(itertools.product(range(chat.STATES), repeat=len(emissions)), key=score)


def test_chunks_give_the_best_path():
    rng = random.Random(1)
    for seed in range(6):
        m = model(seed)
        e = [m.emission(rng.choice([0, 1, 2, 3, 3]), rng.random() < 0.5, rng.randrange(chat.FEATURES)) for _ in range(5)]
        want = brute(m, e)
        for cut in ([5], [1, 4], [2, 2, 1], [1] * 5):
            at = np.cumsum([0, *cut])
            chunks = [e[a:b] for a, b in zip(at, at[1:], strict=False)]
            ends = chat.chain([m.matrix(c) for c in chunks])
            assert tuple(s for c, (a, b) in zip(chunks, ends, strict=True) for s in m.path(c, a, b)) == want


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def test_roles_of_documents(spark):
    truth = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()}
    got = queries.op6_chat_formatting(spark, SF).collect()
    assert {(r.conv_id, r.turn) for r in got} == set(truth)
    assert all(r.role == truth[r.conv_id, r.turn].role for r in got if r.part == 0)
    text = "".join(r.rendered for r in sorted(got, key=lambda r: (r.conv_id, r.turn, r.part)) if r.conv_id == 0)
    rows = sorted((k[1], v) for k, v in truth.items() if k[0] == 0)
    assert text == "".join(f"<|{v.role}|>\n{v.text}\n" for _, v in rows)


def test_missing_labels_are_recovered(spark):
    """One label in five is hidden: of those the share that comes back is 0.9, but for chance."""
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/conversations.parquet").collect()]
    rng = random.Random(0)
    hidden = [(c, t, None if rng.random() < 0.2 else r, x) for c, t, r, x in rows]
    truth = {(c, t): r for c, t, r, _ in rows}
    gone = {(c, t) for c, t, r, _ in hidden if r is None}
    got = [r for r in chat.parse_transcripts(conversations(spark, hidden)).collect() if r.part == 0 and (r.conv_id, r.turn) in gone]
    assert len(got) == len(gone) > 50
    assert np.mean([r.role == truth[r.conv_id, r.turn] for r in got]) > 0.89


def whole(spark, rows):
    """Every conversation decoded in one piece from the model of the same rows."""
    m = chat.train(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = []
    for conv in sorted({r[0] for r in rows}, key=str):
        turns = sorted({r[1:] for r in rows if r[0] == conv}, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        lines = [chat.observed(role, text) for _, role, text in turns]
        scores = [m.emission(*x[:3]) for row in lines for x in row]
        best = np.full(chat.STATES + 1, -np.inf)
        best[chat.START] = 0
        back = []
        for e in scores:
            through = best[:, None] + m.step
            back.append(through.argmax(axis=0))
            best = np.append(through.max(axis=0) + e, -np.inf)
        path, at = [], int(best.argmax())
        for pointers in reversed(back):
            path.append(at)
            at = int(pointers[at])
        states = iter(path[::-1])
        for (turn, _, _), row in zip(turns, lines, strict=True):
            parts = []
            for line in row:
                s = next(states)
                if not parts or s % 2 == 0:
                    parts.append((s, []))
                parts[-1][1].append(line[3])
            for k, (s, text) in enumerate(parts):
                head = f"<|{chat.ROLES[s // 2]}|>\n" if s % 2 == 0 else ""
                out.append((conv, turn, k, chat.ROLES[s // 2], s % 2 == 0, len(text), head + "\n".join(text) + "\n"))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1, 7, 128])
def test_transcripts_equal_whole_decoding(spark, chunk):
    """One conversation holds most rows and spreads over partitions."""
    rng = random.Random(4)
    texts = ["hello", "what is it?", "User: a line\nBot: an answer\nwith more", "a long reply " * 12, "x\ny\nz"]
    rows = [(5 if i % 3 else i % 4, i, rng.choice(["user", "assistant", "system", None, "narrator"]), f"{rng.choice(texts)} {i}") for i in range(400)]
    got = chat.parse_transcripts(conversations(spark, rows), chunk).collect()
    assert sorted(map(tuple, got), key=str) == whole(spark, rows)


def test_query_equals_whole_decoding(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    assert sorted(map(tuple, queries.op6_chat_formatting(spark, SF).collect()), key=str) == whole(spark, rows)


def test_many_rows_of_one_turn(spark):
    """Neither the pairing of turns nor a chunk grows with the rows of a turn."""
    rows = [(1, t, "user", f"row {i}") for t in (0, 1) for i in range(3000)] + [(1, None, "assistant", f"late {i}") for i in range(3000)]
    got = chat.parse_transcripts(conversations(spark, rows)).collect()
    assert len({(r.turn, r.rendered) for r in got}) == 9000
    pairs = [(1, 0, "user", "a"), (1, 0, "user", "b"), (1, 1, "assistant", "c"), (1, 1, "assistant", "d"), (1, 1, "assistant", "e")]
    table = spark.createDataFrame(pairs, "conv_id long, turn long, role string, text string")
    counted = chat.Model.__init__
    seen = []
    chat.Model.__init__ = lambda self, follows, lines: (seen.append(follows), counted(self, follows, lines))[1]
    try:
        chat.train(table)
    finally:
        chat.Model.__init__ = counted
    assert seen[0][1, 2] == 6 and seen[0][3, 1] == 2


def test_chunk_size_does_not_matter(spark):
    rng = random.Random(3)
    rows = [(i % 3, i // 3, rng.choice(["user", "assistant", None, "narrator"]), "a\nb?" if i % 2 else "User: hello there\nBot: hi") for i in range(60)]
    results = [sorted(map(str, chat.parse_transcripts(conversations(spark, rows), chunk).collect())) for chunk in (1, 4, 128)]
    assert results[0] == results[1] == results[2]


def test_odd_rows(spark):
    rows = [(1, 0, "User", "hi"), (1, 0, "User", "hi"), (1, None, None, None), (None, 0, "bot", ""), (None, None, None, "x"), (2, 5, "???", "word " * 40_000), (2, 6, "system", "a\n\nb")]
    got = chat.parse_transcripts(conversations(spark, rows)).collect()
    assert {(r.conv_id, r.turn) for r in got} == {(c, t) for c, t, _, _ in rows}
    assert sum(r.n_lines for r in got) == 8
    assert all(r.role in chat.ROLES for r in got)
    assert chat.parse_transcripts(conversations(spark, [])).count() == 0


def test_feature_column_equals_feature(spark):
    lines = ["", "a", "x" * 19, "y" * 20, "z" * 60 + "?", "q? ", "w" * 400]
    got = spark.createDataFrame([(v,) for v in lines], "line string").select("line", chat.feature_column(chat.F.col("line")).alias("f")).collect()
    assert all(r.f == chat.feature(r.line) for r in got)
