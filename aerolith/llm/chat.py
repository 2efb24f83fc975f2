"""Chat formatting: transcripts are parsed by a hidden Markov model, then rendered turn by turn.

A transcript is the lines of a conversation's rows in order of turn. The hidden state of a line is its speaker
(system, user, assistant) and whether it begins a turn or continues one. It shows a speaker marker (the row's
role label on its first line, or a label such as ``User:`` that a line starts with), whether it starts a row,
and its length class and question mark. Viterbi decoding recovers the states, also where labels are missing,
unknown or wrong; each recovered turn is rendered as ``<|role|>``, a line feed, and its text.

Transition and line probabilities are counted over all rows with a known role; turns that follow each other are counted
by conversation, turn and role before they are paired. The rows are sorted by range, so that a conversation of any size
spreads over partitions, and cut into chunks of CHUNK rows. A chunk becomes the max-plus matrix of its best paths; the
matrices of a partition's part of a conversation are multiplied, the parts of a conversation are chained to fix the
state at their borders, then the chunks of a part between its borders, and each chunk is decoded between its own. A task
therefore holds the lines of one chunk, or six by seven numbers for each chunk of one partition, or for each partition.

Defined results: rows equal in conversation, turn, role and text are one; rows of one turn go by role and a hash of the
text; null turns come last; null conversation ids are one conversation; a null text is one empty line; a null or unknown
role is no marker; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import written

ROLES = ("system", "user", "assistant")
#: Speaker labels, as transcripts write them.
LABELS = {"system": 0, "instructions": 0, "user": 1, "human": 1, "customer": 1, "prompter": 1, "q": 1, "assistant": 2, "bot": 2, "ai": 2, "agent": 2, "model": 2, "a": 2}
MARKED_LINE = re.compile(r"\s*(?:#+\s*|\*\*)?([A-Za-z]{1,12})(?:\*\*)?\s*[:>]\s*", re.A)
#: Line lengths from which a new length class starts.
LENGTHS = (1, 20, 60, 150, 400)
FEATURES = 2 * (len(LENGTHS) + 1)
#: Share of beginning lines without a marker, of markers that name another speaker, of continuing lines with one,
#: and of turns that begin inside a row.
UNMARKED, WRONG, STRAY, INSIDE = 0.05, 0.01, 0.02, 0.02
CHUNK = 128
STATES = 2 * len(ROLES)
START = STATES
FAR = 1 << 62
#: A chunk's number holds the number of its partition above so many bits.
PART_BITS = 33


def feature_column(line: Column) -> Column:
    """Length class and question mark of a line as one number."""
    n = F.length(line)
    size = sum((F.when(n >= v, 1).otherwise(0) for v in LENGTHS), F.lit(0))
    return (size * 2 + F.when(line.rlike(r"\?\s*$"), 1).otherwise(0)).cast("int")


def feature(line: str) -> int:
    return 2 * sum(len(line) >= v for v in LENGTHS) + bool(re.search(r"\?\s*$", line))


def known_role(role: Column) -> Column:
    """The number of the speaker that a label names, or null."""
    label = F.lower(F.trim(role))
    out = F.lit(None).cast("int")
    for name, number in LABELS.items():
        out = F.when(label == name, number).otherwise(out)
    return out


class Model:
    """Log probabilities. State 2r begins a turn of role r, state 2r + 1 continues it."""

    def __init__(self, follows: np.ndarray, lines: np.ndarray) -> None:
        """``follows[r, s]``: rows of role s after rows of role r; r = 3 at the start of a conversation.
        ``lines[r, i, f]``: first (i = 0) and further lines of role r with feature f."""
        roles = len(ROLES)
        follows, lines = follows + 1.0, lines + 1.0
        after = follows / follows.sum(axis=1, keepdims=True)
        goes_on = lines[:, 1].sum(axis=1) / lines.sum(axis=(1, 2))
        p = np.zeros((STATES + 1, STATES))
        for r in range(roles):
            for s in (2 * r, 2 * r + 1):
                p[s, 2 * r + 1] = goes_on[r]
                p[s, 0::2] = (1 - goes_on[r]) * after[r]
        p[START, 0::2] = after[roles] * 0.99
        p[START, 1::2] = 0.01 / roles
        self.step = np.log(p + 1e-12)
        self.feature = np.log((lines / lines.sum(axis=2, keepdims=True)).reshape(STATES, FEATURES))
        marker = np.full((STATES, roles + 1), WRONG / (roles - 1))
        for r in range(roles):
            marker[2 * r, r] = 1 - WRONG - UNMARKED
            marker[2 * r, roles] = UNMARKED
            marker[2 * r + 1] = STRAY / roles
            marker[2 * r + 1, roles] = 1 - STRAY
        self.marker = np.log(marker)
        #: [does the line start a row, state]
        self.row_start = np.log(np.array([[INSIDE, 1 - INSIDE] * roles, [1 - INSIDE, INSIDE] * roles]))

        every = [self.emission(m, bool(starts), kind) for m in range(roles + 1) for starts in (0, 1) for kind in range(FEATURES)]
        #: [code of a line, state]
        self.by_code = np.array(every)

    def emission(self, marker: int, starts_row: bool, kind: int) -> np.ndarray:
        return self.marker[:, marker] + self.feature[:, kind] + self.row_start[int(starts_row)]

    def matrix(self, emissions: list[np.ndarray]) -> np.ndarray:
        """Best log probability from each state before (or START) to each state after the lines."""
        best = np.full((STATES + 1, STATES + 1), -np.inf)
        np.fill_diagonal(best, 0)
        best = (best[:, :, None] + self.step[None]).max(axis=1) + emissions[0]
        for e in emissions[1:]:
            best = (best[:, :, None] + self.step[None, :STATES]).max(axis=1) + e
        return best

    def path(self, emissions: list[np.ndarray], entry: int, exit_: int) -> list[int]:
        """The best states between the state before the lines and the state of the last one."""
        best = self.step[entry] + emissions[0]
        back = []
        for e in emissions[1:]:
            through = best[:, None] + self.step[:STATES]
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + e
        out = [exit_]
        for pointers in reversed(back):
            out.append(int(pointers[out[-1]]))
        return out[::-1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The matrix of ``a``'s lines followed by those of ``b``."""
    return (a[:, :, None] + b[None, :STATES]).max(axis=1)


def chain(matrices: list[np.ndarray], entry: int = START, exit_: int | None = None) -> list[tuple[int, int]]:
    """The states before and at the end of each part on the best path through all of them, from ``entry`` to ``exit_`` or
    the best end."""
    best = np.full(STATES + 1, -np.inf)
    best[entry] = 0
    back = []
    for m in matrices:
        through = best[:, None] + m
        back.append(through.argmax(axis=0))
        best = np.append(through.max(axis=0), -np.inf)
    out, at = [], int(best.argmax()) if exit_ is None else exit_
    for pointers in reversed(back):
        out.append((int(pointers[at]), at))
        at = int(pointers[at])
    return out[::-1]


def observed(role: str | None, text: str | None) -> list[tuple[int, bool, int, str]]:
    """``(marker, starts a row, feature, text without marker)`` of each line of a row."""
    out = []
    for k, line in enumerate((text or "").split("\n")):
        marker = LABELS.get((role or "").strip().lower(), len(ROLES)) if k == 0 else len(ROLES)
        m = MARKED_LINE.match(line)
        if m and m[1].lower() in LABELS and marker in (len(ROLES), LABELS[m[1].lower()]):
            marker, line = LABELS[m[1].lower()], line[m.end() :]
        out.append((marker, k == 0, feature(line), line))
    return out


def train(rows: DataFrame) -> Model:
    """Counts over all rows with a known role; at most 12 x 12 numbers reach the driver."""
    known = rows.withColumn("r", known_role(F.col("role"))).where("r is not null")
    lines = known.select("r", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    counts = np.zeros((len(ROLES), 2, FEATURES))
    for r, later, kind, n in lines.groupBy("r", (F.col("at") > 0).cast("int").alias("later"), feature_column(F.col("line")).alias("kind")).count().collect():
        counts[r, later, kind] = n
    follows = np.zeros((len(ROLES) + 1, len(ROLES)))
    # A row after one of unknown role says nothing about what follows what; only rows after none begin a conversation.
    unknown = F.lit(len(ROLES) + 1)
    held = rows.withColumn("r", F.coalesce(known_role(F.col("role")), unknown)).groupBy("conv_id", "turn", "r")
    held = written(held.agg(F.count("*").cast("double").alias("n")), "roles")
    before = held.select("conv_id", F.expr("try_add(turn, 1)").alias("turn"), F.col("r").alias("before"), F.col("n").alias("m"))
    pairs = held.where(F.col("r") != unknown).join(before, ["conv_id", "turn"], "left").where(F.coalesce("before", F.lit(0)) != unknown)
    for a, b, n in pairs.groupBy(F.coalesce("before", F.lit(len(ROLES))), "r").agg(F.sum(F.col("n") * F.coalesce("m", F.lit(1.0)))).collect():
        follows[a, b] = n
    return Model(follows, counts)


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in their first ``keys`` columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _chunks(chunk: int):
    """Rows in order, without those equal to the one before, each with its partition, its chunk and its place there."""
    schema = pa.schema([("conv_id", pa.int64()), ("pid", pa.int32()), ("chunk", pa.int64()), ("at", pa.int32()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            last, number, at = None, -1, 0
            for batch in batches:
                for pid, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if last == row:
                        continue
                    if last is None or last[0] != row[0] or at == chunk:
                        number, at = number + 1, 0
                    yield row[0], pid, (pid << PART_BITS) + number, at, *row[1:]
                    last, at = row, at + 1

        return _batched(rows(), schema, 512)

    return run


def parse_transcripts(conversations: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, turn, part, role, opens, n_lines, rendered``: the parts of each row, in which a recovered turn
    begins (``opens``) or goes on. ``rendered`` in order of turn and part is the whole transcript."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = ["conv_id", F.coalesce("turn", F.lit(FAR)), "role", F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select(F.spark_partition_id().alias("pid"), "*")
    rows = written(rows.mapInArrow(_chunks(chunk), "conv_id long, pid int, chunk long, at int, turn long, role string, text string"), "turns")
    model = train(rows)
    long, matrix = pa.int64(), pa.list_(pa.float64())
    shape = (STATES + 1, STATES)

    def coded(batches):
        def run():
            for batch in batches:
                for conv, pid, number, at, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield conv, pid, number, at, [(m * 2 + starts) * FEATURES + kind for m, starts, kind, _ in observed(role, text)]

        return _batched(run(), pa.schema([("conv_id", long), ("pid", pa.int32()), ("chunk", long), ("at", pa.int32()), ("codes", pa.list_(pa.int32()))]))

    def matrices(batches):
        found = ((g[0][1], g[0][2], g[0][0], model.matrix([model.by_code[c] for row in g for c in row[4]]).ravel().tolist()) for g in _runs(batches, 1))
        return _batched(found, pa.schema([("conv_id", long), ("pid", pa.int32()), ("chunk", long), ("matrix", matrix)]))

    def products(batches):
        def run():
            held, whole = None, None
            for batch in batches:
                for conv, pid, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    m = np.array(m).reshape(shape)
                    if held == (conv, pid):
                        whole = product(whole, m)
                        continue
                    if held is not None:
                        yield *held, whole.ravel().tolist()
                    held, whole = (conv, pid), m
            if held is not None:
                yield *held, whole.ravel().tolist()

        return _batched(run(), pa.schema([("conv_id", long), ("pid", pa.int32()), ("matrix", matrix)]))

    def part_borders(batches):
        def run():
            for g in _runs(batches, 1):
                yield from ((*row[:2], *ends) for row, ends in zip(g, chain([np.array(row[2]).reshape(shape) for row in g]), strict=True))

        return _batched(run(), pa.schema([("conv_id", long), ("pid", pa.int32()), ("entry", pa.int32()), ("exit", pa.int32())]))

    def chunk_borders(batches):
        def run():
            for g in _runs(batches, 4):
                ends = chain([np.array(row[5]).reshape(shape) for row in g], g[0][2], g[0][3])
                yield from ((row[4], *x) for row, x in zip(g, ends, strict=True))

        return _batched(run(), pa.schema([("chunk", long), ("entry", pa.int32()), ("exit", pa.int32())]))

    def decode(batches):
        def run():
            for g in _runs(batches, 1):
                entry, exit_ = g[0][2:4]  # the borders stand before the rows
                lines = [observed(row[6], row[7]) for row in g[1:]]
                path = iter(model.path([model.emission(*x[:3]) for row in lines for x in row], entry, exit_))
                for row, row_lines in zip(g[1:], lines, strict=True):
                    parts: list[tuple[int, list[str]]] = []
                    for line in row_lines:
                        state = next(path)
                        if not parts or state % 2 == 0:
                            parts.append((state, []))
                        parts[-1][1].append(line[3])
                    for k, (state, text) in enumerate(parts):
                        opens = state % 2 == 0
                        yield row[4], row[5], k, ROLES[state // 2], opens, len(text), (f"<|{ROLES[state // 2]}|>\n" if opens else "") + "\n".join(text) + "\n"

        return _batched(run(), pa.schema([("conv_id", long), ("turn", long), ("part", pa.int32()), ("role", pa.string()), ("opens", pa.bool_()), ("n_lines", pa.int32()), ("rendered", pa.string())]))

    codes = rows.select("conv_id", "pid", "chunk", "at", "role", "text").mapInArrow(coded, "conv_id long, pid int, chunk long, at int, codes array<int>")
    codes = codes.select("chunk", "conv_id", "pid", "at", "codes").repartition("chunk").sortWithinPartitions("chunk", "at")
    chunks = written(codes.mapInArrow(matrices, "conv_id long, pid int, chunk long, matrix array<double>"), "matrices")
    part = ["conv_id", "pid"]
    parts = chunks.repartition(*part).sortWithinPartitions(*part, "chunk").select(*part, "matrix").mapInArrow(products, "conv_id long, pid int, matrix array<double>")
    ends = parts.repartition("conv_id").sortWithinPartitions(*part).mapInArrow(part_borders, "conv_id long, pid int, entry int, exit int")
    same = F.col("c.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("c.pid") == F.col("e.pid"))
    both = chunks.alias("c").join(written(ends, "borders").alias("e"), same).select("c.conv_id", "c.pid", "entry", "exit", "chunk", "matrix")
    ends = both.repartition(*part).sortWithinPartitions(*part, "chunk").mapInArrow(chunk_borders, "chunk long, entry int, exit int")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    turns = rows.select("chunk", "at", *none("int", "entry", "exit"), "conv_id", "turn", "role", "text")
    ends = ends.select("chunk", F.lit(-1).alias("at"), "entry", "exit", *none("long", "conv_id", "turn"), *none("string", "role", "text"))
    met = turns.union(ends).repartition("chunk").sortWithinPartitions("chunk", "at")
    return met.mapInArrow(decode, "conv_id long, turn long, part int, role string, opens boolean, n_lines int, rendered string")
