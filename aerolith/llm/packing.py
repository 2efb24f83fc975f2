"""Packing: shortest-pack-first over the length histogram.

Documents are tokenized whole, ended by id 1, and cut every 2048 ids; all pieces but a document's last are full
sequences. The histogram of piece lengths (at most 2048 numbers) goes to the driver, where the lengths, longest
first, are placed into the packs with the most room that still take them. Packs of one content are one pattern
with a count, so the plan stays small whatever the number of pieces. Pieces join their pattern by rank: the
n-th piece of a length takes the n-th place that the patterns hold for it.

Tokenization keeps a table of white-space-delimited chunks already seen, since the tokenizer drops white space
and never joins across it. Texts outside the range for which that equality is plain (beyond Latin Extended-B,
control separators, strings of special tokens) go to the tokenizer whole.

Defined results: a null text counts as empty and gives one piece, the id 1; null or repeated ``doc_id`` values
are carried and repeated rows are packed each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aerolith.llm.common import gapless, numbered, packed

SEQUENCE = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of remembered chunks and their ids in a worker, with what Python holds for each; longer chunks are tokenized
#: anew each time.
MEMORY_BYTES, ENTRY_BYTES, LONGEST = 48 << 20, 200, 64
#: Texts beyond this character, or with any of these strings, are given to the tokenizer whole.
LAST_PLAIN = 0x24F
UNUSUAL = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


def plain(text: str) -> bool:
    if any(u in text for u in UNUSUAL):
        return False
    return text.isascii() or int(np.frombuffer(text.encode("utf-16-le", "surrogatepass"), np.uint16).max()) <= LAST_PLAIN


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Token ids as little-endian unsigned 32-bit numbers, equal to the tokenizer's own.

    Ids of chunks are remembered. New chunks are split into words as the tokenizer's pattern does, and the words
    of many chunks go through its merges in one call: each word ends in a line feed, which stands for the
    vocabulary's end-of-word mark and merges with the last byte before anything else. Merging by token rank
    equals merging by the list of merges because every token is reached from its own bytes (a test checks it).
    """

    END_OF_WORD = "</w>"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.ranks, ids = self.token_ranks(model["merges"], model["vocab"])
        self.merger = tiktoken.Encoding("merges", pat_str=r"[^\n]+\n", mergeable_ranks=self.ranks, special_tokens={})
        self.ids = np.zeros(max(ids) + 1, "<u4")
        self.last = np.zeros(max(ids) + 1, bool)
        for token, rank in self.ranks.items():
            self.ids[rank], self.last[rank] = ids[rank], token.endswith(b"\n")
        self.known: dict[str, bytes] = {}
        self.held = 0

    @classmethod
    def token_ranks(cls, merges: list, vocab: dict[str, int]) -> tuple[dict[bytes, int], dict[int, int]]:
        """Rank of each token's bytes (single bytes, then bytes with the end mark, then merges in order), and the
        vocabulary's id of each rank."""
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        byte = {c: b for b, c in char.items()}
        ranks, ids = {}, {}
        for b, c in char.items():
            for mark, rank in (("", b), (cls.END_OF_WORD, 256 + b)):
                ranks[bytes([b]) + b"\n" * bool(mark)] = rank
                ids[rank] = vocab[c + mark]
        for rank, pair in enumerate(merges, 512):
            token = "".join(pair.split(" ") if isinstance(pair, str) else pair)
            word = token.removesuffix(cls.END_OF_WORD)
            data = bytes(byte[c] for c in word) + b"\n" * (word != token)
            if data not in ranks:
                ranks[data], ids[rank] = rank, vocab[token]
        return ranks, ids

    def whole(self, text: str) -> bytes:
        """The ids from the tokenizer itself."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks without white space."""
        words, ends, n = [], [], 0
        for c in chunks:
            low = c.lower()
            parts = [low] if low.isalpha() else self.words(low)
            words += parts
            n += len(parts)
            ends.append(n)
        ranks = np.array(self.merger.encode_ordinary("\n".join(words) + "\n" if words else ""), np.int64)
        closes = np.concatenate([[0], np.flatnonzero(self.last[ranks]) + 1])[np.concatenate([[0], ends])] * 4
        ids = self.ids[ranks].tobytes()
        return [ids[a:b] for a, b in zip(closes[:-1].tolist(), closes[1:].tolist(), strict=True)]

    def encode(self, text: str) -> bytes:
        """The ids of a text, without the end id."""
        if not plain(text):
            return self.whole(text)
        chunks = text.split()
        if self.held > MEMORY_BYTES:
            self.known.clear()
            self.held = 0
        once: dict[str, bytes] = {}
        if new := list(set(chunks).difference(self.known)):
            for c, ids in zip(new, self.learn(new), strict=True):
                if len(c) <= LONGEST:
                    self.known[c] = ids
                    self.held += len(c) + len(ids) + ENTRY_BYTES
                else:
                    once[c] = ids
        if not once:
            return b"".join(map(self.known.__getitem__, chunks))
        return b"".join([self.known[c] if len(c) <= LONGEST else once[c] for c in chunks])


_ENCODERS: dict[str, Encoder] = {}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _pieces(path: str, sequence: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder = _ENCODERS[path]
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), (encoder.encode(t or "") + end for t in part.column(1).to_pylist()), strict=True):
                    n = len(ids) // 4
                    rows += [(doc_id, at, min(sequence, n - at), zlib.crc32(ids[4 * at : 4 * (at + sequence)]), n) for at in range(0, n, sequence)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def tokenize(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Every piece of every text: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_pieces(path or tokenizer_path(), sequence), PIECES)


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """Patterns ``(lengths, count)`` that hold ``histogram[length]`` pieces of each length.

    Lengths go longest first. Each fills the packs with the most room: a pattern is taken off the heap of open
    patterns, the packs that get the piece become a new pattern, and the rest keep theirs. A piece opens a new
    pack only when the emptiest pack has no room for it.
    """
    open_packs: list[tuple[int, int, list[int], int]] = []  # (filled, order, lengths, count)
    order, full = 0, []
    for length in sorted((v for v in histogram if histogram[v]), reverse=True):
        left = histogram[length]
        while left:
            if open_packs and open_packs[0][0] + length <= sequence:
                filled, at, lengths, count = heapq.heappop(open_packs)
                used = min(count, left)
                if used < count:
                    heapq.heappush(open_packs, (filled, at, lengths, count - used))
            else:
                filled, lengths, used = 0, [], left
            order += 1
            pack = [*lengths, length]
            if filled + length == sequence:
                full.append((pack, used))
            else:
                heapq.heappush(open_packs, (filled + length, order, pack, used))
            left -= used
    return full + [(lengths, count) for _, _, lengths, count in open_packs]


def places(patterns: list[tuple[list[int], int]]) -> dict[int, np.ndarray]:
    """For each length, rows ``(first rank, first sequence, offset)``: the pieces from that rank on take that
    place of consecutive sequences."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    ranks: dict[int, int] = defaultdict(int)
    sequence = 0
    for lengths, count in patterns:
        offset = 0
        for length in lengths:
            out[length].append((ranks[length], sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return {length: np.array(rows, np.int64) for length, rows in out.items()}


def _placed(plan: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for v in np.unique(length):
                rows, mine = plan[int(v)], length == v
                at = np.searchsorted(rows[:, 0], rank[mine], side="right") - 1
                sequence[mine] = rows[at, 1] + rank[mine] - rows[at, 0]
                offset[mine] = rows[at, 2]
            kept = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """A row per piece with its sequence and its offset there."""
    pieces = numbered(tokenize(docs, path, sequence), "pieces")
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = places(shortest_pack_first(histogram, sequence))
    return packed(gapless(pieces, "length", "rank").mapInArrow(_placed(plan), f"{PIECES}, sequence_id long, offset long"))
