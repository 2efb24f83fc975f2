"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads a text in segments of 96 bytes, forwards and backwards, labels every byte with probabilities
over the languages, and a text's probabilities are the mean over its letter bytes. It is trained in numpy by
backpropagation through time on a bounded sample: at most ``PER_LANGUAGE`` documents of each language, chosen by
hash among those with a label whose doc_id is not held out, with up to ``SLICE`` characters each. Gates are
clipped linear functions, so a step is additions, products and clips. A letter is what Unicode calls one (L*); the
bytes of letters count, all others are only context.

``keep_identified`` trains one more class on noise: the sample's own texts with their letters drawn evenly, shuffled, or
taken from another script. A document is rejected when the probability of noise, pooled over its letter bytes, is
above a bound that falls from 1 to ``NOISE`` with the number of letter bytes, so a short text needs to be odder.

Defined results: a null text or one without letters is ``und`` with score 0; so is every text where no labelled
document can be learned from (``keep_identified`` then keeps all texts with a letter). A null ``doc_id`` is not held
out, and nothing is learned from it. Repeated rows give equal results; an empty table gives an empty result; other
columns, whatever their names, are ignored by ``identify`` and kept by ``keep_identified``. Every byte of a text counts,
however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOLDS = 5
#: The bound of the training sample: the languages with most documents, documents of each, characters of a document.
LANGUAGES, PER_LANGUAGE, SLICE = 64, 300, 384
#: Steps in which the share of a language's documents that enters the sample is counted.
SHARES = 1 << 40
SEGMENT, HIDDEN = 96, 8
STEPS, BATCH, RATE = 260, 128, 0.02
#: Segments that run side by side.
LANES = 2048
#: ``keep_identified``: units, noise texts, and the least probability of noise that rejects; for n letter bytes it is
#: higher by NOISE_SLACK / sqrt(n).
NOISE_HIDDEN, NOISE_TEXTS = 12, 600
NOISE, NOISE_SLACK = 0.5, 4.5
#: ASCII letters, and the bytes of other characters, which ``lettered`` takes out where they are no letters.
LETTER_BYTES = np.array([c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 for c in range(256)])


def new_weights(rng: np.random.Generator, labels: int, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    """For each direction d (0 forwards, 1 backwards) and gate g (r reset, z update, n new): a table of bytes
    ``Tgd``, a recurrent matrix ``Ugd``; and the labels' matrices ``V0, V1`` and bias ``c``."""
    w = {}
    for d in "01":
        for g in "rzn":
            w[f"T{g}{d}"] = rng.normal(0, 0.3, (256, hidden))
            w[f"U{g}{d}"] = rng.normal(0, 0.5 / np.sqrt(hidden), (hidden, hidden))
        w[f"V{d}"] = rng.normal(0, 0.3, (hidden, labels))
    w["c"] = np.zeros(labels)
    return {k: v.astype(np.float32) for k, v in w.items()}


def _gate(x: np.ndarray) -> np.ndarray:
    """A linear step from 0 to 1 over -2 to 2, in place."""
    x *= 0.25
    x += 0.5
    return np.clip(x, 0, 1, out=x)


def states(w: dict[str, np.ndarray], d: str, codes: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Hidden states (time, lane, unit) of direction ``d`` over ``codes`` (time, lane), in order of time."""
    steps, lanes = codes.shape
    hidden = w["c"].dtype.type(0) + np.zeros((lanes, w[f"Ur{d}"].shape[0]), w["c"].dtype)
    out = np.empty((steps, *hidden.shape), hidden.dtype)
    for t in range(steps) if d == "0" else range(steps - 1, -1, -1):
        x = codes[t]
        r = w[f"Tr{d}"].take(x, axis=0)
        r += hidden @ w[f"Ur{d}"]
        _gate(r)
        z = w[f"Tz{d}"].take(x, axis=0)
        z += hidden @ w[f"Uz{d}"]
        _gate(z)
        m = hidden @ w[f"Un{d}"]
        n = r * m
        n += w[f"Tn{d}"].take(x, axis=0)
        np.clip(n, -1, 1, out=n)
        if keep is not None:
            keep[t] = hidden, r, z, m, n
        new = hidden - n
        new *= z
        new += n
        hidden = out[t] = new
    return out


def probabilities(w: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Label probabilities (time, lane, label)."""
    s = states(w, "0", codes) @ w["V0"]
    s += states(w, "1", codes) @ w["V1"]
    s += w["c"]
    s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=2, keepdims=True)
    return s


def gradients(w: dict[str, np.ndarray], codes: np.ndarray, label: np.ndarray, counts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions that count, and its gradients by backpropagation through time."""
    keep: dict[str, dict] = {"0": {}, "1": {}}
    h = {d: states(w, d, codes, keep[d]) for d in "01"}
    s = h["0"] @ w["V0"] + h["1"] @ w["V1"] + w["c"]
    s -= s.max(axis=2, keepdims=True)
    p = np.exp(s)
    p /= p.sum(axis=2, keepdims=True)
    weight = counts.astype(p.dtype)
    total = max(float(weight.sum()), 1.0)
    lanes = np.arange(codes.shape[1])
    loss = -float((np.log(p[:, lanes, label] + 1e-9) * weight).sum()) / total
    p[:, lanes, label] -= 1
    p *= (weight / total)[:, :, None]
    g = {k: np.zeros_like(v) for k, v in w.items()}
    g["c"] = p.sum(axis=(0, 1))
    for d in "01":
        g[f"V{d}"] = np.einsum("tlh,tlk->hk", h[d], p)
        outer = p @ w[f"V{d}"].T
        back = np.zeros_like(outer[0])
        for t in range(len(codes) - 1, -1, -1) if d == "0" else range(len(codes)):
            before, r, z, m, n = keep[d][t]
            dh = back + outer[t]
            dz = dh * (before - n) * ((z > 0) & (z < 1)) * 0.25
            dn = dh * (1 - z) * (np.abs(n) < 1)
            dr = dn * m * ((r > 0) & (r < 1)) * 0.25
            dm = dn * r
            back = dh * z + dr @ w[f"Ur{d}"].T + dz @ w[f"Uz{d}"].T + dm @ w[f"Un{d}"].T
            for gate, delta, through in (("r", dr, dr), ("z", dz, dz), ("n", dn, dm)):
                np.add.at(g[f"T{gate}{d}"], codes[t], delta)
                g[f"U{gate}{d}"] += before.T @ through
    return loss, g


def segments(data: bytes) -> np.ndarray:
    """Bytes as columns of SEGMENT codes, padded by zeros."""
    n = -(-len(data) // SEGMENT)
    return np.frombuffer(data.ljust(n * SEGMENT, b"\0"), np.uint8).reshape(n, SEGMENT).T


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def lettered(text: str) -> bytes:
    """As many bytes as the text has in UTF-8, with blanks for the characters beyond ASCII that are no letters."""
    data = text.encode()
    if len(data) == len(text):
        return data
    other = {ord(c): " " * len(c.encode()) for c in set(text) if c > "\x7f" and not c.isalpha()}
    return text.translate(other).encode() if other else data


def fit(sample: list[tuple[str, str]], noise: list[str] = (), hidden: int = HIDDEN, seed: int = 3) -> tuple[list[str], dict[str, np.ndarray]]:
    """Labels and weights from ``(text, label)`` pairs; Adam with a falling rate, classes in equal shares. With ``noise``
    the network has a last class without label."""
    labels = sorted({label for _, label in sample})
    rng = np.random.default_rng(seed)
    texts = [[text for text, label in sample if label == name and text] for name in labels] + ([list(noise)] if noise else [])
    weights = new_weights(rng, max(len(texts), 1), hidden)
    pools = [[(s, m) for t in pool for s, m in zip(segments(t.encode()).T, LETTER_BYTES[segments(lettered(t))].T, strict=True)] for pool in texts]
    used = [k for k, p in enumerate(pools) if p]
    if len(used) < 2:
        return labels, weights
    first, second = ({k: np.zeros_like(v) for k, v in weights.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        label = np.array(used)[rng.integers(0, len(used), BATCH)]
        drawn = [pools[k][rng.integers(len(pools[k]))] for k in label]
        codes, counts = (np.stack(x, axis=1) for x in zip(*drawn, strict=True))
        _, g = gradients(weights, codes, label, counts)
        rate = RATE * (1 - 0.9 * step / STEPS)
        for k in weights:
            first[k] = 0.9 * first[k] + 0.1 * g[k]
            second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
            weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return labels, weights


def noise_like(sample: list[tuple[str, str]], seed: int = 5) -> list[str]:
    """Texts of the sample whose letters are drawn evenly, shuffled, or taken from a stretch of another script."""
    rng, texts, out = np.random.default_rng(seed), [t for t, _ in sample], []
    if not texts:
        return out
    letters = sorted({c for t in texts for c in t if c.isalpha()})
    ascii_letters = [c for c in letters if c.isascii()] or letters
    for k in range(NOISE_TEXTS):
        text = texts[rng.integers(len(texts))]
        if k % 3 == 0:
            pool = letters if k % 2 else ascii_letters
        elif k % 3 == 1:
            pool = [c for c in text if c.isalpha()]
        else:
            pool = []
            while not pool:
                at = int(rng.integers(0x370, 0xD700))
                pool = [c for c in map(chr, range(at, at + int(rng.choice([48, 2000])))) if c.isalpha()]
        of_text = iter(rng.permutation(pool).tolist())
        out.append("".join((next(of_text) if k % 3 == 1 else pool[rng.integers(len(pool))]) if c.isalpha() else c for c in text))
    return out


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def drawn(docs: DataFrame) -> list[tuple[str, str]]:
    """The bounded sample ``(text, label)`` of ``docs`` (``doc_id``, ``text``, ``lang``).

    The languages are counted first, so that each task passes on only about the share of a language's documents
    that the sample needs, the lowest by hash; the exact lowest PER_LANGUAGE are then ranked.
    """
    order = F.xxhash64("doc_id", "text")
    at = F.pmod(order, F.greatest(F.length("text") - SLICE, F.lit(0)) + 1).cast("int") + 1
    learnable = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = learnable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # A row for each language, for which the network has an output: no larger than the model.
    share = counts.select("lang", (F.lit(4.0 * PER_LANGUAGE * SHARES) / F.col("n")).alias("share"))
    usable = learnable.join(F.broadcast(share), "lang").where(F.pmod(order, F.lit(SHARES)) < F.col("share"))
    rows = usable.select("lang", order.alias("order"), F.substring(F.col("text"), at, F.lit(SLICE)).alias("slice"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "slice"))).where(F.col("rank") <= PER_LANGUAGE)
    sample = [(r.slice, r.lang) for r in ranked.select("lang", "order", "slice").collect()]
    return sorted(sample, key=lambda x: (x[1], x[0]))


def train(docs: DataFrame) -> tuple[list[str], dict[str, np.ndarray]]:
    """Fit on the bounded sample of ``docs``."""
    return fit(drawn(docs))


def pooled(weights: dict[str, np.ndarray], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the class probabilities over each text's letter bytes, and their number. All segments of the texts run
    side by side, LANES at a time."""
    sums, counts = np.zeros((len(texts), len(weights["c"]))), np.zeros(len(texts))

    def run(parts: list[np.ndarray], weight: list[np.ndarray], owner: list[np.ndarray]) -> None:
        codes, w, who = np.concatenate(parts, axis=1), np.concatenate(weight, axis=1).astype(np.float32), np.concatenate(owner)
        np.add.at(sums, who, np.einsum("tlk,tl->lk", probabilities(weights, np.ascontiguousarray(codes)), w))
        np.add.at(counts, who, w.sum(axis=0))

    parts, weight, owner, held = [], [], [], 0
    for i, text in enumerate(texts):
        codes, letters = segments(text.encode()), LETTER_BYTES[segments(lettered(text))]
        for lo in range(0, codes.shape[1], LANES):
            piece = codes[:, lo : lo + LANES]
            parts.append(piece)
            weight.append(letters[:, lo : lo + LANES])
            owner.append(np.full(piece.shape[1], i))
            held += piece.shape[1]
            if held >= LANES:
                run(parts, weight, owner)
                parts, weight, owner, held = [], [], [], 0
    if parts:
        run(parts, weight, owner)
    return sums, counts


def label_documents(model: tuple[list[str], dict[str, np.ndarray]], texts: list[str]) -> list[tuple[str, float]]:
    """Language and probability of each text."""
    labels, weights = model
    out = []
    for text, s, n in zip(texts, *pooled(weights, texts), strict=True):
        if not labels or not n or not has_letter(text):
            out.append(("und", 0.0))
        else:
            best = int(np.argmax(s[: len(labels)]))
            out.append((labels[best], round(min(float(s[best] / n), 1.0), 4)))
    return out


def is_identified(model: tuple[list[str], dict[str, np.ndarray]], texts: list[str]) -> list[bool]:
    """Whether each text has a letter and is not noise to a network with a last class for that."""
    labels, weights = model
    out = []
    for text, s, n in zip(texts, *pooled(weights, texts), strict=True):
        letters = n > 0 and has_letter(text)
        out.append(letters and (not labels or s[-1] / n <= NOISE + NOISE_SLACK / np.sqrt(n)))
    return out


def _strings(texts: pa.Array) -> list[str]:
    return [t or "" for t in texts.cast(pa.string()).to_pylist()]


def identify(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]] | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = model or train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = label_documents(model, _strings(part.column(2)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return rows.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows whose language is found, with all their columns: those with a letter that are not noise."""
    sample = drawn(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    model = fit(sample, noise_like(sample), NOISE_HIDDEN)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                yield part.filter(pa.array(is_identified(model, _strings(part.column(at))), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
