"""Personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, URL schemes and identifier cues in one pass.
Around each anchor a deterministic local parser extends to the boundaries of a candidate and validates it, and
each kind keeps its own position so that its matches never overlap. The four base kinds come out as the
leftmost non-overlapping matches of their patterns; ``url`` (addresses that carry credentials or name a person)
and ``account`` (IBANs and cued account, passport and social-security numbers) are added.

Defined results: a null or empty text has no spans; null or repeated ``doc_id`` values are carried; repeated
rows give repeated results; an empty table gives an empty result; other columns are ignored by ``find_pii`` and
kept by ``mask_pii``. Work is linear in the text: no parser reads a stretch twice for the same kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AUTHORITY = re.compile(r"[^\s\"'<>]+")
PERSONAL_URL = re.compile(r"[^/?#]*@|.*[?&](?:e?mail|user(?:name)?|phone|tel|name)=[^&#]+|[^/?#]+/(?:~|users?/|profile/|in/)[A-Za-z0-9._-]+", re.I)
#: Identifier cues, as they stand in text in either case.
CUES = ("iban", "account", "acct", "passport", "ssn")
CUED = re.compile(r"(?:\s*+(?:no\.?|number|num|nr\.?|#))?+\s*+[:=#]?\s*+([A-Za-z]{0,3}[0-9][0-9A-Za-z]*+)", re.I)
#: The first characters of an IBAN in groups, and what it consists of.
IBAN_START = re.compile(r"[A-Za-z]{2}[0-9]{2}")
GROUPED = re.compile(r"[0-9A-Za-z]|[ -](?=[0-9A-Za-z])")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    return bool(IBAN.fullmatch(value)) and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _only_digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "").replace("(", "").replace(")", "").replace(".", "").replace("+", "")


def build_anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    a.add_word("://", ("url", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("account", len(cue)))
    a.make_automaton()
    return a


ANCHORS = build_anchors()


def _account(text: str, at: int) -> tuple[int, int] | None:
    """The identifier after a cue that ends at ``at``: the longest run of groups (parted by single blanks or hyphens)
    that makes an IBAN, else the first group, of 6 to 20 characters with five digits at least. No part of the pattern
    gives back what it has read, and an IBAN has at most 34 characters, so the work is linear."""
    m = CUED.match(text, at)
    if not m:
        return None
    start, end = m.span(1)
    if IBAN_START.match(text, start):
        value, place, best = "", start, None
        while len(value) <= 34 and (c := GROUPED.match(text, place)):
            value += c[0].strip(" -").upper()
            place = c.end()
            if (place == len(text) or not text[place].isalnum() or not text[place].isascii()) and iban(value):
                best = place
        if best:
            return start, best
    if end - start <= 20 and end - start >= 6 and sum(c in "0123456789" for c in text[start:end]) >= 5:
        return start, end
    return None


def octet(part: str) -> bool:
    """Whether a run of digits, with any number of zeros before, is at most 255."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` of every span, in order, in code points."""
    found = []
    done = dict.fromkeys(KINDS, 0)
    run_end = 0  # of the digit run last seen
    for last, (kind, length) in ANCHORS.iter(text):
        at = last - length + 1
        if kind == "digit":
            if at >= done["card"] and (m := CARD.match(text, at)):
                done["card"] = m.end()
                digits = _only_digits(m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((at, 2, m.end()))
            if at >= done["ip"] and at >= run_end:
                if m := IP.match(text, at):
                    done["ip"] = m.end()
                    if all(map(octet, m[0].split("."))):
                        found.append((at, 1, m.end()))
                else:
                    run_end = DIGITS.match(text, at).end()
        elif kind == "email":
            if m := DOMAIN.match(text, at + 1):
                start = at
                while start > done["email"] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at:
                    done["email"] = m.end()
                    found.append((start, 0, m.end()))
        elif kind == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= len(_only_digits(m[0])) <= 15:
                    found.append((at, 3, m.end()))
        elif kind == "url":
            if at >= done["url"] and (m := AUTHORITY.match(text, at + 3)):
                start = at
                while start > done["url"] and text[start - 1] in SCHEME:
                    start -= 1
                done["url"] = m.end()
                if start < at and PERSONAL_URL.match(text, at + 3, m.end()):
                    found.append((start, 4, m.end()))
        elif at >= done["account"] and (where := _account(text, last + 1)):
            done["account"] = where[1]
            found.append((where[0], 5, where[1]))
    found.sort()
    return found


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            counts, sha, text_spans, total = [[] for _ in BASE], [], [], []
            for text in part.column(1).to_pylist():
                found = spans(text) if text else []
                base = [x for x in found if x[1] < len(BASE)]
                for k, column in enumerate(counts):
                    column.append(sum(x[1] == k for x in base))
                sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
                text_spans.append(joined(found))
                total.append(len(found))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(text_spans, pa.string()), pa.array(total, pa.int64())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])


def find_pii(docs: DataFrame) -> DataFrame:
    """A row per document: the counts of the base kinds, the digest of their spans, all spans and their number."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def masked(text: str | None) -> str | None:
    """``text`` with every stretch of spans replaced by the kind of its first span."""
    if not text:
        return text
    out, at, open_until = [], 0, 0
    for start, kind, end in spans(text):
        if start >= open_until:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = open_until = max(open_until, end)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame) -> DataFrame:
    """The same rows and columns with the spans in ``text`` replaced, and ``n_chars`` counted anew."""

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                at = part.schema.get_field_index("text")
                texts = pa.array([masked(t) for t in part.column(at).to_pylist()], part.schema.field(at).type)
                yield part.set_column(at, part.schema.field(at), texts)

    out = docs.mapInArrow(mask, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
