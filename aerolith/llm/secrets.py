"""Secret scans, in DataFrame functions only.

Three base patterns give their leftmost non-overlapping matches. Beyond them, candidate strings (unbroken runs
of key characters that mix letters and digits) pass a sliding window of 20 characters whose Shannon entropy is
kept by incremental counts: one character enters, one leaves, and only their counts and terms change. A window
above the threshold of the candidate's character class makes the whole candidate an ``entropy`` span, unless an
allow-list (identifiers, placeholders, runs of the alphabet) suppresses it or a base span covers it.

Positions come from ``split`` at the pattern: the running sum of the lengths of the pieces between matches and of the
matches gives the spans in code points.

Defined results: a null text counts as empty and has no spans; null or repeated ``doc_id`` values are carried;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Bits of entropy a window of 20 characters must exceed, by the character class of its candidate.
HEX_BITS, BASE36_BITS, BASE64_BITS = 3.0, 3.6, 3.9
#: Runs and words that mark a candidate as harmless.
ALLOW = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|example|placeholder|changeme|xxxx|0123456789|abcdefgh|^[0-9+/_=-]+$|^[A-Za-z+/_=-]+$"


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """The running combination of an array's elements, by doubling: each pass combines every element with the one
    1, 2, 4, ... places before it, so n elements take n log n steps. ``combine`` is any associative function."""
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values).cast("double"))).cast("int") - 1)
    power = lambda k: F.call_function("shiftleft", F.lit(1), k)
    ahead = lambda acc, k: F.size(acc) - power(k)

    def double(acc: Column, k: Column) -> Column:
        moved = F.zip_with(F.slice(acc, F.lit(1), ahead(acc, k)), F.slice(acc, power(k) + 1, ahead(acc, k)), combine)
        return F.concat(F.slice(acc, F.lit(1), power(k)), moved)

    return F.when(F.size(values) > 1, F.aggregate(passes, values, double)).otherwise(values)


def _matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost non-overlapping matches; empty where none."""
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: (F.length(g) + F.length(v)).cast("int"))
    span = lambda end, v: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value"))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.zip_with(_running(steps, lambda x, y: x + y), values, span)).otherwise(none)


#: Codes of candidate characters count from below '+', the lowest of them; 'z' is the highest.
LOWEST, SIGNS = ord("+") - 1, ord("z") - ord("+") + 1


def peak_entropy(value: Column, window: int = WINDOW) -> Column:
    """The largest Shannon entropy, in bits per character, of any ``window`` consecutive characters of a candidate.

    The state holds a count for each character, the sum of c log2 c over them, and the least such sum of a full window.
    A step adds one to the count of the character that enters and takes one from the count of the one that leaves
    (code 0 until the window is full), and replaces their two terms of the sum.
    """
    codes = F.transform(F.filter(F.split(value, "", -1), lambda c: c != ""), lambda c: F.ascii(c) - LOWEST)
    steps = F.zip_with(codes, F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), F.lit(1), F.size(codes)), lambda i, o: F.struct(i.alias("enters"), o.alias("leaves")))
    #: c log2 c for c from 0 to the window's size
    terms = F.array(*(F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)))
    term = lambda n: F.element_at(terms, n + 1)
    of = lambda counts, code: F.coalesce(F.element_at(counts, F.nullif(code, F.lit(0))), F.lit(0))

    def step(acc: Column, s: Column) -> Column:
        gone, came = of(acc["counts"], s["leaves"]), of(acc["counts"], s["enters"])
        same = s["leaves"] == s["enters"]
        change = F.when(same, F.lit(0.0)).otherwise(F.when(gone > 0, term(gone - 1) - term(gone)).otherwise(F.lit(0.0)) + term(came + 1) - term(came))
        counts = F.transform(acc["counts"], lambda n, k: n + F.when(k + 1 == s["enters"], 1).otherwise(0) - F.when(k + 1 == s["leaves"], 1).otherwise(0))
        total, at = acc["total"] + change, acc["at"] + 1
        return F.struct(F.when(same, acc["counts"]).otherwise(counts).alias("counts"), total.alias("total"), F.when(at >= window, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"), at.alias("at"))

    start = F.struct(F.array_repeat(F.lit(0), SIGNS).alias("counts"), F.lit(0.0).alias("total"), F.lit(float(1 << 30)).alias("least"), F.lit(0).alias("at"))
    return F.lit(math.log2(window)) - F.aggregate(steps, start, step, lambda acc: acc["least"]) / window


def _threshold(value: Column) -> Column:
    return F.when(value.rlike("^[0-9a-fA-F]+$"), F.lit(HEX_BITS)).when(value.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), F.lit(BASE36_BITS)).otherwise(F.lit(BASE64_BITS))


def find_secrets(docs: DataFrame) -> DataFrame:
    """A row per document: counts and digest of the base spans, and all spans."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        F.filter(_matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["value"], ASSIGN, 2)) >= 8).alias("assign"),
        _matches(text, ACCESS).alias("access"),
        _matches(text, HEX).alias("hex"),
        F.filter(_matches(text, CANDIDATE), lambda m: ~m["value"].rlike(ALLOW)).alias("candidate"),
    )
    kind = lambda name: F.transform(F.col(name), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), m["end"].alias("end")))
    rows = rows.withColumn("base", F.array_sort(F.concat(kind("assign"), kind("access"), kind("hex"))))
    # Base spans and candidates in order of their start, a base span first; the farthest end of the base spans so far
    # tells whether one covers a candidate, so that a text's spans are merged once instead of compared in pairs.
    mark = lambda m, base: F.struct(m["start"].alias("start"), F.lit(base).alias("after"), m["end"].alias("end"))
    marks = F.array_sort(F.concat(F.transform("base", lambda m: mark(m, 0)), F.transform("candidate", lambda m: mark(m, 1))))
    rows = rows.withColumn("marks", F.when(F.size("candidate") > 0, marks).otherwise(F.array().cast("array<struct<start:int,after:int,end:int>>")))
    reach = _running(F.transform("marks", lambda m: F.when(m["after"] == 0, m["end"]).otherwise(-1)), lambda x, y: F.greatest(x, y))
    # The marks of candidates stand in the candidates' own order.
    reach = F.transform(F.filter(F.zip_with("marks", reach, lambda m, r: F.struct(m["after"].alias("after"), r.alias("reach"))), lambda x: x["after"] == 1), lambda x: x["reach"])
    open_ = F.filter(F.zip_with("candidate", reach, lambda m, r: F.when(r < m["end"], m)), lambda m: m.isNotNull())
    rows = rows.withColumn("entropy", F.filter(open_, lambda m: peak_entropy(m["value"]) > _threshold(m["value"])))
    name = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(name(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        name(F.array_sort(F.concat("base", kind("entropy")))).alias("spans"),
    )
