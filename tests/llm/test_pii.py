import hashlib
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from aerolith.llm import pii, queries
from tests.conftest import SF

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == 1:
        return all(int(p) <= 255 for p in value.split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text or "") if valid(k, m[0]))


def base(text):
    return [x for x in pii.spans(text or "") if x[1] < 4]


@settings(max_examples=400)
@given(st.text("a.@+-_% 0123459()\nÉ", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=300)
@given(st.lists(st.sampled_from(["4041894974608795", "+1 (988) 555-2485", "42.144.35.254", "a.b@c.d", " ", "-", "1", "@", "+", ".", "300.1.1.1", "iban", "://"]), max_size=12).map("".join))
def test_base_spans_of_glued_parts(text):
    assert base(text) == brute(text)


def test_base_spans_on_documents(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = pii.find_pii(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute(rows[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()


def test_added_kinds():
    text = "IBAN: DE89 3704 0044 0532 0130 00, see https://me:pw@host/x and account no. 12345678; http://plain.org/a"
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.spans(text) if k > 3] == [("account", "DE89 3704 0044 0532 0130 00"), ("url", "https://me:pw@host/x"), ("account", "12345678")]


def test_masking_keeps_columns_and_rows(make_docs, odd_rows):
    docs = make_docs([*odd_rows, (9, "mail a@b.org or +1 (988) 555-2485!")])
    out = pii.mask_pii(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    assert out.where("doc_id = 9").first().text == "mail [EMAIL] or [PHONE]!"
    assert out.where("doc_id = 9").first().n_chars == len("mail [EMAIL] or [PHONE]!")


def test_odd_rows(make_docs, odd_rows):
    rows = pii.find_pii(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows) and all(r.spans == "" for r in rows)
    assert pii.find_pii(make_docs([])).count() == 0


def test_very_long_runs_are_linear():
    """Twenty times the text takes less than a hundred times as long."""
    for unit in ("1", "1.", "+1(", "1 ", "a@", "iban ", "account: 1 ", "a://b?", "passport" + " " * 40, "0.0.0.", "GB00 1"):
        times = []
        for n in (10_000, 200_000):
            text = unit * (n // len(unit)) + "@"
            began = time.perf_counter()
            found = base(text)
            times.append(time.perf_counter() - began)
            if n == 10_000:
                assert found == brute(text)
        assert times[1] < 100 * max(times[0], 1e-3)


def test_octets_of_any_length():
    text = f"at {'0' * 5000}1.2.3.{'0' * 9000} and {'9' * 6000}.1.1.1"
    assert [x for x in pii.spans(text) if x[1] == 1] == [(3, 1, 3 + 5001 + 5 + 9000)]


@pytest.mark.parametrize("blanks", [0, 1, 60, 66, 70, 500])
def test_identifiers_far_behind_their_cue(blanks):
    text = f"account number:{' ' * blanks}1234567890123456 end"
    assert [(pii.KINDS[k], text[s:e]) for s, k, e in pii.spans(text) if k == 5] == [("account", "1234567890123456")]


#: One planted value of each kind, as texts write it.
PLANTED = {
    "email": lambda r: f"{r.choice('abcdef')}{r.randrange(999)}.x@mail-{r.randrange(99)}.example.org",
    "ip": lambda r: ".".join(str(r.randrange(256)) for _ in range(4)),
    "card": lambda r: r.choice(["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "30000000000004"]),
    "phone": lambda r: f"+{r.randrange(1, 99)} ({r.randrange(100, 999)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}",
    "url": lambda r: r.choice([f"https://user{r.randrange(99)}:pw@host.org/x", f"http://site.org/users/name{r.randrange(99)}", "ftp://a.b/c?email=me%40x.y"]),
    "account": lambda r: r.choice(["IBAN DE89 3704 0044 0532 0130 00", f"account no. {r.randrange(10**7, 10**8)}", f"Passport: C{r.randrange(10**7, 10**8)}", f"SSN {r.randrange(10**8, 10**9)}"]),
}


@pytest.mark.parametrize("kind", pii.KINDS)
def test_planted_values_are_found(kind):
    """Every planted value lies in a span of its kind; the words around hold none."""
    rng = random.Random(3)
    for _ in range(300):
        before, value, after = (" ".join(rng.choice(["lorem", "ipsum", "dolor", "sit"]) for _ in range(rng.randrange(1, 9))), PLANTED[kind](rng), "amet, end.")
        found = pii.spans(f"{before} {value} {after}")
        own = [(s, e) for s, k, e in found if pii.KINDS[k] == kind]
        assert any(s < len(before) + 1 + len(value) and e > len(before) + 1 for s, e in own), value
        assert all(s > len(before) and e <= len(before) + 1 + len(value) for s, _, e in found), value


def test_query_on_documents(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op9_pii(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        found = pii.spans(rows[r.doc_id])
        assert [x for x in found if x[1] < 4] == brute(rows[r.doc_id])
        assert r.spans == pii.joined(found) and r.n_spans == len(found)
