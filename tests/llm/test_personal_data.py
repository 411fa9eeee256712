"""Personal data: the base kinds against their patterns, the method's kinds against examples and plain patterns."""

from __future__ import annotations

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import personal_data
from frameloom.llm.personal_data import KINDS, spans_of
from tests.llm.data import AWKWARD, docs_frame


def luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def base_of(text):
    """The contract's patterns, word for word."""
    spans = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x.lstrip("0")[:4] or "0") <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        spans += [(m.start(), 2, m.end())] * (14 <= len(digits) <= 19 and luhn(digits))
    spans += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(spans)


PARTS = ["a", "é", "@", ".", "-", "+", " ", "  ", "(", ")", "1", "25", "255", "256", "4316522678525456", "%", ":", "::", "\n", "b.c", "x@y.z", "1.2.3", "+1 (743) 555-3824", "İ", "日", "://", "tel:", "account ", "/"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join))
def test_base_kinds_are_the_patterns_matches(text):
    base, every = spans_of(text)
    assert base == base_of(text)
    assert set(base) <= set(every) and len(every) == len(set(every))
    assert all(0 <= a < b <= len(text) for a, _, b in every)


FOUND = [
    ("mail Jürgen.Möller@straße.example now", "mailbox", "Jürgen.Möller@straße.example"),
    ('to "john doe"@example.com', "mailbox", '"john doe"@example.com'),
    ("root@[10.0.0.1] said", "mailbox", "root@[10.0.0.1]"),
    ("ask bob.smith (at) example (dot) com.", "mailbox", "bob.smith (at) example (dot) com"),
    ("ask bob[AT]example[DOT]co[dot]uk", "mailbox", "bob[AT]example[DOT]co[dot]uk"),
    ("see https://bob:pw@db.example.com:5432/x", "address", "bob:pw@db.example.com:5432"),
    ("http://10.1.2.3:80/", "address", "10.1.2.3"),
    ("http://[fe80::1]:80/", "address", "fe80::1"),
    ("at 2001:db8:85a3:0:0:8a2e:370:7334.", "address", "2001:db8:85a3:0:0:8a2e:370:7334"),
    ("at ::ffff:10.0.0.1,", "address", "::ffff:10.0.0.1"),
    ("mac 00:1A:2b:3c:4D:5e;", "address", "00:1A:2b:3c:4D:5e"),
    ("Phone: (743) 555-3824 today", "number", "(743) 555-3824"),
    ("tel:5553824", "number", "5553824"),
    ("Teléfono 912 345 678", "number", "912 345 678"),
    ("IBAN: GB82 WEST 1234 5698 7654 32 AND more", "account", "GB82 WEST 1234 5698 7654 32"),
    ("my SSN is 123-45-6789.", "account", "123-45-6789"),
    ("account no. 12345678", "account", "12345678"),
    ("passport number X1234567", "account", "X1234567"),
    ("routing 021000021", "account", "021000021"),
    ("sort code 12-34-56", "account", "12-34-56"),
    ("SWIFT DEUTDEFF500", "account", "DEUTDEFF500"),
]
CLEAN = [
    "it is 12:30:45 at a::b or std::vector", "an account of 3 people", "hotel:5553824", "accounts 12345678", "IBAN: GB82 WEST 1234 5698 7654 33", "ssn 000-12-3456", "routing 021000022",
    "@user said (at) length", "https://example.com/@me", "a@b c@d", "cafe: 12", "fax me 2 pages", "swift response", "no 1.2.3 here", "+1 2", "x (at) y", "sort code 12-3456",
]


@pytest.mark.parametrize("text, kind, want", FOUND)
def test_what_the_method_adds(text, kind, want):
    base, every = spans_of(text)
    assert base == base_of(text)
    assert want in [text[a:b] for a, k, b in every if KINDS[k] == kind]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay_clean(text):
    assert spans_of(text)[1] == []


def test_report_and_mask(spark):
    texts = AWKWARD + [t for t, _, _ in FOUND] + CLEAN + ["1." * 20_000, "a@" * 20_000, "1 " * 20_000, "a:b" * 10_000, "account " * 5_000, "9" * 10_000 + ".1.1.1", "x@y.z " * 3_000]
    docs = docs_frame(spark, texts, [None if i == 3 else i // 2 for i in range(len(texts))])
    got = sorted((repr(r) for r in personal_data.personal_report(docs.repartition(7)).drop("n_more").collect()))
    want = []
    for i, t in enumerate(texts):
        base = base_of(t or "")
        base_sha = hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        spans = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans_of(t or "")[1])
        want.append(repr(tuple([None if i == 3 else i // 2, *(sum(s[1] == k for s in base) for k in range(4)), base_sha, spans])))
    assert [re.sub(r"(\w+)=", "", g).removeprefix("Row") for g in got] == sorted(want)
    assert personal_data.personal_report(docs.limit(0)).count() == 0
    masked = {r.text for r in personal_data.masked(docs, columns=("lang", "node")).collect()}
    assert {"my SSN is <account>.", "<mailbox> said", None, "", "a@b c@d"} <= masked
