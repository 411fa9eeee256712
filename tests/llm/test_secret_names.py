"""Secret scans: names by parts, lists, calls and conditionals, scores that never fall, and an independent reader of plain assignments."""

from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import secret_scan
from frameloom.llm.secret_scan import NAMES, Names, randomness, sensitivity, spans_of
from tests.llm.data import docs_frame

KEY, OTHER = "Zx91kqP0tT33", "Qw82kqP0mN47"


def lexed(text, names=NAMES):
    return [text[a:b] for a, k, b in spans_of(text, names)[1] if secret_scan.KINDS[k] == "lexed"]


@pytest.mark.parametrize("text, want", [
    (f'signing_key = "{KEY}"', [KEY]), (f'signingKey: "{KEY}"', [KEY]), (f'{{"pass": "{KEY}"}}', [KEY]), (f'bearer = "{KEY}"', [KEY]), (f'DB_PASS={KEY}', [KEY]), (f'encryption-keys: "{KEY}"', [KEY]), (f'SSHKey = "{KEY}"', [KEY]),
    (f'conn = "postgres://u:{KEY}@h/db"', [KEY]), (f"url: https://u:{KEY}@h", [KEY]), (f'credentials = ["{KEY}", \'{OTHER}\', "dev"]', [KEY, OTHER]), (f'my_secret_x = f("{KEY}")', [KEY]), (f'credential = a.b.load(1, "{KEY}", c="x")', [KEY]),
    (f'const pwd = isProd ? "{KEY}" : "dev"', [KEY]), (f'const pwd = x == 3 ? A : "{KEY}";\nA = "{OTHER}"', [KEY, OTHER]), (f'x = f(pwd="{KEY}")', [KEY]), (f'credential = [\n  "{KEY}",\n  # note\n  "{OTHER}",\n]', [KEY, OTHER]), (f'L = ["{KEY}", "b"]\ncredential = L', [KEY]),
    (f'compass = "{KEY}"', []), (f'monkey = "{KEY}"', []), (f'key = "{KEY}"', []), (f'key_sign = "{KEY}"', []), (f'bypass: "{KEY}"', []), ('pwd = "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"', []), ('conn = "postgres://u:pw@h/db"', []), (f'see postgres://u:{KEY}@h here', []),
    (f'credential = other["{KEY}"]', []), (f'pwd_label = cond ? yes "{KEY}"', []),
])
def test_names_and_values(text, want):
    assert lexed(text) == want


def test_names_are_a_parameter(spark):
    names = Names({"geheim": 1.0}, {"losung": 0.9}, {})
    assert lexed(f'geheimnis = "{KEY}"; pwd = "{OTHER}"', names) == [KEY] and lexed(f'losung = "{KEY}"', names) == [KEY]
    got = secret_scan.secret_report(docs_frame(spark, [f'losung = "{KEY}"', None]), names=names).collect()
    assert sorted(r.n_lexed for r in got) == [0, 1]
    assert sensitivity("clientSecretRef") == 1.0 and sensitivity("client_ref_key") == 0.8 and sensitivity("") == 0.0


@settings(max_examples=500, deadline=None)
@given(st.text("0123456789abcdefXYZ+-", min_size=8, max_size=80), st.text("0123456789abcdefXYZ+-", max_size=20))
def test_more_evidence_never_lowers_a_score(literal, more):
    assert randomness(literal + more) >= randomness(literal) - 1e-12 and 0 <= randomness(literal) <= 1


@pytest.mark.parametrize("letters", ["0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"])
def test_long_secrets_of_few_letters_are_found(letters):
    rng = random.Random(3)
    for n in (16, 32, 48, 64, 200, 2000):
        for name in ("pwd", "credential", "auth_key", "signing_key"):
            value = "".join(rng.choice(letters) for _ in range(n))
            assert value in lexed(f'{name} = "{value}"')


WORDS = ["pwd", "credential", "auth_key", "size", "colour", "signing_key", "monkey"]
LINE = st.tuples(st.sampled_from(WORDS), st.sampled_from([" = ", "=", ": ", " := ", " => "]), st.sampled_from(['"{}"', "'{}'", "[\"{}\", 'other']", 'f("{}")', 'x ? "{}" : "b"', "`{}`", '"" + "{}"']), st.sampled_from([KEY, OTHER, "plain", "two words here"]))


@settings(max_examples=300, deadline=None)
@given(st.lists(LINE, max_size=6))
def test_against_a_reader_of_single_lines(lines):
    """Line by line: the name before the sign, then whatever stands in quotes, kept if name and value are enough by themselves."""
    text = "\n".join(name + sign + shape.format(value) for name, sign, shape, value in lines)
    want, at = [], 0
    for line in text.split("\n"):
        name = re.match(r"\w*", line)[0]
        weight = {"pwd": 0.8, "credential": 0.9, "auth_key": 0.9, "signing_key": 0.9}.get(name, 0.0)
        for m in re.finditer(r"""(["'`])(.*?)\1""", line):
            if m[2] and weight * randomness(m[2]) >= 0.5:
                want.append(f"{at + m.start(2)}:{at + m.end(2)}")
        at += len(line) + 1
    assert [f"{a}:{b}" for a, k, b in spans_of(text)[1] if k == 3] == want


@pytest.mark.parametrize("unit", ["pwd=f(", "pwd=a ? ", 'pwd=["x",', "pwd=b ", "pwd=x ? y : ", "://a:b@", "pwd=(", '"', "pwd: a\n ", "key=["])
def test_odd_texts_take_no_longer_than_they_are_long(unit):
    import time

    began = time.time()
    spans_of(unit * 8000)
    assert time.time() - began < 5
