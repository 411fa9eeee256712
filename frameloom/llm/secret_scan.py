"""Secret scans: fixed patterns, and literals judged by the names they are assigned to.

The lexer cuts source and configuration text into names, strings (with escapes, triple quotes, backticks),
operators and newlines; the parser reads assignments from them: `name = x`, `name := x`, `name: x`,
`"name": x`, `name => x`, `table["name"] = x`, `name: Type = x`, YAML block scalars and `<name>x</name>`.
A value is a string or a bare word, several joined by `+`, `.`, a line's end with a backslash, or
nothing, the strings of a list or of a call's arguments, or both branches of `condition ? x : y`. A bare word (or a string of `$word` alone) that is itself an assigned name is a constant
reference: it stands for that name's latest assignment before it, or else for its first one after it.

Sensitivity goes from names to what they are assigned: an assignment has the highest of its own name and of
the names that reach it through references, however many steps away. A name is as sensitive as its most sensitive
part: a stem anywhere in it, a word of its own, or a qualifier with a later `key`; the tables are parameters. A
literal's score is that sensitivity times how much the literals of its assignment tell together, in bits of their own
letters' distribution, which never falls as they get longer; from a threshold on its span is reported as kind
`lexed`, besides the pattern spans, which are always reported. So is the password of a URL with a login that is
assigned to any name. Names, literals and chains have no longest length, and the work grows with the text.

Spans are in code points, the end exclusive, without quotes. Each document is judged by itself, whole and
in one pass of an Arrow batch, so nothing is shuffled and no key can be hot.

Defined results: null and empty texts have no spans; overlapping spans of different kinds are all
reported; equal rows get equal results; a called or indexed name is no literal; ids are cast to long. Columns other than the
named two are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.frames import keyed_texts, over_batches

# The base patterns; matches that are too short are dropped after matching.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run of hex digits is one match, so the length can stand in the pattern
# Kinds in the order of a report.
KINDS = ("assign", "access", "hex", "lexed")


class Names(NamedTuple):
    """How sensitive names make literals: stems anywhere in their letters, whole words, and qualifiers of a later key."""

    stems: dict[str, float]
    words: dict[str, float]
    qualifiers: dict[str, float]


NAMES = Names(
    {"passw": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0, "credential": 0.9, "authkey": 0.9, "pwd": 0.8},
    {"pass": 0.8, "passphrase": 1.0, "passcode": 0.9, "bearer": 0.9, "cred": 0.8, "creds": 0.8, "jwt": 0.8, "hmac": 0.8},
    {"api": 1.0, "access": 1.0, "private": 1.0, "encrypt": 0.9, "encryption": 0.9, "decrypt": 0.9, "sign": 0.9, "signing": 0.9, "auth": 0.9, "client": 0.8, "master": 0.9, "shared": 0.8, "session": 0.8, "service": 0.8, "ssh": 0.9, "webhook": 0.8, "account": 0.8, "deploy": 0.8},
)
#: One of these stands in the letters of every sensitive name.
TRACES = ("passw", "pass", "secret", "token", "key", "cred", "pwd", "bearer", "jwt", "hmac")
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: What may stand between the letters of a sensitive part of a name.
SEPARATORS = b"0123456789_.-:"
TOKEN = re.compile(
    r"""(?P<string>(?:(?<!\w)[rRbBuUfFL@]{1,2}(?=["'])|(?<!\w)(?=')|(?=["`]))(?:\"{3}(?:[^\\"]|\\.|"(?!""))*+\"{3}|'{3}(?:[^\\']|\\.|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`))
    |(?P<name>[A-Za-z_][\w.-]*+)
    |(?P<assign>:=|=>|\?=|\+=|=(?![=~])|:(?![/:]))
    |(?P<other>\\.|[=!<>]=+|=~|::|\w+|\S|\n)""",
    re.X | re.A | re.S,
)
#: What may mark a string's kind, and its quotes.
STRING = re.compile(r"""(?:[rRbBuUfFL@]{1,2}(?=["']))?(?P<quote>\"{3}|'{3}|["'`])""")
BARE = re.compile(r"""[^\s"'`,;#(){}\[\]]++""")
NAME = re.compile(r"\$?\{?([A-Za-z_][\w.-]*)\}?", re.A)
SHELL = re.compile(r"\$\{?([A-Za-z_]\w*)\}?", re.A)
_TYPE = r"""[A-Za-z_][\w.]*+(?:\[[^\n=:;"'{}]*\]|<[^\n=:;"'{}]*>)?\??"""
ANNOTATION = re.compile(rf"[\x20\t]*{_TYPE}(?:[\x20\t]*\|[\x20\t]*{_TYPE})*[\x20\t]*=(?![=>~])[\x20\t]*", re.A)
GAP = re.compile(r"[\x20\t]*(?:\\\r?\n[\x20\t]*)*")
BLANKS = re.compile(r"\s*")
JOINED = re.compile(r"""\s*(?:\+|\.{1,2})\s*(?=[rRbBuUfFL@]{0,2}["'`]|[A-Za-z_$])""")
ELSE = re.compile(r"[\x20\t]*:(?![:=])[\x20\t]*")
BLOCK = re.compile(r"[|>][+-]?\d?[\x20\t]*\r?\n")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>\s*+([^<>]*[^<>\s])\s*</\1\s*>", re.A)
SPACES = re.compile(" *")
ESCAPED = re.compile(r"\\(.)", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
LOGIN = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@"']*:([^\s/@"']+)@""")
LOW_RANDOMNESS = 0.5
#: Eight different letters tell this much.
FULL_BITS = 24
THRESHOLD = 0.5


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches; low is the text in lower case, for a cheap first look."""
    spans = []
    if any(x in low for x in ("password", "passwd", "secret", "token", "apikey", "api_key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return spans


def sensitivity(name: str, names: Names = NAMES) -> float:
    low = name.lower()
    flat = re.sub(r"[^a-z]", "", low)
    best = max((weight for stem, weight in names.stems.items() if stem in flat), default=0.0)
    for parts in ([x.lower() for x in PARTS.findall(name)], re.findall("[a-z]+", low)):
        best = max([best, *(names.words.get(x, 0.0) for x in parts)])
        if "key" in parts or "keys" in parts:
            last = max(i for i, x in enumerate(parts) if x in ("key", "keys"))
            best = max([best, *(names.qualifiers.get(x, 0.0) for x in parts[:last])])
    return best


def randomness(literal: str) -> float:
    """0 to 1: what the literal tells by its letters' distribution, in shares of FULL_BITS; halved for several plain words."""
    n = len(literal)
    if n < 8:
        return 0.0
    bits = n * math.log2(n) - sum(c * math.log2(c) for c in Counter(literal).values())
    one = not any(c.isspace() for c in literal)  # a name that is sensitive at all needs no digit in a single word
    return min(1.0, bits / FULL_BITS) * (1.0 if one or any(c.isdigit() for c in literal) or any(c in "+/=_-." for c in literal) else LOW_RANDOMNESS)


class Assignment(NamedTuple):
    """name at a place of the text; parts: literals (start, end, value) and references (name, start, end), each a value of its own if apart."""

    place: int
    name: str
    literals: list[tuple[int, int, str]]
    references: list[tuple[str, int, int]]
    apart: bool = False


class Found(NamedTuple):
    """What the lexer knows of a text: where strings begin and end, what strings stand right inside each bracket, and the places of `?` and of what ends an operand."""

    strings: dict[int, int]
    inside: dict[int, list[int]]
    stops: list[int]
    asks: set[int]


def lexed(text: str) -> tuple[list[tuple[str, int, int]], Found]:
    tokens = [(m.lastgroup, m.start(), m.end()) for m in TOKEN.finditer(text)]
    strings, inside, stops, asks, open_at = {}, defaultdict(list), [], set(), []
    for kind, a, b in tokens:
        word = text[a:b] if b == a + 1 else ""
        if kind == "string":
            strings[a] = b
            if open_at:
                inside[open_at[-1]].append(a)
        elif word and word in "([{":
            open_at.append(a)
        elif word and word in ")]}":
            del open_at[-1:]
        if kind == "assign" or (word and word in "\n;,{}?"):
            stops.append(a)
            if word == "?":
                asks.add(a)
    return tokens, Found(strings, inside, stops, asks)


def string_at(text: str, at: int, strings: dict[int, int]) -> tuple[int, int, int] | None:
    """(start, end, after) of the content of the string that begins at a place."""
    m = STRING.match(text, at)
    after = strings.get(at) if m else None
    if after is None:
        return None
    n = 3 if after - m.start("quote") >= 6 and len(m["quote"]) == 3 else 1
    return m.start("quote") + n, after - n, after


def contents(text: str, places: list[int], strings: dict[int, int]) -> list[tuple[int, int, str]]:
    """The literals of strings that begin at some places."""
    found = (string_at(text, p, strings) for p in places)
    return [(a, b, unescaped(text[a:b])) for a, b, _ in found if b > a]


def unescaped(literal: str) -> str:
    return ESCAPED.sub(lambda m: ESCAPES.get(m[1], m[1]), literal) if "\\" in literal else literal


#: Literals, references, where reading goes on, and whether they are values apart.
Value = tuple[list[tuple[int, int, str]], list[tuple[str, int, int]], int, bool]


def branches_at(text: str, at: int, known: Found) -> Value | None:
    """The values of `? x : y` if what goes before, from a place on, is a condition that ends there."""
    i = bisect_left(known.stops, at)
    if i == len(known.stops) or known.stops[i] not in known.asks:
        return None
    literals, references, at, _ = value_at(text, known.stops[i] + 1, known, branch=True)
    m = ELSE.match(text, at)
    if not m or not (literals or references):
        return None
    more, others, at, _ = value_at(text, m.end(), known, branch=True)
    return literals + more, references + others, at, True


def value_at(text: str, at: int, known: Found, branch: bool = False) -> Value:
    """The expression that begins at a place."""
    strings = known.strings
    literals, references, apart = [], [], False
    at = GAP.match(text, at).end()
    if text[at : at + 1] == "[":
        return contents(text, known.inside.get(at, []), strings), [], at + 1, True
    inside = text[at : at + 1] == "("
    space = BLANKS if inside else GAP
    if inside:
        at = space.match(text, at + 1).end()
    while True:
        found = string_at(text, at, strings)
        if found:
            a, b, at = found
            shell = SHELL.fullmatch(text, a, b)
            if shell:
                references.append((shell[1], a, b))
            elif b > a:
                literals.append((a, b, unescaped(text[a:b])))
        else:
            m = BARE.match(text, at)
            if not m:
                break
            a, b = m.start(), m.end() - (m[0][-1] == ":")
            at = b
            name = NAME.fullmatch(text, a, b)
            if name and not branch and (found := branches_at(text, b, known)):
                return found
            if name and text[b : b + 1] == "(":
                literals += contents(text, known.inside.get(b, []), strings)
                apart = True
                break
            if name and text[b : b + 1] != "[":
                references.append((name[1], a, b))
            elif not name and b > a:
                literals.append((a, b, text[a:b]))
                break
        more = JOINED.match(text, at)
        if more:
            at = more.end()
        elif found and string_at(text, space.match(text, at).end(), strings):
            at = space.match(text, at).end()
        else:
            break
    return literals, references, at, apart


def block_at(text: str, line: int, at: int) -> tuple[int, int, int]:
    """(start, end, after) of the lines after a place that are indented deeper than the line that begins at `line`."""
    indent = SPACES.match(text, line).end() - line
    start = end = None
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        inner = text[at:stop].strip()
        if inner:
            first = at + len(text[at:stop]) - len(text[at:stop].lstrip())
            if first - at <= indent:
                break
            start, end = first if start is None else start, first + len(inner)
        at = stop + 1
    return (start, end, min(at, len(text))) if start is not None else (at, at, at)


def assignments(text: str) -> list[Assignment]:
    """Every assignment in order of place."""
    tokens, known = lexed(text)
    strings = known.strings
    found = []
    skip = 0  # tokens that begin before this place belong to a value that was read
    for i, (kind, a, b) in enumerate(tokens):
        if kind != "assign" or a < skip or not i:
            continue
        t = i - 1
        if t and text[tokens[t][1] : tokens[t][2]] == "]":
            t -= 1
        target, at, end = tokens[t]
        if target == "string":
            start, stop, _ = string_at(text, at, strings)
            name = text[start:stop]
        elif target == "name" and t == i - 1:
            name = text[at:end]
        else:
            continue
        if text[b - 1] == ":":
            note = ANNOTATION.match(text, b)
            if note:  # or two assignments in prose, so the inner one is read as well
                literals, references, _, apart = value_at(text, note.end(), known)
                found += [Assignment(at, name, literals, references, apart)] * bool(literals or references)
                continue
            m = BLOCK.match(text, GAP.match(text, b).end())
            if m:
                start, stop, skip = block_at(text, text.rfind("\n", 0, at) + 1, m.end())
                if stop > start:
                    found.append(Assignment(at, name, [(start, stop, text[start:stop])], []))
                continue
        literals, references, skip, apart = value_at(text, b, known)
        if literals or references:
            found.append(Assignment(at, name, literals, references, apart))
    if "</" in text:
        found += [Assignment(m.start(1), m[1], [(m.start(2), m.end(2), m[2])], []) for m in ELEMENT.finditer(text)]
        found.sort(key=lambda x: x.place)
    return found


def lexed_spans(text: str, low: str, names: Names = NAMES) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of literals that sensitive names reach, constants followed, and of passwords in assigned URLs."""
    flat = low.encode("utf-8", "surrogatepass").translate(None, SEPARATORS)
    login = "://" in text and "@" in text
    if not login and not any(x.encode() in flat for x in (TRACES if names is NAMES else ("key", *names.stems, *names.words))):
        return []
    found = assignments(text)
    of_name = defaultdict(list)
    for i, x in enumerate(found):
        of_name[x.name].append(i)
    # the most sensitive first, so each assignment is reached once, at its highest weight
    weights: dict[int, float] = {}
    direct = sorted(((sensitivity(x.name, names), i) for i, x in enumerate(found)), key=lambda x: -x[0])
    for weight, i in direct:
        todo = [i] if weight and i not in weights else []
        while todo:
            i = todo.pop()
            if i in weights:
                continue
            weights[i] = weight
            for name, _, _ in found[i].references:
                others = of_name.get(name, ())
                k = bisect_left(others, i)
                if k:
                    todo.append(others[k - 1])
                else:
                    todo += [j for j in others[:2] if j != i][:1]
    best: dict[tuple[int, int], float] = {}
    for i, weight in weights.items():
        # a name that nothing assigns is a word of its own
        parts = sorted([*found[i].literals, *((a, b, text[a:b]) for name, a, b in found[i].references if name not in of_name)])
        for values in [[p] for p in parts] if found[i].apart else [parts]:
            score = weight * randomness("".join(value for _, _, value in values))
            if score >= THRESHOLD:
                for a, b, _ in values:
                    best[a, b] = max(score, best.get((a, b), 0.0))
    for a, b, _ in (part for x in found if login for part in x.literals):
        for m in LOGIN.finditer(text, a, b):
            if (score := randomness(m[1])) >= THRESHOLD:
                best[m.span(1)] = max(score, best.get(m.span(1), 0.0))
    return [(a, 3, b, s) for (a, b), s in best.items()]


def spans_of(text: str, names: Names = NAMES) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), both sorted by start, then kind."""
    low = text.lower()
    base = sorted(base_spans(text, low))
    return base, sorted(base + [x[:3] for x in lexed_spans(text, low, names)])


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", names: Names = NAMES) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_lexed."""

    def report(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column(0), "n_assign": [], "n_access": [], "n_hex": [], "base_sha256": [], "spans": [], "n_lexed": []}
        for text in batch.column(1).to_pylist():
            base, every = spans_of(text or "", names)
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(every))
            out["n_lexed"].append(len(every) - len(base))
        return out

    read = keyed_texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return over_batches(read, report, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")
