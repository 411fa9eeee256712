"""Personal data by anchor expansion: an automaton finds where to look, small parsers find the bounds.

One Aho-Corasick automaton holds every anchor: at-signs and their written-out forms, schemes, pairs of digits as
they stand in addresses and card numbers, plus signs before digits, colons between hex digits, and the words
that announce an identifier. It walks each text once. At every anchor a parser of a few lines expands to both
sides and validates what it finds: a domain's labels, the parts of an address, checksums, numbers of digits.

Kinds `email`, `ip`, `card` and `phone` are the base kinds: exactly the leftmost non-overlapping matches of
their patterns, of which those that fail validation are dropped without another try. The method adds, as
kinds of their own that never change a base span:

- `mailbox`: addresses that the base pattern cannot read: letters outside ASCII, a quoted name, a number
  in brackets as domain, `(at)` and `(dot)` written out;
- `address`: the login and host of a URL, a URL's host that is a number, IPv6 and hardware addresses;
- `number`: telephone numbers of 7 to 15 digits without a plus sign after a word or scheme that announces one;
- `account`: identifiers after a word that announces them, where their form and checksum hold.

Spans are in code points, the end exclusive. Each parser goes on where its last result ended, so the work grows
with the text. Each document is read by itself in one pass of an Arrow batch: nothing is shuffled, no key is hot.

Defined results: null and empty texts have no spans; spans of different kinds may overlap and are all reported;
equal rows get equal results; columns other than the named two are not read; ids are cast to long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import cache
from ipaddress import AddressValueError, IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frameloom.llm.frames import keyed_texts, over_batches

# Kinds in the order of a report; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "mailbox", "address", "number", "account")
EMAIL, IP, CARD, PHONE, MAILBOX, ADDRESS, NUMBER, ACCOUNT = range(8)

#: Words that announce an identifier, and its form.
CUES = {
    "iban": "iban", "account": "account", "acct": "account", "a/c": "account", "konto": "account", "cuenta": "account", "compte": "account",
    "ssn": "ssn", "social security": "ssn", "passport": "passport", "reisepass": "passport", "pasaporte": "passport", "passeport": "passport",
    "routing": "routing", "sort code": "sort", "swift": "bic", "bic": "bic",
}
#: Words and schemes that announce a telephone number.
CALLS = ("tel:", "sms:", "callto:", "phone", "telephone", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone", "whatsapp")
AT_WORDS = ("(at)", "[at]", "{at}")

Span = tuple[int, int, int]
Reader = Callable[[str, int, int, int], tuple[list[Span], int]]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = "0123456789"
HEX = "0123456789abcdef"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGIT_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"[\x20().0-9-]+")
_LABEL = r"[^\W_]+(?:-+[^\W_]+)*"
ANY_DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})+")
NUMBER_DOMAIN = re.compile(r"\[([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\]")
SPOKEN_DOMAIN = re.compile(rf"\x20?({_LABEL}(?:\x20?[(\[{{]dot[)\]}}]\x20?{_LABEL}|\.{_LABEL})+)", re.I)
AUTHORITY = re.compile(r"""[^\s/?#"'<>\\]+""")
HOST = re.compile(r"\[([0-9A-Fa-f:.]+)\]|([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![\w.-])")
COLONED = re.compile(r"(?:[0-9A-Fa-f]*:)+(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Fa-f:.])|[0-9A-Fa-f]*)")
HARDWARE = re.compile(r"[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}")
#: What may stand between an announcing word and what it announces.
FILLER = re.compile(r"(?:[\s:#=.]|-(?!\d)|(?:number|no|num|nr|numéro|número|nummer|is|id|code|us|me|at|ist|es|est)\b)*", re.I)
CALLED = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![\w+])")
FORMS = {
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}"),
    "account": re.compile(r"[0-9](?:[\x20-]?[0-9]){5,16}(?![\w])(?!-[0-9])"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}([\x20-]?)(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![\w])"),
    "passport": re.compile(r"(?=[A-Z0-9]{6,9}(?!\w))[A-Z]{0,2}[0-9]{6,9}"),
    "routing": re.compile(r"[0-9]{9}(?!\w)"),
    "sort": re.compile(r"[0-9]{2}([\x20-])[0-9]{2}\1[0-9]{2}(?!\w)"),
    "bic": re.compile(r"[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?(?!\w)"),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """A decimal number of at most 255, leading zeros or not."""
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def word_char(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at].isalnum() or text[at] == "_")


def back(text: str, at: int, floor: int, belongs: Callable[[str], bool]) -> int:
    """Where the characters that belong together before a place begin, not before floor."""
    while at > floor and belongs(text[at - 1]):
        at -= 1
    return at


# ---- base kinds; a reader takes (text, anchor's start and end, where its last result ended)


def email(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
    start = back(text, at, floor, LOCAL.__contains__)
    m = DOMAIN.match(text, end) if start < at else None
    return ([(start, EMAIL, m.end())], m.end()) if m else ([], floor)


def dotted(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
    """Fours of a chain of numbers with a point between."""
    start = back(text, at, floor, DIGITS.__contains__)
    stop = DOTTED.match(text, start).end()
    parts = text[start:stop].split(".")
    spans = []
    for i in range(0, len(parts) - 3, 4):
        four = ".".join(parts[i : i + 4])
        if all(small(p) for p in parts[i : i + 4]):
            spans.append((start, IP, start + len(four)))
        start += len(four) + 1
    return spans, stop


def card(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
    m = DIGIT_RUN.match(text, at)
    digits = m[0].replace(" ", "").replace("-", "")
    return [(at, CARD, m.end())] * (14 <= len(digits) <= 19 and luhn(digits)), m.end()


def phone(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
    m = DIALLED.match(text, end)
    if not m:
        return [], end
    dialled = m[0].rstrip(" ().-")
    if len(dialled) < 2:
        return [], end
    n = 1 + sum(c in DIGITS for c in dialled)
    stop = end + len(dialled)
    return [(at, PHONE, stop)] * (10 <= n <= 15), stop


# ---- the method's own kinds


def named_domain(domain: str) -> bool:
    """The last label is a name of two letters or more, not a number."""
    last = domain.rsplit(".", 1)[-1]
    return len(last) > 1 and not last.isdigit()


def mailbox(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
    quoted = at > floor and text[at - 1] == '"'
    if quoted:
        start = text.rfind('"', floor, at - 1)
        if start < 0 or start == at - 2 or "\n" in text[start:at]:
            return [], end
    else:
        start = back(text, at, floor, lambda c: c.isalnum() or c in "._%+-")
        start += len(text[start:at]) - len(text[start:at].lstrip(".-%+"))
        if start == at or text[at - 1] == ".":
            return [], end
    number = NUMBER_DOMAIN.match(text, end)
    if number and all(small(p) for p in number.groups()):
        return [(start, MAILBOX, number.end())], number.end()
    m = ANY_DOMAIN.match(text, end)
    if not m or not named_domain(m[0]) or (not quoted and text[start : m.end()].isascii()):
        return [], end
    return [(start, MAILBOX, m.end())], m.end()


def spoken(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
    stop = at - (at > floor and text[at - 1] == " ")
    start = back(text, stop, floor, lambda c: c.isalnum() or c in "._%+-")
    m = SPOKEN_DOMAIN.match(text, end)
    if start == stop or not m or not named_domain(re.sub(r"\x20?[(\[{]dot[)\]}]\x20?", ".", m[1].lower())):
        return [], end
    return [(start, MAILBOX, m.end(1))], m.end(1)


def authority(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
    """The part of a URL between `//` and its path, if it has a login or its host is a number."""
    m = AUTHORITY.match(text, end)
    if not m or not word_char(text, at - 1):
        return [], end
    whole = m[0].rstrip(".,;:!)]}") if "[" not in m[0] else m[0].rstrip(".,;:!)}")
    login, sign, host = whole.rpartition("@")
    if sign and login.strip(":") and host:
        return [(end, ADDRESS, end + len(whole))], m.end()
    h = HOST.match(text, end, m.end())
    if h and (version6(h[1]) if h[1] else all(small(p) for p in h[2].split("."))):
        return [(h.start(h.lastindex), ADDRESS, h.end(h.lastindex))], m.end()
    return [], m.end()


def version6(s: str) -> bool:
    try:
        return bool(IPv6Address(s))
    except AddressValueError:
        return False


def coloned(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
    """Hex numbers with colons between: IPv6 with two numbers at least, or a hardware address."""
    start = back(text, at, floor, lambda c: c in "0123456789abcdefABCDEF:")
    stop = max(COLONED.match(text, start).end(), end)
    body = text[start:stop].rstrip(":") if not text[start:stop].endswith("::") else text[start:stop]
    inside = not word_char(text, start - 1) and not word_char(text, start + len(body))
    is_v6 = len(body) <= 45 and sum(bool(x) for x in body.split(":")) > 1 and any(c in DIGITS for c in body) and version6(body)
    return [(start, ADDRESS, start + len(body))] * (inside and bool(is_v6 or HARDWARE.fullmatch(body))), stop


def announced(text: str, at: int, end: int) -> int | None:
    """Where what a whole word announces begins."""
    if word_char(text, at - 1) or (text[end - 1].isalpha() and word_char(text, end)):
        return None
    return FILLER.match(text, end).end()


def called(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
    start = announced(text, at, end)
    m = CALLED.match(text, start) if start is not None else None
    n = sum(c in DIGITS for c in m[0]) if m else 0
    return ([(start, NUMBER, m.end())], m.end()) if 7 <= n <= 15 else ([], end)


def identifier(form: str) -> Reader:
    pattern = FORMS[form]

    def read(text: str, at: int, end: int, floor: int) -> tuple[list[Span], int]:
        start = announced(text, at, end)
        m = pattern.match(text, start) if start is not None else None
        stop = m and valid(form, text, start, m.end())
        return ([(start, ACCOUNT, stop)], stop) if stop else ([], end)

    return read


def valid(form: str, text: str, start: int, stop: int) -> int | None:
    """Where an identifier ends for its checksum to hold: for an iban the farthest such end of a word."""
    if form == "routing":
        d = [int(c) for c in text[start:stop]]
        return stop if (3 * sum(d[::3]) + 7 * sum(d[1::3]) + sum(d[2::3])) % 10 == 0 and any(d) else None
    if form != "iban":
        return stop
    for end in range(stop, start + 14, -1):
        compact = text[start:end].replace(" ", "")
        if text[end - 1] != " " and not word_char(text, end) and 15 <= len(compact) <= 34:
            if int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1:
                return end
    return None


FORMS_READ = {form: identifier(form) for form in FORMS}


@cache
def automaton():
    """Every anchor with its length and its readers."""
    import ahocorasick

    readers: dict[str, list[Reader]] = {"@": [email, mailbox], "://": [authority], "::": [coloned]}

    def add(anchor: str, reader: Reader) -> None:
        readers.setdefault(anchor, []).append(reader)

    for a in DIGITS:
        add(f"+{a}", phone)
        for b in DIGITS:
            add(f"{a}.{b}", dotted)
            for between in ("", " ", "-"):
                add(f"{a}{between}{b}", card)
    for a in HEX:
        for b in HEX:
            add(f"{a}:{b}", coloned)
    for word in AT_WORDS:
        add(word, spoken)
    for word in CALLS:
        add(word, called)
    for word, form in CUES.items():
        add(word, FORMS_READ[form])
    out = ahocorasick.Automaton()
    for anchor, found in readers.items():
        out.add_word(anchor, (len(anchor), tuple(found)))
    out.make_automaton()
    return out


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """A-Z in lower case, and other letters too where that keeps every place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def spans_of(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), both sorted by start, then kind."""
    found: set[Span] = set()
    floors: dict[Reader, int] = {}
    for last, (size, readers) in automaton().iter(lowered(text)):
        at = last + 1 - size
        for reader in readers:
            floor = floors.get(reader, 0)
            if at >= floor:
                spans, floors[reader] = reader(text, at, last + 1, floor)
                found.update(spans)
    every = sorted(found)
    return [s for s in every if s[1] <= PHONE], every


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def personal_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_more."""

    def report(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column(0), "base_sha256": [], "spans": [], "n_more": []} | {f"n_{k}": [] for k in KINDS[:4]}
        for text in batch.column(1).to_pylist():
            base, every = spans_of(text or "")
            for k in range(4):
                out[f"n_{KINDS[k]}"].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(every))
            out["n_more"].append(len(every) - len(base))
        return out

    read = keyed_texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return over_batches(read, report, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_more long")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, *columns) with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""

    def mask(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for a, k, b in spans_of(text)[1]:
            if a >= at:
                out += [text[at:a], f"<{KINDS[k]}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def rows(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "text": [mask(t) for t in batch.column(1).to_pylist()]} | {f"c{i}": batch.column(i + 2) for i in range(len(columns))}

    kept = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    out = over_batches(kept, rows, schema)
    return out.select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col), *(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)))
