"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastrain.llm.common import arrow_map, column, documents

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "local_phone")
KINDS = BASE_KINDS + ADDED_KINDS

# Prior score of a confirmed span, by kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3, "local_phone": 0.3}
# Words that speak for and against a kind when they stand near a span.
FOR = {
    "email": "email e-mail mail contact write",
    "ip": "ip address host server client login",
    "card": "card visa mastercard amex credit payment",
    "phone": "phone tel telephone call mobile fax contact",
    "iban": "iban account bank transfer",
    "ssn": "ssn social security taxpayer",
    "local_phone": "phone tel telephone call mobile fax contact",
}
AGAINST = {
    "email": "example noreply",
    "ip": "version release build section",
    "card": "isbn order tracking serial",
    "phone": "isbn order tracking serial",
    "iban": "serial part",
    "ssn": "order part serial isbn",
    "local_phone": "order part serial isbn",
}
# Length of an IBAN by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
WINDOW = 48
SHIFT = 0.25

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGITS = re.compile(r"[0-9]++(?:[ .-][0-9]++)*+")  # every ip and card lies within one of these
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN_HEAD = re.compile(r"[A-Z]{2}[0-9]{2}")
_IBAN = {country: re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){%d}" % (n - 4)) for country, n in IBAN_LENGTHS.items()}
_SSN = re.compile(r"(?<![0-9])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![0-9])")
_NEAR = {
    kind: tuple(re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, words[kind].split())) + r")(?!\w)") for words in (FOR, AGAINST))
    for kind in KINDS
}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[Span]:
    """A local part is the run before its '@', not reaching into the match before; found from the '@' back."""
    free = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        start = free + len(text[free:at].rstrip(_LOCAL))
        free = at + 1
        if start < at:
            yield "email", start, m.end()
            free = m.end()


def _in_digits(text: str) -> Iterator[Span]:
    for run in _DIGITS.finditer(text):
        lo, hi = run.span()
        if hi - lo < 7:
            continue
        for m in _IP.finditer(text, lo, hi):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                yield "ip", *m.span()
        for m in _CARD.finditer(text, lo, hi):
            if m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    yield "card", *m.span()
        for kind, pattern in (("ssn", _SSN), ("local_phone", _LOCAL_PHONE)):
            for m in pattern.finditer(text, lo, hi):
                yield kind, *m.span()


def _phones(text: str) -> Iterator[Span]:
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(m[0].count, "0123456789")) <= 15:
            yield "phone", *m.span()


def _ibans(text: str) -> Iterator[Span]:
    """Every head at a word start is tried at its country's length; the search goes on behind what is accepted."""
    free = 0
    for head in _IBAN_HEAD.finditer(text):
        at = head.start()
        if at < free or head[0][:2] not in _IBAN or (at and text[at - 1].isalnum()):
            continue
        m = _IBAN[head[0][:2]].match(text, at)
        if m and not text[m.end() : m.end() + 1].isalnum() and mod_97(m[0].replace(" ", "")):
            yield "iban", *m.span()
            free = m.end()


def score(text: str, span: Span) -> float:
    """Prior of the kind, moved up or down once by words within WINDOW characters on either side."""
    kind, start, end = span
    near = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
    up, down = (bool(p.search(near)) for p in _NEAR[kind])
    return min(1.0, max(0.0, PRIOR[kind] + SHIFT * (up - down)))


def spans_of(text: str, threshold: float = 0.5) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive.

    Spans of the base kinds stay whatever their score. Spans of the added kinds need the threshold and
    must not overlap a base span.
    """
    found = [*_emails(text), *_in_digits(text), *_phones(text), *_ibans(text)]
    base = [s for s in found if s[0] in BASE_KINDS]
    out = [(*s, score(text, s)) for s in base]
    taken = sorted((s[1], s[2]) for s in base)
    for s in found:
        if s[0] in ADDED_KINDS and not _overlaps(taken, s[1], s[2]) and (sure := score(text, s)) >= threshold:
            out.append((*s, sure))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    at = bisect_left(taken, (end, 0))
    return any(hi > start for _, hi in taken[max(0, at - len(BASE_KINDS)) : at])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, spans (array of kind, start, end, score).

    Null and empty texts have no spans. Rows that repeat are each returned; an empty table gives no
    rows; columns other than id and text are not read. Time is linear in the text for every pattern.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t, threshold)] for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return arrow_map(
        documents(docs, id_col, text_col), run, "doc_id bigint, spans array<struct<kind:string,start:int,end:int,score:double>>"
    )


def joined(spans: Column) -> Column:
    """Spans as kind:start:end joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def masked(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first stands."""
    out, at = [], 0
    for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
            at = end
    return "".join(out) + text[at:]
