"""Personal data in texts: patterns propose spans, checksums confirm them, context scores them.

Base kinds are e-mail addresses, IP addresses, payment cards and phone numbers; a match
of their pattern that fails its check is dropped. Further kinds gather a score from checksum,
issuer and the nearest context word, which counts for or against them; a number of 13 to 15
digits that no issuer begins with needs such a word, as one in ten has a right Luhn digit.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logstream.llm.common import map_batches, text_or_empty

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "short_card", "national_id", "secret")

# Local part and domain are found from the "@" on, so that a long run of letters
# without one is read once only.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match of these starts where a run of digits starts, or not at all in that run.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|password=[^\s]{8,})(?![A-Za-z0-9])")
DIGIT = re.compile(r"[0-9]")
# Digits or letters that no separator parts; proposals may end where such a group ends.
GROUP = re.compile(r"[A-Z0-9]+")
LEAST_IBAN = 15
# Characters of an account number, by country.
IBAN_LENGTHS = {
    "NO": 15,
    "BE": 16,
    "DK": 18, "FI": 18, "FO": 18, "GL": 18, "NL": 18, "SD": 18,
    "MK": 19, "SI": 19,
    "AT": 20, "BA": 20, "EE": 20, "KZ": 20, "LT": 20, "LU": 20, "MN": 20, "XK": 20,
    "CH": 21, "HR": 21, "LI": 21, "LV": 21,
    "BG": 22, "BH": 22, "CR": 22, "DE": 22, "GB": 22, "GE": 22, "IE": 22, "ME": 22, "RS": 22,
    "VA": 22,
    "AE": 23, "GI": 23, "IL": 23, "IQ": 23, "OM": 23, "SO": 23, "TL": 23,
    "AD": 24, "CZ": 24, "ES": 24, "MD": 24, "PK": 24, "RO": 24, "SA": 24, "SE": 24, "SK": 24,
    "TN": 24, "VG": 24,
    "LY": 25, "PT": 25, "ST": 25,
    "IS": 26, "TR": 26,
    "BI": 27, "DJ": 27, "FR": 27, "GR": 27, "IT": 27, "MC": 27, "MR": 27, "SM": 27,
    "AL": 28, "AZ": 28, "BY": 28, "CY": 28, "DO": 28, "GT": 28, "HU": 28, "LB": 28, "NI": 28,
    "PL": 28, "SV": 28,
    "BR": 29, "EG": 29, "PS": 29, "QA": 29, "UA": 29,
    "JO": 30, "KW": 30, "MU": 30, "YE": 30,
    "MT": 31, "SC": 31,
    "LC": 32,
    "RU": 33,
}
# Words that speak for a kind, and words that speak against it; the nearest one counts.
CONTEXT = {
    "iban": ("iban", "account", "bank", "transfer"),
    "short_card": ("card", "visa", "amex", "diners", "credit", "payment"),
    "national_id": ("ssn", "social", "security", "tax"),
    "secret": ("key", "secret", "token", "login"),
}
AGAINST = {
    "iban": ("part", "serial", "model", "sku", "hash"),
    "short_card": ("timestamp", "time", "epoch", "id", "order", "serial", "tracking", "isbn", "ean"),
    "national_id": ("part", "serial", "model", "sku", "order"),
    "secret": ("placeholder", "dummy", "example"),
}
CONTEXT_CHARS = 60
# What the pattern alone is worth; what a checksum, an issuer's digits or a country's length,
# and the nearest context word add, or take away if it speaks against the kind.
PATTERN_SCORE = {"iban": 0.2, "short_card": 0.0, "national_id": 0.4, "secret": 0.6}
CHECKSUM_SCORE = 0.5
ISSUER_SCORE = 0.2
CONTEXT_SCORE = 0.3
LEAST_SCORE = 0.6
# First digits of the issuers that have numbers of 13, 14 and 15 digits.
ISSUERS = {13: ("4",), 14: ("300", "301", "302", "303", "304", "305", "36", "38", "39"), 15: ("34", "37")}
WORD = re.compile(r"[A-Za-z]+")


class Span(NamedTuple):
    """Code points ``start`` to ``end``, the latter excluded."""

    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Whether the last digit is right for the others."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod_97(number: str) -> bool:
    """Whether an account number has the right check digits."""
    plain = number.replace(" ", "")
    turned = plain[4:] + plain[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def small_byte(digits: str) -> bool:
    plain = digits.lstrip("0") or "0"
    return len(plain) <= 3 and int(plain) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_SET:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, done))
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[Span]:
    """Confirmed spans of the four base kinds, in the order of KINDS and of starts."""
    spans = [Span("email", start, end, 1.0) for start, end in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return spans
    for match in IP.finditer(text):
        if all(small_byte(part) for part in match[0].split(".")):
            spans.append(Span("ip", *match.span(), 1.0))
    for match in CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append(Span("card", *match.span(), 1.0))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, match[0])) <= 15:
                spans.append(Span("phone", *match.span(), 1.0))
    return spans


def ibans(text: str) -> list[tuple[int, int]]:
    """Account numbers with the right check digits, also where other groups follow them.

    A known country's number has its length, or else all of the match; other numbers end with
    any group of it, the longest that the check digits confirm.
    """
    found = []
    match = IBAN.search(text)
    while match:
        ends = [group.end() for group in GROUP.finditer(text, *match.span())][::-1]
        size = IBAN_LENGTHS.get(match[0][:2])
        if size:
            own = [end for end in ends if len(text[match.start() : end].replace(" ", "")) == size]
            ends = own + ends[:1]
        for end in ends:
            number = text[match.start() : end]
            if len(number.replace(" ", "")) >= LEAST_IBAN and mod_97(number):
                found.append((match.start(), end))
                break
        # What was proposed beyond the number, or in vain, may hold another.
        match = IBAN.search(text, found[-1][1] if found and found[-1][0] == match.start() else match.start() + 1)
    return found


def short_cards(text: str) -> list[tuple[int, int]]:
    """Card numbers of 13 to 15 digits that the Luhn digit confirms, also where other groups follow them.

    They start where a run of digits starts, or where the last one ends, and end with any group,
    the longest that is confirmed; unbroken ones may stand anywhere in the run.
    """
    found = []
    for match in CARD.finditer(text):
        digits = "".join(GROUP.findall(match[0]))
        if len(digits) < 13 or 16 <= len(digits) <= 19 and luhn(digits):
            continue
        groups = [group.span() for group in GROUP.finditer(text, *match.span())]
        first, fresh = 0, True
        while first < len(groups):
            size, ends = 0, []
            for last in range(first, len(groups) if fresh else first + 1):
                size += groups[last][1] - groups[last][0]
                if size > 15:
                    break
                if size >= 13:
                    ends.append(last)
            for last in reversed(ends):
                start, end = groups[first][0], groups[last][1]
                if luhn("".join(GROUP.findall(text, start, end))):
                    found.append((start, end))
                    first, fresh = last + 1, True
                    break
            else:
                first, fresh = first + 1, False
    return found


def issued(kind: str, number: str) -> bool:
    """Whether a card's first digits are an issuer's, or an account has its country's length."""
    plain = "".join(GROUP.findall(number))
    if kind == "iban":
        return IBAN_LENGTHS.get(plain[:2]) == len(plain)
    return plain.startswith(ISSUERS[len(plain)])


def further_spans(text: str) -> list[Span]:
    """Spans of the other kinds whose score is high enough."""
    spans = []
    if DIGIT.search(text):
        for span in ibans(text):
            spans += _scored("iban", text, span, True)
        for span in short_cards(text):
            spans += _scored("short_card", text, span, True)
        for match in NATIONAL_ID.finditer(text):
            spans += _scored("national_id", text, match.span(), False)
    # A password need not have a digit.
    for match in SECRET.finditer(text) if "password=" in text or "AKIA" in text else ():
        spans += _scored("secret", text, match.span(), False)
    return spans


def context(kind: str, text: str, start: int, end: int) -> int:
    """1 if the nearest context word speaks for the kind, -1 if against it, 0 without one.

    Of two equally near ones that for the kind counts. Words are looked for in CONTEXT_CHARS
    characters to each side.
    """
    nearest, sign = CONTEXT_CHARS + 1, 0
    before, after = max(0, start - CONTEXT_CHARS), end + CONTEXT_CHARS
    for low, high in ((before, start), (end, after)):
        for match in WORD.finditer(text, low, high):
            word = match[0].lower()
            found = (word in CONTEXT[kind]) - (word in AGAINST[kind])
            away = start - match.end() if high == start else match.start() - end
            if found and (away, -found) < (nearest, -sign):
                nearest, sign = away, found
    return sign


def _scored(kind: str, text: str, span: tuple[int, int], confirmed: bool) -> list[Span]:
    start, end = span
    score = PATTERN_SCORE[kind] + CHECKSUM_SCORE * confirmed
    score += ISSUER_SCORE * (confirmed and issued(kind, text[start:end]))
    score = round(min(1.0, score + CONTEXT_SCORE * context(kind, text, start, end)), 2)
    return [Span(kind, start, end, score)] if score >= LEAST_SCORE else []


def joined(spans: list[Span]) -> str:
    """kind:start:end by kind and start."""
    ordered = sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start, s.end))
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in ordered)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping ones, by the first's."""
    parts, done = [], 0
    for span in sorted(spans, key=lambda s: (s.start, -s.end)):
        if span.start >= done:
            parts += [text[done : span.start], f"[{span.kind.upper()}]"]
        done = max(done, span.end)
    return "".join([*parts, text[done:]])


SPAN_SCHEMA = "array<struct<kind: string, start: int, `end`: int, score: double>>"


def _find(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(7)]
    for text in batch.column("text").to_pylist():
        base, more = base_spans(text), further_spans(text)
        kinds = [s.kind for s in base]
        for column, kind in zip(columns, BASE_KINDS):
            column.append(kinds.count(kind))
        columns[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
        columns[5].append(joined(base + more))
        columns[6].append([s._asdict() for s in base + more])
    span = pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]
    )
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(span)]
    names = [f"n_{kind}" for kind in BASE_KINDS] + ["base_sha256", "spans", "found"]
    arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds)]
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], ["doc_id", *names])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans, all spans as text and as structs.

    One row per row of ``docs``, repeated rows included; a NULL or empty text has no spans,
    an empty table gives no rows, and other columns are not read.
    """
    rows = docs.select("doc_id", text_or_empty())
    counts = ", ".join(f"n_{kind} long" for kind in BASE_KINDS)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {counts}, base_sha256 string, spans string"
    return map_batches(rows, _find, f"{schema}, found {SPAN_SCHEMA}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind. A NULL text stays NULL.

    A column ``n_chars`` is set to the length of the new text.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [
            text if text is None else redacted(text, base_spans(text) + further_spans(text))
            for text in batch.column("text").to_pylist()
        ]
        place = batch.schema.get_field_index("text")
        return batch.set_column(place, batch.schema.field(place), pa.array(texts, pa.string()))

    changed = map_batches(docs, run, docs.schema)
    if "n_chars" not in docs.columns:
        return changed
    length = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return changed.withColumn("n_chars", length)
