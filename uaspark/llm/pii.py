"""Personal data: patterns propose spans, checksums confirm them, words nearby
adjust the score.

Base kinds (always reported when pattern and check agree): ``email``, ``ip``
(parts at most 255), ``card`` (16 to 19 digits, Luhn), ``phone`` (8 to 15
digits after a plus sign).  Within a kind, matches are leftmost and don't
overlap; a match that fails its check is dropped and its text not tried again.
Kinds that the method adds: ``iban`` (ISO 13616 form, mod-97), ``card_short``
(13 to 15 digits, Luhn) and ``ssn`` (3-2-4 digits).  Added spans count when
their score, a prior per kind plus or minus words in the 40 code points on
either side, reaches ``threshold``; base spans carry a score but always stay.

Scanning is linear in the text: no pattern is tried from the middle of a run
that it failed from the start of.

Defined results: null and empty texts have no spans; spans are in code points, end
exclusive; texts may have any length.  Every row is judged on its own, repeated rows
and ids too; an empty table gives an empty result.  Extra columns pass through; one
that bears the name of a result is renamed (``columns.set_apart``).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import (ArrayType, DoubleType, IntegerType, LongType, StringType, StructField,
                               StructType)

from .columns import fresh, renamed, set_apart
from .texts import pieces

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_short", "ssn")

#: Fixed values of the method: what a kind scores by itself, and the words that move it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.8, "iban": 0.9, "card_short": 0.4, "ssn": 0.3}
SUPPORT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "card_short": ("card", "amex", "credit", "debit", "carte", "karte", "tarjeta"),
    "ssn": ("ssn", "social", "security"),
}
AGAINST = ("version", "isbn", "order", "invoice", "serial", "example")
WINDOW = 40
STEP = 0.3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"\w+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: country and check digits moved to the end, letters as 10..35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", max(at + 1, done))


def _at_most_255(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def propose(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, kind by kind; added kinds before any look at the context."""
    for start, end in _emails(text):
        yield "email", start, end
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_at_most_255, m[0].split("."))):
                yield "ip", *m.span()
    short = []
    for m in _CARD.finditer(text):
        own = m.end() - m.start()
        if own < 13:
            continue
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            if len(digits) >= 16:
                yield "card", *m.span()
            else:
                short.append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", *m.span()
    for span in short:
        yield "card_short", *span
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW]
    words = set(_WORD.findall(near.lower()))
    out = PRIOR[kind] + STEP * any(w in words for w in SUPPORT[kind]) - STEP * any(w in words for w in AGAINST)
    return min(1.0, max(0.0, out))


def find(text: str, threshold: float = 0.5) -> list[Span]:
    """Spans of one text: base kinds in order, then added kinds, each by start."""
    out = []
    for kind, start, end in propose(text):
        s = score(text, kind, start, end)
        if kind in BASE or s >= threshold:
            out.append(Span(kind, start, end, s))
    return out


SPAN = StructType([StructField("kind", StringType()), StructField("start", IntegerType()),
                   StructField("end", IntegerType()), StructField("score", DoubleType())])
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                   ("score", pa.float64())]))


def find_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` plus ``pii`` array<struct<kind, start, end, score>>."""
    docs, text_col = renamed(docs, text_col, "pii")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            spans = [[s._asdict() for s in find(t or "", threshold)] for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _ARROW_SPANS)],
                                             [*batch.schema.names, "pii"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("pii", ArrayType(SPAN))]))


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span replaced by ``[KIND]`` (overlaps: the first span wins)."""
    def clean(text: str) -> str:
        out, at = [], 0
        for s in sorted(find(text, threshold), key=lambda s: (s.start, -s.end)):
            if s.start >= at:
                out += [text[at:s.start], f"[{s.kind.upper()}]"]
                at = s.end
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col):
            texts = [None if t is None else clean(t) for t in batch.column(text_col).to_pylist()]
            i = batch.schema.names.index(text_col)
            yield batch.set_column(i, batch.schema.field(i), pa.array(texts, batch.schema.field(i).type))

    return docs.mapInArrow(run, docs.schema)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


REPORT = [StructField(f"n_{k}", LongType()) for k in BASE] + [
    StructField("base_sha256", StringType()), StructField("spans", StringType())]


def report(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Every column of ``docs`` but the text, the count of each base kind,
    ``base_sha256`` over the base spans and ``spans``, all spans as text."""
    results = [f.name for f in REPORT]
    own = fresh([*docs.columns, *results], "_text")
    docs = set_apart(docs.withColumnRenamed(text_col, own), *results)
    rest = [f for f in docs.schema.fields if f.name != own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, own):
            found = [find(t or "", threshold) for t in batch.column(own).to_pylist()]
            base = [[s for s in row if s.kind in BASE] for row in found]
            counts = [pa.array([sum(s.kind == k for s in row) for row in base], pa.int64()) for k in BASE]
            digests = [hashlib.sha256(joined(row).encode()).hexdigest() for row in base]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f.name) for f in rest), *counts, pa.array(digests, pa.string()),
                 pa.array([joined(row) for row in found], pa.string())],
                [*(f.name for f in rest), *results])

    return docs.mapInArrow(run, StructType([*rest, *REPORT]))
