"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm._shared import map_batches
from gristmill.llm._tokens import texts_of

#: The kinds in the order of the output. The first four are found by pattern and validator alone, whatever their score.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE_KINDS = KINDS[:4]

# Patterns of the kinds.
# A local part is the run of its characters before an @; going by the @ keeps long texts without one linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
# Keys whose form says so, and long hexadecimal values, which need a word nearby.
_KEY = r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{32,64}"
_SECRET = re.compile(rf"(?<![A-Za-z0-9_])(?:{_KEY}|[A-Fa-f0-9]{{32,128}})(?![A-Za-z0-9_])")

# The score a confirmed span starts with, and the words near it that raise or lower it.
_START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.4}
_RAISE = {
    "email": ("mail", "contact", "write", "courriel", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "key", "password", "passwd", "credential", "api"),
}
_LOWER = ("example", "sample", "version", "isbn", "serial", "order", "invoice", "test")
WINDOW, STEP, LEAST, _FORMED = 40, 0.2, 0.5, 0.8
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        for d in str(int(c, 36)):
            rest = (rest * 10 + int(d)) % 97
    return rest == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, (done := found.end())
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans, by kind and start."""
    for start, end in emails(text):
        yield "email", start, end
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield "phone", *m.span()
    for m in _IBAN.finditer(text):
        if 15 <= len(code := m[0].replace(" ", "")) <= 34 and mod97(code):
            yield "iban", *m.span()
    for m in _SSN.finditer(text):
        yield "ssn", *m.span()
    for m in _SECRET.finditer(text):
        if is_mixed(m[0]):
            yield "secret", *m.span()


def is_mixed(value: str) -> bool:
    """Whether a value looks drawn at random: digits and letters, eight different characters at least."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= 8


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW])}
    begin = _FORMED if kind == "secret" and re.match(_KEY, text[start:end]) else _START[kind]
    score = begin + STEP * any(w in near for w in _RAISE[kind]) - STEP * any(w in near for w in _LOWER)
    return round(min(1.0, max(0.0, score)), 2)


def find_spans(text: str | None) -> list[Span]:
    """All personal data of one whole text (null: none), by kind and start, in code points.

    Base kinds are kept at any score; the kinds beyond them need a score of ``LEAST``.
    """
    if not text:
        return []
    spans = (Span(*found, _score(text, *found)) for found in _proposed(text))
    return [s for s in spans if s.kind in BASE_KINDS or s.score >= LEAST]


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first one in brackets."""
    out, at = [], 0
    ordered = sorted(spans, key=lambda s: (s.start, -s.end))
    for s in ordered:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def _suspects(column: pa.Array) -> Iterator[tuple[int, str]]:
    """Rows with an @ or a digit, without which no kind is confirmed, and their texts."""
    hint = np.zeros(256, dtype=bool)
    hint[[ord("@"), *range(48, 58)]] = True
    for t in texts_of(column):
        if len(t.data):
            total = np.concatenate(([0], np.cumsum(hint[t.data])))
            for i in np.flatnonzero(total[t.offsets[1:]] > total[t.offsets[:-1]]):
                yield t.first + int(i), t.data[t.offsets[i] : t.offsets[i + 1]].tobytes().decode("utf-8", "replace")


SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found`` for every input row: the spans of its whole text with their scores.

    Null and empty texts have no spans; texts may be of any length. Spans of different kinds may overlap. Repeated rows are rows
    of their own. Other columns are not read; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[]] * batch.num_rows
            for i, text in _suspects(batch.column(1)):
                found[i] = [s._asdict() for s in find_spans(text)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=_ARROW_SPANS)], names=["doc_id", "found"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, f"doc_id long, found {SPANS}")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with personal data masked in ``text_col``; all other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            changed = {i: masked(text, spans) for i, text in _suspects(batch.column(at)) if (spans := find_spans(text))}
            if changed:
                new = pa.array([changed.get(i) for i in range(batch.num_rows)], type=batch.schema.types[at])
                batch = batch.set_column(at, batch.schema.names[at], pc.coalesce(new, batch.column(at)))
            yield batch

    return map_batches(docs, run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans and their scores as text, from ``detect``'s rows."""

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), F.array_join(F.transform("found", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"))
