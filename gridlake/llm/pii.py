"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, URL schemes and identifier cues
(bank account, passport, key words).  At each anchor a small parser expands left and right from there, validates
what it found (domain, octets, Luhn, digit count, IBAN checksum) and fixes the boundaries.  No pattern is searched for over the text.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are what a leftmost, non-overlapping search of their patterns
finds.  Two more kinds follow: ``account`` (IBANs and identifiers after a cue) and ``url`` (addresses with a user part).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from gridlake.llm.common import input_columns

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "url")
#: Words after which an identifier may follow.
CUES = ("iban", "ssn", "social security", "passport", "account", "acct", "api_key", "apikey", "secret", "token", "password")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
OCTETS = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])")
AFTER_CUE = re.compile(r"(?:\s?(?:number|no\.?|id|is))?[\s:=#\"']{1,4}")
IDENTIFIER = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]|[_.]+(?=[A-Za-z0-9])){4,}(?![A-Za-z0-9])")
USER_PART = re.compile(r"[^\s/?#@]+@[^\s/?#]+")
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in "@+0123456789":
        found.add_word(mark, mark if not mark.isdigit() else "0")
    found.add_word("://", "://")
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, "cue")
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _label_left(text: str, at: int, floor: int, allowed: frozenset) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def find(text: str | None, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order of their start, in code points with exclusive ends.  A null text has none."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return spans
    emails = ips = cards = phones = accounts = urls = 0  # where the next match of the kind may start
    for end, what in automaton.iter(text):
        if what == "0":
            if end >= ips:
                run = DIGITS.match(text, end).end()
                m = OCTETS.match(text, end) if text[run : run + 1] == "." else None
                ips = m.end() if m else run
                if m and all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m.groups()):
                    spans["ip"].append(m.span())
            if end >= cards:
                m = CARD.match(text, end)
                cards = m.end() if m else end + 1
                if m and 13 <= m.end() - end <= 37:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        spans["card"].append(m.span())
        elif what == "@":
            start = _label_left(text, end, emails, LOCAL)
            if start < end and (m := DOMAIN.match(text, end + 1)):
                spans["email"].append((start, m.end()))
                emails = m.end()
        elif what == "+":
            if end >= phones and (m := PHONE.match(text, end)):
                phones = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans["phone"].append(m.span())
        elif what == "cue":
            if end >= accounts and (lead := AFTER_CUE.match(text, end + 1)):
                start = lead.end()
                m = IBAN.match(text, start)
                if not m or not iban_valid(m[0].replace(" ", "")):
                    m = IDENTIFIER.match(text, start)
                    if not m or sum(c.isdigit() for c in m[0]) < 4:
                        continue
                spans["account"].append(m.span())
                accounts = m.end()
        elif end >= urls:
            start = _label_left(text, end - 2, urls, SCHEME)
            if start < end - 2 and (m := USER_PART.match(text, end + 1)):
                spans["url"].append((start, m.end()))
                urls = m.end()
    return spans


def listed(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def redact(text: str | None, spans: dict[str, list[tuple[int, int]]]) -> str | None:
    """The text with each found span replaced by its kind in brackets; spans that overlap are replaced as one."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """One row per row of ``docs``: counts of each kind, ``base_spans`` and ``spans`` as kind:start:end, and, if asked for, ``redacted``.

    A null text counts as empty: no spans, and ``redacted`` is null.  Repeated rows give repeated results.  Very long texts are searched whole.  An empty table
    gives an empty result; further columns of any name are ignored.
    """
    d = input_columns(docs, doc_id=id_col, text=text_col)
    id_type = d.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "spans", *["redacted"] * redacted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find(text, automaton)
                rows.append((*(len(spans[k]) for k in KINDS), listed(spans, BASE), listed(spans, KINDS), *([redact(text, spans)] if redacted else [])))
            cols = list(zip(*rows)) or [()] * (len(KINDS) + 2 + redacted)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[: len(KINDS)]), *(pa.array(c, pa.string()) for c in cols[len(KINDS) :])], names=names)

    return d.mapInArrow(run, f"doc_id {id_type}, {', '.join(f'n_{k} long' for k in KINDS)}, base_spans string, spans string{', redacted string' * redacted}")


def scrub(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced, and ``chars_col`` (if given) set to the new length.

    Null and empty texts stay as they are, rows that repeat stay, very long texts are searched whole.  An empty table stays empty, and columns of any name are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            new = [redact(t, find(t, automaton)) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            if chars_col:
                k = batch.schema.get_field_index(chars_col)
                batch = batch.set_column(k, batch.schema.field(k), pa.array([None if t is None else len(t) for t in new], batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
