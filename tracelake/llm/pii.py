"""Personal data by anchor expansion.

Method. One Aho-Corasick pass over the whole text finds anchors: at-signs, digits and plus signs, scheme marks and identifier
cues. A deterministic local parser grows each anchor to the span it belongs to and validates it (e-mail, IPv4 address, card
number with Luhn's check, phone number; beyond these a URL that carries credentials, and the value that follows an identifier
cue). Text without anchors costs the automaton's pass only.

Scale. Map only: no shuffle, no state between rows; a task's memory is one Arrow batch.

A null text is empty and has no span; the digest of no span is that of the empty string; repeated rows give repeated results;
extra columns are ignored; an empty table gives an empty result. Every parser is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: The words that announce an identifier.
CUES = ("password", "passwd", "token", "secret", "api_key", "apikey", "api-key", "access_key", "account", "iban", "ssn", "passport", "username", "user_id", "login")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ZONE = re.compile(r"[0-9+ ().-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_CREDENTIALS = re.compile(r"[^\s/?#@\"'<>]++@[^\s\"'<>]++")
_VALUE = re.compile(r"[\"']?\s{0,2}(?:=|:|#|\bno\.?|\bnumber)\s{0,2}[\"']?([A-Za-z0-9][A-Za-z0-9_./+-]{5,}+)")


def _automaton():
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (0, 1))
    a.add_word("://", (1, 3))
    for w in CUES:
        for v in {w, w.upper(), w.capitalize()}:
            a.add_word(v, (2, len(v)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def find_spans(text: str, automaton=None) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind: code points, end exclusive. Base kinds are each leftmost and don't overlap; the others overlap no base span."""
    automaton = automaton or _automaton()
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = zone_end = 0
    extra: list[tuple[str, int, int]] = []
    for end, (kind, n) in automaton.iter(text):
        at = end - n + 1
        if kind == 0 and text[at] == "@":
            s = at
            while s > mail_end and text[s - 1] in _LOCAL:
                s -= 1
            if s < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((s, m.end()))
                mail_end = m.end()
        elif kind == 0:
            if at >= zone_end:
                zone_end = _ZONE.match(text, at).end()
                for m in _IP.finditer(text, at, zone_end):
                    if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
                        found["ip"].append(m.span())
                for m in _CARD.finditer(text, at, zone_end):
                    if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                        found["card"].append(m.span())
                for m in _PHONE.finditer(text, at, zone_end):
                    if 8 <= len(_digits(m[0])) <= 15:
                        found["phone"].append(m.span())
        elif kind == 1:
            if (s := _SCHEME.search(text, max(0, at - 16), at)) and (m := _CREDENTIALS.match(text, end + 1)):
                extra.append(("url", s.start(), m.end()))
        elif not (at and text[at - 1].isalnum()) and (m := _VALUE.match(text, end + 1)) and any(c.isdigit() for c in m[1]):
            extra.append(("account", *m.span(1)))
    if extra:
        taken = sorted(x for k in BASE for x in found[k])
        starts, ends = [x[0] for x in taken], list(accumulate((x[1] for x in taken), max))  # ends: the last of those so far
        for kind, s, e in extra:
            before = bisect_left(starts, e)
            if not (before and s < ends[before - 1]) and not (found[kind] and s < found[kind][-1][1]):
                found[kind].append((s, e))
    return found


def joined(found: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def redacted(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind."""
    out, last = [], 0
    for s, e, k in sorted((s, e, KINDS.index(k)) for k in KINDS for s, e in found[k]):
        if s >= last:
            out += [text[last:s], f"<{KINDS[k].upper()}>"]
        last = max(last, e)
    return "".join(out) + text[last:]


SPANS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row: counts of base kinds, the digest of the base spans, and all spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        automaton = _automaton()
        names = [x.split()[0] for x in SPANS.split(", ")]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = find_spans(text or "", automaton)
                sha = hashlib.sha256(joined(f, BASE).encode()).hexdigest()
                for c, v in zip(out, (doc, *(len(f[k]) for k in BASE), sha, joined(f))):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, c in zip(names, out)], names)

    return docs.mapInArrow(tidy(run), SPANS)


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """The table with personal data in one column replaced by the names of their kinds; nulls stay null."""
    place = docs.columns.index(column)

    def run(batches):
        automaton = _automaton()
        for batch in batches:
            texts = [t if t is None else redacted(t, find_spans(t, automaton)) for t in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)
