"""Personal data by anchor expansion: one Aho-Corasick pass finds at-signs, digits, plus signs, schemes and cues; local
parsers expand each anchor to its boundaries and validate. Every parser is linear in what it reads.

The base kinds (email, ip, card, phone) equal the leftmost non-overlapping matches of their patterns. Further kinds:
url (with user information, or mailto: and tel:, an anchor within an earlier one's span being part of it), iban (after
its cue, by its check digits), ssn (after its cue), key (the form of an access key id), secret (a value with a digit
that a cue such as token or password is set to).

Defined cases: a null text counts as empty: no spans, the hash of nothing; repeated rows and null doc_ids give a row
each; long texts are read whole; further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table, released, whole_text

KINDS = ("email", "ip", "card", "phone", "url", "iban", "ssn", "key", "secret")
BASE = KINDS[:4]
CUES = {"IBAN": "iban", "iban": "iban", "Iban": "iban", "SSN": "ssn", "ssn": "ssn", "Social Security": "ssn", "social security": "ssn", "AKIA": "key", "ASIA": "key"}
CUES |= {form(w): "secret" for w in ("token", "password", "passwd", "secret", "api_key", "api-key", "apikey", "access_key") for form in (str.lower, str.upper, str.capitalize)}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
USER_URL = re.compile(r"://[^\s/@:]+:[^\s/@]+@[^\s/]+")
IN_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
AFTER_MAILTO = re.compile(r"[^\s<>\"']+")
IBAN = re.compile(r"\W{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
KEY = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
SECRET = re.compile(r"[\"']?\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9_./+=-]{8,})")
SSN = re.compile(r"\D{0,12}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9])")


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in {"@": "@", "+": "+", "://": "://", "mailto:": "to", "tel:": "to", **dict.fromkeys("0123456789", "0"), **CUES}.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def spans_of(text: str, found: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(kind's place in KINDS, start, end) by start, then kind."""
    out: list[tuple[int, int, int]] = []
    mail_end = ip_end = card_end = phone_end = to_end = secret_end = 0
    for last, (kind, size) in found.iter(text):
        at = last + 1 - size
        if kind == "0":
            if at >= ip_end:
                chain = DOTTED.match(text, at)
                ip_end = chain.end()
                parts, start = chain[0].split("."), at
                for i in range(0, len(parts) - 3, 4):
                    end = start + sum(map(len, parts[i : i + 4])) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                        out.append((start, 1, end))
                    start = end + 1
            if at >= card_end:
                chain = CHAIN.match(text, at)
                card_end = chain.end() if chain else at + 1
                if chain and card_end - at <= 40:
                    digits = chain[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, card_end))
        elif kind == "@":
            start = at
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (domain := DOMAIN.match(text, at + 1)):
                mail_end = domain.end()
                out.append((start, 0, mail_end))
        elif kind == "+":
            if at >= phone_end and (m := PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    out.append((at, 3, phone_end))
        elif kind == "://":
            if m := USER_URL.match(text, at):
                start = at
                while start and text[start - 1] in IN_SCHEME:  # no scheme holds this anchor, so none is read twice
                    start -= 1
                while start < at and not text[start].isalpha():
                    start += 1
                if start < at:
                    out.append((start, 4, m.end()))
        elif kind == "to":
            if at >= to_end and (m := AFTER_MAILTO.match(text, last + 1)):
                to_end = m.end()
                out.append((at, 4, to_end))
        elif kind == "key":
            if (not at or not text[at - 1].isalnum()) and (m := KEY.match(text, last + 1)):
                out.append((at, 7, m.end()))
        elif kind == "secret":
            if at >= secret_end and (m := SECRET.match(text, last + 1)):
                secret_end = m.end(1)  # a value that is refused isn't read again either
                if any(map(str.isdigit, m[1])):
                    out.append((m.start(1), 8, secret_end))
        elif kind == "iban":
            if m := IBAN.match(text, last + 1):
                number = m[1]
                while " " in number and not iban_ok(number.replace(" ", "")):
                    number = number.rpartition(" ")[0]  # a word in capitals may follow
                if len(number.replace(" ", "")) >= 15 and iban_ok(number.replace(" ", "")):
                    out.append((m.start(1), 5, m.start(1) + len(number)))
        elif m := SSN.match(text, last + 1):
            out.append((m.start(1), 6, m.end(1)))
    return sorted(set(out))


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end_), every kind, by start; positions count code points, end exclusive."""
    row = "struct<kind: string, start: int, end_: int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = anchors()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end_", pa.int32())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end_": b} for a, k, b in spans_of(t.as_py(), found)] for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(released(run), f"doc_id long, spans array<{row}>")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (text)."""

    def named(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, s.start, s.end_)), ',')"

    base = "filter(spans, s -> s.kind IN ('email', 'ip', 'card', 'phone'))"
    counts = [f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS LONG) AS n_{k}" for k in BASE]
    return found.selectExpr("doc_id", *counts, f"sha2({named(base)}, 256) AS base_sha256", f"{named('spans')} AS spans")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(find_spans(read_table(spark, sf_dir, "documents")))


def base_sha256(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
