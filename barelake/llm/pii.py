"""Personal data by anchor expansion (operator 4).

An Aho-Corasick automaton finds anchors: at-signs, schemes, digits, plus signs
and cue words. A local parser for each kind expands an anchor to the left and
right and validates what it finds. All parsers look at a stretch once, so the
time is proportional to the text's length.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .spans import Span, digest, written

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account", "ssn", "address")
ORDER = {k: i for i, k in enumerate(BASE + ADDED)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[^\s<>\"'`|\\^{}\[\]]+")
_IBAN = re.compile(r"[\s:#.]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?:\s{0,2}(?:number|num|no|nr|n°|nummer)\b\.?)?\s{0,2}[:#=]?\s{0,2}([0-9](?:[ -]?[0-9]){5,17})(?![0-9])", re.I)
_SSN = re.compile(r"(?:\s{0,2}(?:number|no)\b\.?)?\s{0,2}[:#=]?\s{0,2}((?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4})(?![0-9-])", re.I)
_HOUSE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]? (?:[A-Z][\w'’-]{1,24} ){1,4}$")
_ROOM = 24 + 5 * 26

_WORDS = {
    "iban": ["iban"],
    "account": ["account", "acct", "konto", "compte", "cuenta"],
    "ssn": ["ssn", "social security"],
    "address": ["street", "avenue", "road", "boulevard", "lane", "drive", "court", "square"],
}


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, ("digit" if c.isdigit() else c, 1))
    a.add_word("://", ("scheme", 3))
    for kind, words in _WORDS.items():
        for w in words:
            for form in {w, w.upper(), w.capitalize(), w.title()}:
                if kind != "address" or form != w:  # street words count with a capital only
                    a.add_word(form, (kind, len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(p := part.lstrip("0")) < 3 or len(p) == 3 and p <= "255"


def _iban(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def find(text: str | None) -> list[Span]:
    """All spans of one text, in no special order. The base kinds equal their regular expressions' leftmost matches."""
    if not text:
        return []
    out: list[Span] = []
    email_end = chain_end = card_end = phone_end = url_end = 0
    for last, (kind, size) in _automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= chain_end:
                m = _CHAIN.match(text, at)
                chain_end = m.end()
                if "." in m[0]:
                    parts, start = m[0].split("."), at
                    for k in range(0, len(parts) - 3, 4):
                        end = start + sum(map(len, parts[k : k + 4])) + 3
                        if all(map(_small, parts[k : k + 4])):
                            out.append(("ip", start, end))
                        start = end + 1
            if at >= card_end:
                m = _CARD.match(text, at)
                card_end = m.end() if m else at + 1
                if m and len(m[0]) >= 12:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append(("card", at, m.end()))
        elif kind == "@":
            if at > email_end and (m := _DOMAIN.match(text, at + 1)):
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at:
                    email_end = m.end()
                    out.append(("email", start, email_end))
        elif kind == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                phone_end = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", at, phone_end))
        elif kind == "scheme":
            start = at
            while start > url_end and at - start < 16 and text[start - 1].isascii() and text[start - 1].isalpha():
                start -= 1
            m = _URL.match(text, last + 1)
            if start < at and m:
                end = last + 1 + len(m[0].rstrip(".,;:!?)*#$%&"))
                if end > last + 1:
                    url_end = end
                    out.append(("url", start, end))
        elif text[at - 1 : at].isalnum() or kind != "address" and text[last + 1 : last + 2].isalpha():
            continue
        elif kind == "address":
            if not text[last + 1 : last + 2].isalnum() and (m := _HOUSE.search(text, max(0, at - _ROOM), at)):
                out.append(("address", m.start(), last + 1))
        elif m := {"iban": _IBAN, "account": _ACCOUNT, "ssn": _SSN}[kind].match(text, last + 1):
            if kind != "iban" or _iban(m[1]):
                out.append((kind, m.start(1), m.end(1)))
    return out


def _replaced(text: str, spans: list[Span]) -> str:
    out, done = [], 0
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2], ORDER[s[0]])):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([kind, start, end])
    for kind, start, end in merged:
        out += [text[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, text[done:]])


def redact(text: str | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its kind in brackets.

    What a replacement lays bare (digits that ran on into an address before it,
    say) is replaced as well: the text is searched again until nothing is found.
    """
    while text and (spans := find(text)):
        text = _replaced(text, spans)
    return text


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row of docs.

    Null texts count as empty and have no spans; rows with null ids and
    repeated rows are kept; other columns are ignored. Offsets are code points,
    end exclusive.
    """
    arrow = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        found = [find(t) for t in batch.column(1).to_pylist()]
        base = [[s for s in spans if s[0] in BASE] for spans in found]
        return {"doc_id": batch.column(0), **{f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in BASE}, "base_sha256": [digest(b, ORDER) for b in base], "spans": [written(s, ORDER) for s in found]}

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema, arrow)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs with personal data in the text replaced by kinds in brackets, and the length column, if any, set anew.

    Texts pass through the workers in small batches: an Arrow batch would hold
    10,000 texts, several times over, on both sides.
    """
    clean = F.udf(redact, "string", useArrow=False)
    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
