"""Licence statements by ordered signature rules (operator 8).

A rule is a regular expression with a label, a priority and a score. Rules are
made from the licences' names and the forms of a statement. One Aho-Corasick
pass over the lower-cased text finds keywords; only rules with a keyword in the
text are tried. Detections are taken by priority, then length, then place; one
that overlaps a detection taken before it is dropped.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Label, pattern of the name (spaces stand for white space), keyword that each match holds.
_NAMES = [
    ("mit", r"mit|x11|expat", ("mit", "x11", "expat")),
    ("isc", r"isc", ("isc",)),
    ("bsd-2-clause", r"(?:bsd[- ]2[- ]clause|2[- ]clause bsd|simplified bsd|freebsd)", ("bsd",)),
    ("bsd-3-clause", r"(?:bsd[- ]3[- ]clause|3[- ]clause bsd|new bsd|modified bsd|revised bsd)", ("bsd",)),
    ("bsd-4-clause", r"(?:bsd[- ]4[- ]clause|4[- ]clause bsd|original bsd)", ("bsd",)),
    ("0bsd", r"(?:0bsd|zero[- ]clause bsd)", ("bsd",)),
    ("bsd", r"bsd", ("bsd",)),
    ("apache-1.1", r"apache(?: software)?(?: license)?,?(?: version| v)?[- ]?1\.1", ("apache",)),
    ("apache-2.0", r"apache(?: software)?(?: license)?,?(?: version| v)?[- ]?2(?:\.0)?", ("apache",)),
    ("apache", r"apache", ("apache",)),
    ("gpl-2.0", r"(?:gnu )?(?:general public license|gpl),?(?: version| v)?[- ]?v?2(?:\.0)?(?:[- ](?:only|or[- ]later))?", ("general public", "gpl")),
    ("gpl-3.0", r"(?:gnu )?(?:general public license|gpl),?(?: version| v)?[- ]?v?3(?:\.0)?(?:[- ](?:only|or[- ]later))?", ("general public", "gpl")),
    ("gpl", r"(?:gnu )?(?:general public license|gpl)", ("general public", "gpl")),
    ("lgpl-2.1", r"(?:gnu )?(?:lesser general public license|library general public license|lgpl),?(?: version| v)?[- ]?v?2(?:\.[01])?(?:[- ](?:only|or[- ]later))?", ("general public", "lgpl")),
    ("lgpl-3.0", r"(?:gnu )?(?:lesser general public license|lgpl),?(?: version| v)?[- ]?v?3(?:\.0)?(?:[- ](?:only|or[- ]later))?", ("general public", "lgpl")),
    ("lgpl", r"(?:gnu )?(?:lesser general public license|lgpl)", ("general public", "lgpl")),
    ("agpl-3.0", r"(?:gnu )?(?:affero general public license|agpl),?(?: version| v)?[- ]?v?3(?:\.0)?(?:[- ](?:only|or[- ]later))?", ("affero", "agpl")),
    ("agpl", r"(?:gnu )?(?:affero general public license|agpl)", ("affero", "agpl")),
    ("gfdl", r"(?:gnu )?(?:free documentation license|gfdl)(?:,?(?: version| v)? ?1\.[123])?", ("free documentation", "gfdl")),
    ("mpl-1.1", r"(?:mozilla public license|mpl),?(?: version| v)?[- ]?1\.[01]", ("mozilla", "mpl")),
    ("mpl-2.0", r"(?:mozilla public license|mpl),?(?: version| v)?[- ]?2(?:\.0)?", ("mozilla", "mpl")),
    ("mpl", r"(?:mozilla public license|mpl)", ("mozilla", "mpl")),
    ("epl-1.0", r"(?:eclipse public license|epl),?(?: version| v| -)?[- ]?1(?:\.0)?", ("eclipse", "epl")),
    ("epl-2.0", r"(?:eclipse public license|epl),?(?: version| v| -)?[- ]?2(?:\.0)?", ("eclipse", "epl")),
    ("cddl-1.0", r"(?:common development and distribution license|cddl)(?:,?(?: version| v)?[- ]?1\.[01])?", ("common development", "cddl")),
    ("artistic-2.0", r"artistic(?: license)?,?(?: version| v)?[- ]?2(?:\.0)?", ("artistic",)),
    ("artistic", r"artistic", ("artistic",)),
    ("boost-1.0", r"(?:boost(?: software)?(?: license)?(?:,?(?: version| v)?[- ]?1\.0)?|bsl-1\.0)", ("boost", "bsl-")),
    ("zlib", r"zlib(?:/libpng)?", ("zlib",)),
    ("unlicense", r"unlicense", ("unlicense",)),
    ("wtfpl", r"(?:wtfpl|do what the f\w* you want to public license)", ("wtfpl", "do what the")),
    ("eupl-1.2", r"(?:european union public licence|eupl),?(?: version| v)?[- ]?1\.[12]", ("european union", "eupl")),
    ("ofl-1.1", r"(?:sil open font license|open font license|ofl)(?:,?(?: version| v)?[- ]?1\.[01])?", ("open font", "ofl")),
    ("ms-pl", r"(?:microsoft public license|ms-pl)", ("microsoft", "ms-pl")),
    ("cecill", r"cecill(?:-[bc])?(?:[- ]?[0-9.]+)?", ("cecill",)),
    ("postgresql", r"postgresql", ("postgresql",)),
    ("python-2.0", r"(?:python software foundation|psf)", ("python", "psf")),
    ("odbl", r"(?:open database license|odbl)", ("open database", "odbl")),
    ("cc0-1.0", r"(?:cc0|creative commons zero)(?:[- ]?1\.0)?", ("cc0", "creative commons")),
    ("elastic-2.0", r"elastic(?: license)?(?:[- ]?2\.0)?", ("elastic",)),
    ("sspl-1.0", r"(?:server side public license|sspl)(?:,?(?: version| v)?[- ]?1)?", ("server side", "sspl")),
    ("busl-1.1", r"(?:business source license|busl)(?:[- ]?1\.1)?", ("business source", "busl")),
]
_CC = [("by", "attribution"), ("by-sa", "attribution[- ]share[- ]?alike"), ("by-nd", "attribution[- ]no[- ]?deriv(?:ative)?s?(?: works)?"), ("by-nc", "attribution[- ]non[- ]?commercial"), ("by-nc-sa", "attribution[- ]non[- ]?commercial[- ]share[- ]?alike"), ("by-nc-nd", "attribution[- ]non[- ]?commercial[- ]no[- ]?deriv(?:ative)?s?(?: works)?")]
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
#: Forms of a statement: pattern around the name N, priority, score.
_FORMS = [
    (r"spdx-license-identifier: ?(?:[\w.+() -]{0,60}? )?N(?![\w.])", 90, 1.0),
    (r"(?:licensed|released|distributed|available|published|provided|covered|redistributed?|made available|use of this \w+ is governed) (?:\w+ ){0,3}?(?:under|by|with|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?N(?![\w.]?\w)(?: (?:public )?licen[sc]e)?", 80, 0.95),
    (r"licen[sc]e ?[:=] ?\"?N(?![\w.]?\w)(?: licen[sc]e)?", 75, 0.9),
    (r"(?:see|under|the|subject to) N licen[sc]e(?: for| agreement| text)?", 60, 0.8),
    (r"\bN licen[sc]e", 50, 0.7),
]
_OTHERS = [
    ("all-rights-reserved", r"all rights (?:are )?reserved", 40, 0.8, ("all rights",)),
    ("proprietary", r"(?:proprietary and confidential|confidential and proprietary|unauthori[sz]ed copying of this)", 70, 0.9, ("proprietary", "unauthori")),
    ("public-domain", r"(?:released|dedicated|placed|is) (?:in|in to|into|to) the public domain", 70, 0.9, ("public domain",)),
    ("copyright", r"(?:copyright|©|\(c\)) (?:\(c\) |© )?(?:19|20)[0-9]{2}", 20, 0.5, ("copyright", "©", "(c)")),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", 85, 1.0, ("hereby granted",)),
    ("isc", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose with or without fee", 85, 1.0, ("with or without fee",)),
    ("bsd", r"redistribution and use in source and binary forms, with or without modification", 85, 1.0, ("binary forms",)),
    ("unlicense", r"this is free and unencumbered software released into the public domain", 95, 1.0, ("unencumbered",)),
    ("gpl", r"you can redistribute it and/or modify it under the terms of the gnu general public license", 85, 1.0, ("general public",)),
    ("zlib", r"this software is provided '?as-is'?, without any express or implied warranty", 85, 1.0, ("as-is",)),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document", 60, 0.8, ("verbatim",)),
    ("cc-by", r"\bcc[- ]by\b(?:[- ]?[1-4]\.[05])?", 45, 0.8, ("cc by", "cc-by")),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    priority: int
    score: float
    keywords: tuple[str, ...]


def _compiled(source: str) -> re.Pattern:
    """A space outside brackets stands for any run of white space."""
    return re.compile("".join(part if part.startswith("[") else part.replace(" ?", r"\s*").replace(" ", r"\s+") for part in re.split(r"(\[[^\]]*\])", source)))


@functools.cache
def rules() -> tuple[Rule, ...]:
    """All rules, in the order of their priority."""
    out = []
    names = list(_NAMES)
    for short, long in _CC:
        tail = short.replace("-", "[- ]")
        for v in _CC_VERSIONS:
            names.append((f"cc-{short}-{v}", rf"(?:(?:cc|creative commons)[- ]{tail}|creative commons {long}),?(?: international| unported| version)?[- ]{v.replace('.', '[.]')}", ("cc by", "cc-by", "creative commons")))
        names.append((f"cc-{short}", rf"(?:(?:cc|creative commons)[- ]{tail}(?![- ](?:nc|nd|sa)\b)|creative commons {long})", ("cc by", "cc-by", "creative commons")))
    for label, name, keys in names:
        finer = 1 if re.search(r"[0-9]", label) else 0
        for form, priority, score in _FORMS:
            out.append(Rule(label, _compiled(form.replace("N", f"(?:{name})")), 10 * priority + 5 * finer, score, keys))
        if finer:
            out.append(Rule(label, _compiled(rf"(?<!\w)(?:{name})(?![\w.]?\w)"), 650, 0.7, keys))
    out += [Rule(label, _compiled(p), 10 * priority, score, keys) for label, p, priority, score, keys in _OTHERS]
    return tuple(sorted(out, key=lambda r: -r.priority))


@functools.cache
def _automaton():
    import ahocorasick

    by_key: dict[str, list[int]] = {}
    for i, r in enumerate(rules()):
        for k in r.keywords:
            by_key.setdefault(k, []).append(i)
    a = ahocorasick.Automaton()
    for k, which in by_key.items():
        a.add_word(k, tuple(which))
    a.make_automaton()
    return a


#: Names that are words of prose too; they count alone only where one of _CUES is in the text.
_PROSE = ("boost", "elastic")
_CUES = ("licen", "copyright", "rights", "public domain", "cc by", "cc-by", "spdx", "proprietary", "unauthori", "©", "(c)", "hereby granted", "without fee", "binary forms", "as-is", "released", "distribut", "available", "published", "provided", "covered", "governed", "verbatim", "gnu ")


def _collapsed(low: str) -> str:
    """The text that keywords are sought in: each run of white space is one space, as patterns take it."""
    return low if low.isascii() and "  " not in low and not any(c in low for c in "\t\n\r\f\v\x1c\x1d\x1e\x1f") else re.sub(r"\s+", " ", low)


def detect(text: str | None) -> list[tuple[str, int, int, float]]:
    """(label, start, end, score) of the detections that stand, by place."""
    if not text:
        return []
    low = "".join(c if len(x := c.lower()) != 1 else x for c in text) if not text.isascii() and len(text.lower()) != len(text) else text.lower()
    flat = _collapsed(low)
    gated = sorted({i for _, which in _automaton().iter(flat) for i in which})
    found = []
    for i in gated:
        r = rules()[i]
        found += [(-r.priority, m.start() - m.end(), m.start(), m.end(), r) for m in r.pattern.finditer(low)]
    if any(low[a:b] in _PROSE for _, _, a, b, _ in found) and not any(w in flat for w in _CUES):
        found = [f for f in found if low[f[2] : f[3]] not in _PROSE]
    taken: list[tuple[int, int, Rule]] = []
    for _, _, a, b, r in sorted(found, key=lambda f: f[:4]):
        if all(b <= x or a >= y for x, y, _ in taken):
            taken.append((a, b, r))
    return [(r.label, a, b, r.score) for a, b, r in sorted(taken, key=lambda t: t[:2])]


_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def phrases(text: str | None) -> tuple[int, list[tuple[int, str]]]:
    """The number of words, and (first word, label) of each place of a phrase."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    flat, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        need, at = b" " + phrase.encode() + b" ", -1
        seen = word = 0
        while (at := flat.find(need, at + 1)) >= 0:
            word += flat.count(b" ", seen, at)
            seen = at
            out.append((word, label))
    return len(words), sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), one for each row of docs.

    The base columns count the places of PHRASES among the text's words;
    labels adds those of the rules, whose detections ``spans`` lists as
    label:start:end. score is the best rule's, 0.6 where only a phrase stands,
    else 0. Null texts count as empty; rows with null ids and repeated rows are
    kept; other columns are ignored.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {f.name: [] for f in arrow}
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, base = phrases(text)
            found = detect(text)
            labels = {label for _, label in base}
            row = (doc, n, len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(labels)), ",".join(sorted(labels | {f[0] for f in found})), max([f[3] for f in found], default=0.6 if base else 0.0), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in found))
            for column, v in zip(out.values(), row):
                column.append(v)
        return out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string"
    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema, arrow)
