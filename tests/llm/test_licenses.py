import re

import pytest

from barelake.llm import licenses


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    out = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), sorted(out)


@pytest.mark.parametrize("text", [None, "", "CC BY 4.0, cc-by cc by", "cc  by\x7fcc\x00by", "All rights reserved. ALL RIGHTS\nRESERVED all rights all rights reserved", "the GNU General Public Licensed; general public license", "É cc by é5 é", "cc by " * 5000, "all rights_reserved"])
def test_phrases(text):
    assert licenses.phrases(text) == brute(text)


@pytest.mark.parametrize(
    "text,label",
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
        ("Released under the MIT License.", "mit"),
        ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0"),
        ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
        ("// SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
        ("covered by the Mozilla Public License, version 2.0", "mpl-2.0"),
        ("All rights\nreserved.", "all-rights-reserved"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ],
)
def test_rules(text, label):
    assert [d[0] for d in licenses.detect("Intro. " + text + " End.")] == [label]


def test_overlaps_and_prose():
    assert len(licenses.rules()) > 300
    assert [d[0] for d in licenses.detect("The Apache License 2.0, then license: MIT")] == ["apache-2.0", "mit"]
    assert licenses.detect("The committee met under the bridge by the river and permitted all of it.") == []
    assert licenses.detect("Public by right, he submitted by mit and boost.") == []
    assert licenses.detect("İ released under the MIT License")[0][0] == "mit"


def test_hard_rows(hard, none):
    got = licenses.scan(hard.withColumnRenamed("fp", "labels")).collect()
    assert len(got) == hard.count() and all(r["score"] == 0 and r["labels"] == "" and r["first_word"] is None for r in got)
    assert licenses.scan(none).collect() == []
    one = hard.limit(1).selectExpr("doc_id", "'x CC BY y all rights reserved' AS text")
    r = licenses.scan(one).first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (7, 2, 1, 4, "cc-by,reserved")
    assert set(r["labels"].split(",")) >= {"cc-by", "reserved"} and 0 < r["score"] <= 1
