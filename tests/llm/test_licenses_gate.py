"""Keywords gate rules without hiding a match: bare names without a cue, and phrases wrapped over lines."""

import pytest

from barelake.llm import licenses


@pytest.mark.parametrize(
    "text,labels",
    [
        ("This package is dual: mpl-2.0 or apache-2.0.", ["mpl-2.0", "apache-2.0"]),
        ("BSD-3-Clause", ["bsd-3-clause"]),
        ("Artistic-2.0", ["artistic-2.0"]),
        ("EPL-2.0", ["epl-2.0"]),
        ("Distributed under the GNU General\nPublic License version 3.", ["gpl-3.0"]),
        ("Permission is hereby\n  granted, free of charge, to any person obtaining a copy", ["mit"]),
        ("placed in the public domain", ["public-domain"]),
        ("Licensed under Creative\r\n\tCommons Attribution 4.0.", ["cc-by-4.0"]),
    ],
)
def test_matches_are_not_gated_away(text, labels):
    assert [d[0] for d in licenses.detect(text)] == labels


def test_gate_equals_all_rules(monkeypatch):
    """With and without the gate the same, on each kind of form around each name's keyword."""
    texts = ["gnu  general\n public license v2", "all\nrights reserved", "cc\tby 4.0 and cc-by-sa-3.0", "see the zlib license", "licensed under the gnu free\ndocumentation license 1.2", "released under the wtfpl or do what\nthe fuck you want to public license"]
    gated = [licenses.detect(t) for t in texts]

    class All:
        def iter(self, _):
            return [(0, range(len(licenses.rules())))]

    monkeypatch.setattr(licenses, "_automaton", All)
    assert [licenses.detect(t) for t in texts] == gated and all(gated)
