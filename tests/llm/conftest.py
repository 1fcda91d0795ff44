"""Fixtures of hard rows: nulls, empty and long texts, ties, repeats and clashing columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hard(spark):
    words = "the quick brown fox jumps over the lazy dog and runs into an old forest by the river near a small town".split()
    long = " ".join(words[i * 7 % len(words)] + str(i % 13) for i in range(6000))
    rows = [
        (0, " ".join(words), "en", "a", 1),
        (1, " ".join(words), "en", "a", 1),
        (2, " ".join(words[:-1]) + " village", "en", "b", 1),
        (3, None, "en", None, None),
        (4, "", None, "a", 0),
        (5, long, "en", "a", len(long)),
        (6, "Über den Fluss und in die Wälder geht der alte Mann mit seinem Hund", "de", "b", 1),
        (7, "\U0001f600 été — naïve\ttext here ퟿", None, "c", 3),
        (None, " ".join(words), "en", None, 1),
        (None, None, None, None, None),
        (2, " ".join(words[:-1]) + " village", "en", "b", 1),
    ]
    return spark.createDataFrame([(*r, "clash", 7, 8) for r in rows], DOCS + ", fp string, copy int, shuffle_key int").cache()


@pytest.fixture(scope="session")
def none(hard):
    return hard.where("false")
