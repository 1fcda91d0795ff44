"""Catalyst expressions against plain Python."""

import random
import string

import pytest
from pyspark.sql import functions as F

from barelake.functions.fuzzy import approx_equal, indel
from barelake.functions.tags import column_tags, value_tag
from barelake.functions.text import all_qgrams, joined, keyword_tokens, qgrams, query_words
from barelake.sources.rows import format_cells, parse_cells, parse_literal


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else min(row[j], new[-1]) + 1)
        row = new
    return row[-1]


def near(a, b, t):
    if t == 0 or len(a) * t < 1 or len(b) * t < 1:
        return a == b
    return distance(a, b) / (len(a) + len(b)) < t


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(6)
    rows = [("", ""), ("", "a"), ("a", ""), ("abc", "abc"), ("é😀x", "é😀y"), ("0123456789", "0123456789"), ("0123456789", "012345678x"), ("a" * 20, "a" * 18)]
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 24)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b.insert(rng.randint(0, len(b)), rng.choice("abcé")) if rng.random() < 0.5 or not b else b.pop(rng.randrange(len(b)))
        rows.append((a, "".join(b)))
    return rows, spark.createDataFrame(rows, "a string, b string")


def test_indel(pairs):
    rows, df = pairs
    got = df.select("a", "b", indel(F.col("a"), F.col("b")).alias("d"), F.levenshtein("a", "b").alias("l")).collect()
    assert all(r["d"] == distance(r["a"], r["b"]) and r["l"] <= r["d"] for r in got)


@pytest.mark.parametrize("t", [0, 0.05, 0.1, 0.3, 0.5, 1.0])
def test_approximate_equality(pairs, t):
    rows, df = pairs
    got = df.select("a", "b", approx_equal(F.col("a"), F.col("b"), t).alias("m")).collect()
    assert [(r["a"], r["b"], r["m"]) for r in got] == [(a, b, near(a, b, t)) for a, b in rows]


def test_tokens_and_grams(spark):
    values = ["", "a", "Hello, World!  x", "ab" * 5, "é-é é", string.punctuation]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    drop = str.maketrans("", "", string.punctuation)
    for r in df.select("v", keyword_tokens(F.col("v")).alias("t"), qgrams(F.col("v"), 3).alias("q"), all_qgrams(F.col("v"), 4).alias("a")).collect():
        v = r["v"]
        assert r["t"] == [w.translate(drop) for w in v.lower().split(" ")]
        assert set(r["q"]) == {v[i : i + 3] for i in range(len(v) - 2)} and len(r["q"]) == len(set(r["q"]))
        assert set(r["a"]) == {v[i : i + q] for q in range(1, 5) for i in range(len(v) - q + 1)}
    assert query_words(" New-York! ") == ["newyork"]


def test_joined(spark):
    df = spark.createDataFrame([("", "", "x"), ("a", "", "b"), ("", "b", "c")], "a string, b string, c string")
    assert [r[0] for r in df.select(joined([F.col(c) for c in "abc"])).collect()] == ["x", "a╍╍b", "b╍c"]


@pytest.mark.parametrize("value,tag", [("", None), ("12", "numeric"), (" 1e5 ", "numeric"), ("nan", "numeric"), ("1_000", "numeric"), ("Jan 5, 2020", "date"), ("2020-01-05", "date"), ("red apple", "text"), ("x", "text"), (None, None)])
def test_value_tag(value, tag):
    assert value_tag(value) == tag


def test_column_tags(spark):
    cells = spark.createDataFrame([(0, i, v) for i, v in enumerate(["1", "x", "y", "2", ""])] + [(1, 0, ""), (2, 0, "2020-01-05")], "c int, row_id int, value string")
    assert {r["c"]: r["tag"] for r in column_tags(cells, ["c"]).collect()} == {0: "numeric", 1: None, 2: "date"}


@pytest.mark.parametrize(
    "line,cells",
    [
        ("a,b", ["a", "b"]),
        ('"a, b", \'c\' ,  d ', ["a, b", "c", "d"]),
        ('"O\'Brien, John","x"', ["O'Brien, John", "x"]),
        ("", [""]),
        ("a,,", ["a", "", ""]),
        ('"", "x"', ["", "x"]),
    ],
)
def test_rows(spark, line, cells):
    df = spark.createDataFrame([(line,)], "l string")
    assert df.select(parse_cells(F.col("l"))).first()[0] == cells


def test_rows_round_trip(spark):
    rows = [["a", "b, c", ""], ['say "x"', "y"], ["é", " "]]
    df = spark.createDataFrame([(r,) for r in rows[:2]], "c array<string>")
    assert [r[0] for r in df.select(parse_cells(format_cells(F.col("c")))).collect()] == rows[:2]


def test_literals():
    assert parse_literal("((John, 21), (Mary, 22))") == [("John", "21"), ("Mary", "22")]
    assert parse_literal("((a,b),(c,d))") == [("a", "b"), ("c", "d")]
    assert parse_literal("(a, '')") == [("a", "")]
    assert parse_literal('(("Doe, John", "21"), (\'Jane, Mary\', \'22\'), (Jeff, 20))') == [("Doe, John", "21"), ("Jane, Mary", "22"), ("Jeff", "20")]
    for bad in ("((a, b)", "(, b)", "()", "((a))) "):
        with pytest.raises(ValueError):
            parse_literal(bad)
