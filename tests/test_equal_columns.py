"""Columns that hold the same are compared once, and grouped and paired as if each were compared."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from barelake.operators.columns import group_columns, overlaps

COLUMNS, ENTRIES = "col long, score double", "col long, row_id long, value string"


def made(seed, n):
    rng = random.Random(seed)
    kinds = [{r: rng.choice(["1", "2", "x"]) for r in range(4) if rng.random() < 0.7} for _ in range(8)]
    return [dict(rng.choice(kinds)) for _ in range(n)]


def shared(a, b):
    rows = [r for r in a if r in b]
    same = sum(a[r] == b[r] for r in rows)
    return same / len(rows) if same else 0


def tag(column):
    tags = ["text" if column[r] == "x" else "numeric" for r in sorted(column)]
    return max(tags, key=lambda t: (tags.count(t), -tags.index(t)), default=None)


@pytest.mark.parametrize("seed,threshold", [(1, 0.5), (2, 0.7), (3, 1.0), (4, 1.5)])
def test_as_if_each_were_compared(spark, seed, threshold):
    data = made(seed, 30)
    columns = spark.createDataFrame([(k, 0.5) for k in range(30)], COLUMNS)
    entries = spark.createDataFrame([(k, r, v) for k, c in enumerate(data) for r, v in c.items()], ENTRIES)
    pairs = {(a, b): shared(data[a], data[b]) for a, b in itertools.combinations(range(30), 2)}
    got = [(r["a"], r["b"], r["overlap"]) for r in overlaps(entries).collect()]
    assert sorted(got) == sorted((a, b, o) for (a, b), o in pairs.items() if o)
    group = list(range(30))
    for _ in range(30):
        for (a, b), o in pairs.items():
            if o and o >= threshold and tag(data[a]) == tag(data[b]):
                group[a] = group[b] = min(group[a], group[b])
    assert {r["col"]: r["group"] for r in group_columns(columns, entries, threshold).collect()} == dict(enumerate(group))


def test_many_equal_columns(spark):
    """20,000 columns of five rows have 200 million pairs; grouping needs none of those of equal columns."""
    columns = spark.range(20_000).select(F.col("id").alias("col"), F.lit(0.5).alias("score"))
    entries = columns.select("col", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("row_id"), F.when(F.col("col") % 10 == 3, "b").otherwise("a").alias("value"))
    began = time.time()
    got = group_columns(columns, entries).groupBy("group").count().collect()
    assert {r["group"]: r["count"] for r in got} == {0: 18_000, 3: 2_000} and time.time() - began < 60
