"""Ranks are the same in one task and over the cluster, and e6 takes every supplier."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barelake.operators import model, search
from barelake.operators.model import lake_from_lines, ranked

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("few", [3, 1000])
def test_ranked(spark, monkeypatch, few):
    monkeypatch.setattr(model, "FEW_ROWS", few)
    df = spark.createDataFrame([(k, k * 7 % 10) for k in range(50)], "id long, score int").repartition(5)
    want = sorted(((k * 7 % 10, k) for k in range(50)), key=lambda r: (-r[0], r[1]))
    for first in (0, 1):
        got = ranked(df, [F.desc("score"), F.col("id")], "rank", first).orderBy("rank").collect()
        assert [(r["rank"], r["score"], r["id"]) for r in got] == [(first + i, s, k) for i, (s, k) in enumerate(want)]
    assert ranked(df.where("false"), [F.col("id")]).collect() == []


@pytest.mark.parametrize("few", [3, 1000])
def test_search_without_a_limit(spark, monkeypatch, few):
    monkeypatch.setattr(model, "FEW_ROWS", few)
    lake = lake_from_lines(spark.createDataFrame([(k, "red fox\n" * (k % 4) + "blue sky") for k in range(12)], "id long, text string"), "id", "text")
    got = [(r["rank"], r["table_id"]) for r in search.keyword_search(lake, "fox, red", None).orderBy("rank").collect()]
    best = search.keyword_search(lake, "fox, red", 4).orderBy("rank").collect()
    assert [r for r, _ in got] == list(range(1, 10)) and got[:4] == [(r["rank"], r["table_id"]) for r in best]
    assert {t for _, t in got} == {k for k in range(12) if k % 4}


def test_transformation_quality(spark):
    s = spark.read.parquet(f"{DIR}/supplier.parquet")
    row = __spark_entry__.queries()["e6_transformation_quality"](spark, DIR).first()
    assert row["set_coverage"] == 1 and row["best_coverage"] == pytest.approx(s.where("s_suppkey % 3 <> 0").count() / s.count(), abs=1e-6)
