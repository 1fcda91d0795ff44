"""Queries on learning take every supplier."""

import pytest

import __spark_entry__

DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def suppliers(spark):
    n = spark.read.parquet(f"{DIR}/supplier.parquet").count()
    assert n > 12
    return n


@pytest.mark.parametrize("name", ["c12_learn", "c15_learn_generalized"])
def test_learning(spark, suppliers, name):
    rows = __spark_entry__.queries()[name](spark, DIR).collect()
    assert {r["pairs"] for r in rows} == {suppliers} and sum(r["support"] for r in rows) >= suppliers


def test_others(spark, suppliers):
    q = __spark_entry__.queries()
    assert q["c7_skeletons"](spark, DIR).select("inp").distinct().count() == suppliers
    assert sum(r[1] for r in q["e1_baseline"](spark, DIR).collect()) >= suppliers
    assert q["c20_end_to_end"](spark, DIR).first()[0] == suppliers
