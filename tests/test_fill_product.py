"""Filling by the product rule where there are many proposals."""

import pytest
from pyspark.sql import functions as F

from barelake.operators.fill import choose


@pytest.mark.parametrize("few", [3, 500])
def test_product_of_many_proposals(spark, few):
    """The value of most proposals wins though all products are 0 in doubles, and the first table has another one."""
    offers = spark.range(2 * few).select(F.lit(0).alias("p"), F.col("id").alias("table_id"), F.when(F.col("id") % 3 == 0, "rare").otherwise("often").alias("value"), F.lit(0.6).alias("score"))
    assert [(r["p"], r["value"]) for r in choose(offers, "product").collect()] == [(0, "often")]


def test_product_without_a_share_for_others(spark):
    offers = spark.createDataFrame([(0, 1, "a", 0.6), (0, 2, "a", 0.6), (1, 1, "a", 0.6), (1, 2, "b", 0.8)], "p int, table_id long, value string, score double")
    assert {r["p"]: r["value"] for r in choose(offers, "product", 0.0).collect()} == {0: "a", 1: "a"}
