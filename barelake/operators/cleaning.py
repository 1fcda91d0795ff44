"""Cleaning a lake of raw tables, each rule a DataFrame operation over cells.

Rules look at one table at a time, so everything is grouped by table_id; one
repartitioning by it serves all rules of a pass.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import column_tags
from .model import Lake, settled

EMPTY_SHARE, LONG, LEAST_ROWS, LEAST_ENTRIES = 0.8, 40, 3, 3
_PUNCT = string.punctuation + " –"


def _only(value: Column, letters: str) -> Column:
    """Whether a value consists of the given characters alone; an empty one does."""
    return F.translate(value, letters, "") == ""


def normalise(cells: DataFrame) -> DataFrame:
    """None in any case is empty; double quotes become single ones."""
    v = F.translate(F.coalesce("value", F.lit("")), '"', "'")
    return cells.withColumn("value", F.when(v.isin("None", "none"), "").otherwise(v))


def column_facts(cells: DataFrame) -> DataFrame:
    """(table_id, col_id, n, empty, mean_length, punctuation, distinct) of each column, in one aggregation."""
    return cells.groupBy("table_id", "col_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("value") == "").alias("empty"),
        F.avg(F.length("value")).alias("mean_length"),
        F.bool_and(_only(F.col("value"), _PUNCT)).alias("punctuation"),
        F.count_distinct("value").alias("distinct"),
    )


def column_faults(cells: DataFrame, empty: float = EMPTY_SHARE, long: float = LONG) -> DataFrame:
    """(table_id, col_id, fault): the first rule that each bad column breaks: empty, long, punctuation or constant."""
    fault = (
        F.when(F.col("empty") / F.col("n") > empty, "empty")
        .when(F.col("mean_length") > long, "long")
        .when(F.col("punctuation"), "punctuation")
        .when(F.col("distinct") == 1, "constant")
    )
    return column_facts(cells).select("table_id", "col_id", fault.alias("fault")).where("fault IS NOT NULL")


def row_number_keys(cells: DataFrame) -> DataFrame:
    """(table_id, col_id) of columns that count up by one from their first whole number; entries of punctuation are skipped, though counted."""
    at = Window.partitionBy("table_id", "col_id").orderBy("row_id")
    numbered = cells.select("table_id", "col_id", "row_id", "value", (F.row_number().over(at) - 1).alias("i")).where(~_only(F.col("value"), _PUNCT))
    start = F.expr("try_cast(trim(value) AS bigint)") - F.col("i")
    by = numbered.groupBy("table_id", "col_id").agg(F.bool_and(F.coalesce(start.isNotNull(), F.lit(False))).alias("whole"), F.min(start).alias("low"), F.max(start).alias("high"))
    return by.where("whole AND low = high").select("table_id", "col_id")


def valid_keys(cells: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(table_id, col_id) of columns that can be keys.

    Neither numbers nor dates; no value repeated; at least three entries beyond
    punctuation and digits, and three without punctuation other than ``-``,
    ``,``, ``.`` and space.
    """
    odd = "".join(c for c in string.punctuation if c not in "-,.") + "–"
    facts = cells.groupBy("table_id", "col_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("value").alias("distinct"),
        F.count_if(~_only(F.col("value"), _PUNCT + string.digits)).alias("words"),
        F.count_if(F.length(F.translate("value", odd, "")) == F.length("value")).alias("plain"),
    )
    good = facts.where((F.col("n") == F.col("distinct")) & (F.col("words") >= LEAST_ENTRIES) & (F.col("plain") >= LEAST_ENTRIES))
    few = cells.join(good.select("table_id", "col_id"), ["table_id", "col_id"], "left_semi")
    tags = tags if tags is not None else column_tags(few, ["table_id", "col_id"])
    return good.join(tags, ["table_id", "col_id"]).where("tag = 'text'").select("table_id", "col_id")


def _renumbered(cells: DataFrame, order: Column | None = None) -> DataFrame:
    """Columns numbered from 0 in their order."""
    kept = cells.select("table_id", "col_id").distinct()
    at = Window.partitionBy("table_id").orderBy(*([order] if order is not None else []), F.col("col_id"))
    new = settled(kept.withColumn("new", (F.row_number().over(at) - 1).cast("int")))
    return cells.join(new, ["table_id", "col_id"]).select("table_id", "row_id", F.col("new").alias("col_id"), "value")


def drop_columns(cells: DataFrame, gone: DataFrame) -> DataFrame:
    return _renumbered(cells.join(gone.select("table_id", "col_id"), ["table_id", "col_id"], "left_anti"))


def promote_keys(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """The first valid key column of each table moved to the front; tables without one are dropped."""
    first = keys.groupBy("table_id").agg(F.min("col_id").alias("key"))
    shifted = cells.join(first, "table_id")
    col = F.when(F.col("col_id") == F.col("key"), 0).when(F.col("col_id") < F.col("key"), F.col("col_id") + 1).otherwise(F.col("col_id"))
    return shifted.select("table_id", "row_id", col.cast("int").alias("col_id"), "value")


def drop_keyless_rows(cells: DataFrame) -> DataFrame:
    empty = cells.where("col_id = 0 AND value = ''").select("table_id", "row_id")
    return cells.join(empty, ["table_id", "row_id"], "left_anti")


def drop_small_tables(cells: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Tables with more than ``least`` rows."""
    big = cells.groupBy("table_id").agg(F.count_distinct("row_id").alias("n")).where(F.col("n") > least)
    return cells.join(big.select("table_id"), "table_id", "left_semi")


def _count(step: str, cells: DataFrame) -> DataFrame:
    by = cells.groupBy("table_id").agg(F.count_distinct("col_id").alias("c"), F.count_distinct("row_id").alias("r"))
    return by.agg(F.lit(step).alias("step"), F.count("*").alias("tables"), F.coalesce(F.sum("c"), F.lit(0)).alias("columns"), F.coalesce(F.sum("r"), F.lit(0)).alias("rows"))


def clean(lake: Lake, long: float = LONG) -> tuple[Lake, DataFrame]:
    """The cleaned lake and (step, tables, columns, rows) after each step.

    What is decided about columns, one row for each, is settled before it is
    used; cells run through as joins with these small relations.
    """
    start = normalise(lake.cells)
    one = drop_columns(start, settled(column_faults(start, long=long)))
    two = drop_columns(one, settled(row_number_keys(one.where("col_id = 0"))))
    two = promote_keys(two, settled(valid_keys(two)))
    three = drop_keyless_rows(two)
    four = drop_columns(three, settled(column_faults(three).where("fault IN ('empty', 'punctuation') AND col_id > 0")))
    five = drop_small_tables(four)
    steps = [("raw", start), ("columns", one), ("keys", two), ("rows", three), ("columns again", four), ("small tables", five)]
    stats = _count(*steps[0])
    for name, cells in steps[1:]:
        stats = stats.unionByName(_count(name, cells))
    return Lake(five), stats
