"""Related tables: which tables of a lake hold the rows of a query table, and by which columns.

A data row matches a query row if their keys are approximately equal and each
value of the query row equals one in some other column; an empty query value
matches every column. Of each table the first matching row counts. A mapping
names the data column of each query column; the mapping that most query rows
allow is the table's, and their share is its score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import approx_equal
from .model import Lake, numbered, ranked, shape, width

#: Defaults of the thresholds.
RELATED, EDIT = 0.5, 0.1
#: The keys of a query are broadcast up to this many rows, else joined by shuffling.
MAX_BROADCAST_ROWS = 200_000


def query_side(query: DataFrame, df: DataFrame) -> DataFrame:
    """df, of at most a few rows for each row of the query table, to be broadcast if the query table is small."""
    return F.broadcast(df) if shape(query).rows <= MAX_BROADCAST_ROWS // 10 else df


def small_side(df: DataFrame) -> DataFrame:
    """df, to be broadcast if a count that stops at the limit shows it small."""
    return F.broadcast(df) if df.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS else df


def key_pairs(query: DataFrame, rows: DataFrame, t: float) -> DataFrame:
    """(q_key, d_key): keys of the query and of the lake that are approximately equal.

    Short keys only match themselves. For long ones the lake's distinct keys
    meet the query's by length: each query key is laid out over the lengths
    within the bound, an equi-join finds the keys of these lengths, and the
    distance decides.
    """
    keys = query.select(F.lower(F.get("cells", F.lit(0))).alias("q_key")).distinct()
    same = keys.select("q_key", F.col("q_key").alias("d_key"))
    if t <= 0 or shape(query).longest_key * t < 1:
        return same
    long = keys.where(F.length("q_key") * F.lit(t) >= 1)
    vocabulary = rows.select(F.lower(F.get("cells", F.lit(0))).alias("d_key")).distinct().withColumn("d_len", F.length("d_key"))
    longest = vocabulary.agg(F.max("d_len").alias("m")).first()["m"] or 0
    n = F.length("q_key")
    # |a - b| < t (a + b) bounds b from both sides; the lake's longest key does as well.
    low = F.ceil(n * (1 - t) / (1 + t)).cast("int")
    high = F.least(F.floor(n * (1 + t) / (1 - t)), F.lit(longest)).cast("int") if t < 1 else F.lit(longest)
    laid = long.where(low <= high).withColumn("len", F.explode(F.sequence(low, high)))
    near = vocabulary.join(small_side(laid), F.col("len") == F.col("d_len")).where(approx_equal(F.col("q_key"), F.col("d_key"), t) & (F.col("q_key") != F.col("d_key")))
    return same.unionByName(near.select("q_key", "d_key"))


def _choices(k: int, t: float) -> Column:
    """The data columns from 1 that the k-th query value matches."""
    value, numbers = F.lower(F.coalesce(F.get("q", F.lit(k)), F.lit(""))), F.col("places")
    return F.when(value == "", numbers).otherwise(F.filter(numbers, lambda l: approx_equal(value, F.get("d", l), t)))


def match_rows(query: DataFrame, rows: DataFrame, t: float = EDIT, marked: list[int] | None = None, by: list[str] | None = None) -> DataFrame:
    """(*by, row_id, table_id, d_id, cells, choices): the first row of each table that matches each query row.

    ``query`` has rows (*by, row_id, cells), ``rows`` the lake's. ``marked``
    restricts which query columns (from 1) must match. choices holds, for each
    of them, the columns it matches.
    """
    by = by or []
    w = width(query)
    ks = [k for k in range(1, w) if marked is None or k in marked]
    q = query.select(*by, F.col("row_id").cast("long").alias("row_id"), F.col("cells").alias("q"), F.lower(F.get("cells", F.lit(0))).alias("q_key"))
    pairs = q.join(key_pairs(query, rows, t), "q_key").withColumnRenamed("q_key", "_")
    data = rows.select("table_id", F.col("row_id").alias("d_id"), F.col("cells"), F.lower(F.get("cells", F.lit(0))).alias("d_key"))
    met = data.join(query_side(query, pairs) if shape(query).longest_key * t < 1 else small_side(pairs), "d_key").withColumn("d", F.transform("cells", lambda c: F.lower(c)))
    met = met.withColumn("places", F.when(F.size("d") > 1, F.sequence(F.lit(1), F.greatest(F.size("d") - 1, F.lit(1)))).otherwise(F.array().cast("array<int>")))
    # Where every query value is short, approximate equality is equality; the plan then holds no distance.
    short = shape(query).longest_cell * t < 1
    choices = [_choices(k, 0 if short else t) for k in ks]
    met = met.withColumn("choices", F.array(*choices) if choices else F.array().cast("array<array<int>>"))
    met = met.where(F.forall("choices", lambda c: F.size(c) > 0))
    first = met.groupBy(*by, "row_id", "table_id").agg(F.min_by(F.struct("d_id", "cells", "choices"), F.col("d_id")).alias("m"))
    return first.select(*by, "row_id", "table_id", "m.d_id", "m.cells", "m.choices")


def _mappings(choices: Column) -> Column:
    """All mappings that choices allow, the first column's choice varying fastest."""
    grow = lambda done, c: F.flatten(F.transform(c, lambda x: F.transform(done, lambda m: F.array_append(m, x))))
    return F.aggregate(choices, F.array(F.array(F.lit(0))), grow)


def best_mappings(matches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(*by, table_id, mapping, votes): the mapping that most matched rows allow, the first found among equals."""
    by = [*(by or []), "table_id"]
    spread = matches.select(*by, "row_id", F.posexplode(_mappings(F.col("choices"))).alias("at", "mapping"))
    votes = spread.groupBy(*by, "mapping").agg(F.count("*").alias("votes"), F.min(F.struct("row_id", "at")).alias("first"))
    best = Window.partitionBy(*by).orderBy(F.desc("votes"), "first")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select(*by, "mapping", "votes")


def related_tables(query: DataFrame, lake: Lake, related: float = RELATED, edit: float = EDIT, marked: list[int] | None = None) -> DataFrame:
    """related(rank, table_id, mapping, score): tables with a score of at least ``related``, best first, then by table id."""
    n, w = shape(query).rows, width(query)
    found = best_mappings(match_rows(query, lake.rows, edit, marked)).where(F.col("votes") >= F.lit(related * n))
    sized = found.join(lake.tables.select("table_id", "num_rows", "num_cols"), "table_id").where((F.col("num_rows") >= related * n) & (F.col("num_cols") >= w))
    scored = sized.select("table_id", "mapping", (F.col("votes") / F.lit(float(max(n, 1)))).alias("score"))
    return ranked(scored, [F.desc("score"), F.col("table_id")])


def related_table(query: DataFrame, lake: Lake, i: int, related: float = RELATED, edit: float = EDIT) -> tuple[DataFrame, float]:
    """The rows of the i-th related table (from 1) and its score."""
    if i < 1:
        raise IndexError("related tables are numbered from 1")
    row = related_tables(query, lake, related, edit).where(F.col("rank") == i).first()
    if row is None:
        raise IndexError(f"there are fewer than {i} related tables")
    return lake.rows.where(F.col("table_id") == row["table_id"]).select("row_id", "cells"), row["score"]


def row_matches(query: DataFrame, lake: Lake, related: DataFrame, edit: float = EDIT) -> DataFrame:
    """(table_id, row_id, d_id, cells) of the related tables' matched rows."""
    return match_rows(query, lake.rows.join(related.select("table_id"), "table_id", "left_semi"), edit).drop("choices")


def extend_rows(query: DataFrame, lake: Lake, related: float = RELATED, edit: float = EDIT) -> DataFrame:
    """The query table with the rows of related tables, through their mappings, in the order of summed scores.

    A row of the query table starts at the number of tables plus 1; each
    occurrence of a row in a related table adds the table's score. Rows are
    distinct, and rows with an empty key are left out.
    """
    found = related_tables(query, lake, related, edit)
    total = lake.stats["tables"] + 1
    projected = lake.rows.join(small_side(found), "table_id").select(
        F.transform("mapping", lambda i: F.coalesce(F.get("cells", i), F.lit(""))).alias("cells"), F.col("score").alias("s"), F.struct(F.col("rank").cast("long").alias("rank"), F.col("row_id").cast("long").alias("row")).alias("at")
    )
    own = query.select("cells", F.lit(float(total)).alias("s"), F.struct(F.lit(0).cast("long").alias("rank"), F.col("row_id").cast("long").alias("row")).alias("at"))
    # A repeated query row counts its start once.
    own = own.groupBy("cells").agg(F.min("s").alias("s"), F.min("at").alias("at"))
    scored = own.unionByName(projected).groupBy("cells").agg(F.sum("s").alias("s"), F.min("at").alias("at")).where(F.get("cells", F.lit(0)) != "")
    return numbered(scored, [F.desc(F.round("s", 9)), F.col("at"), F.col("cells")]).select("row_id", "cells")

