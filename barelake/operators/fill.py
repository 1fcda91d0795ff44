"""Filling the empty cells of a query table from a lake.

For an empty cell, the table is reduced to its key and that column. A table of
the lake that holds the row's key, and enough of the other rows by one of its
columns, proposes what it has for the key in that column, with the share of the
rows it holds as a score. Columns don't influence each other, so the r-th empty
cells of all columns are filled at once; within a column, cells filled before
count for those after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import Lake, collect_rows, query_table, width
from .related import EDIT, RELATED, best_mappings, match_rows

MULTIPLIER = 0.1


def proposals(cells: DataFrame, lake: Lake, related: float = RELATED, edit: float = EDIT) -> DataFrame:
    """(p, table_id, value, score) for problems p.

    ``cells`` has rows (p, row_id, cells) with the key and the value of the
    column, and the row to be filled with its key alone and row_id -1.
    """
    targets = cells.where("row_id = -1")
    others = cells.where("row_id <> -1")
    sizes = cells.groupBy("p").agg(F.count("*").alias("n"))
    keyed = match_rows(targets, lake.rows, edit, by=["p"]).select("p", "table_id", F.col("cells").alias("found"))
    wide = best_mappings(match_rows(others, lake.rows, edit, by=["p"]), ["p"])
    votes = wide.join(keyed, ["p", "table_id"]).join(sizes, "p").withColumn("votes", F.col("votes") + 1)
    good = votes.where(F.col("votes") >= F.col("n") * F.lit(related))
    return good.select("p", "table_id", F.coalesce(F.get("found", F.get("mapping", F.lit(1))), F.lit("")).alias("value"), (F.col("votes") / F.col("n")).alias("score"))


def _log(c: str | Column) -> Column:
    """The natural logarithm; minus infinity for 0, which else is null."""
    return F.when(F.col(c) > 0 if isinstance(c, str) else c > 0, F.log(c)).otherwise(F.lit(float("-inf")))


def choose(offers: DataFrame, rule: str = "sum", multiplier: float = MULTIPLIER) -> DataFrame:
    """(p, value, score): the best proposal of each problem; the one of the first table among equals.

    product: the scores of the value's proposals and ``multiplier`` for each
    other one, as a logarithm, since the product of many is 0 in a double.

    probabilistic: the cell's likelihood is the sum of the value's own scores
    and of 1 less the score of each other proposal.
    """
    by = offers.groupBy("p", "value").agg(F.sum("score").alias("s"), F.sum(_log("score")).alias("m"), F.count("*").alias("k"), F.min("table_id").alias("first"))
    all_of = Window.partitionBy("p")
    total, count = F.sum("k").over(all_of), F.sum("s").over(all_of)
    score = {
        "sum": F.col("s"),
        "product": F.col("m") + F.when(total > F.col("k"), _log(F.lit(float(multiplier))) * (total - F.col("k"))).otherwise(0.0),
        "probabilistic": F.col("s") + (total - F.col("k")) - (count - F.col("s")),
    }.get(rule)
    if score is None:
        raise ValueError("the rule is sum, product or probabilistic")
    best = Window.partitionBy("p").orderBy(F.desc(F.round("score", 12)), "first", "value")
    return by.withColumn("score", score).withColumn("r", F.row_number().over(best)).where("r = 1").select("p", "value", "score")


def fill(query: DataFrame, lake: Lake, related: float = RELATED, edit: float = EDIT, rule: str = "sum", multiplier: float = MULTIPLIER) -> DataFrame:
    """The query table with its empty cells filled where the lake has a proposal; short rows are padded."""
    spark = query.sparkSession
    w = width(query)
    rows = [list(r) + [""] * (w - len(r)) for r in collect_rows(query)]
    empty = [[i for i, r in enumerate(rows) if r[c] == ""] for c in range(w)]
    before = [list(r) for r in rows]
    rounds = [[(i, c) for c in range(1, w) for i in empty[c]]] if rule == "probabilistic" else [[(empty[c][k], c) for c in range(1, w) if k < len(empty[c])] for k in range(max(map(len, empty[1:]), default=0))]
    for cells in rounds:
        source = before if rule == "probabilistic" else rows
        data = []
        for p, (i, c) in enumerate(cells):
            data += [(p, k, [r[0], r[c]]) for k, r in enumerate(source) if k != i]
            data.append((p, -1, [source[i][0]]))
        if not data:
            continue
        problems = spark.createDataFrame(data, "p int, row_id long, cells array<string>")
        for r in choose(proposals(problems, lake, related, edit), rule, multiplier).collect():
            i, c = cells[r["p"]]
            rows[i][c] = r["value"]
    return query_table(spark, [tuple(r) for r in rows]) if rows else query
