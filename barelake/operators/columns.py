"""Extending the columns of a query table from its related tables.

Candidate columns are in long form: ``columns(col, score)`` with an order
number, and ``entries(col, row_id, value)`` without empty values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tags import column_tags
from .model import Lake, ranked, settled, shape
from .related import EDIT, RELATED, related_tables, row_matches, small_side

GROUPING, EMPTY, MULTIPLIER = 0.5, 0.5, 0.1


def candidate_columns(query: DataFrame, lake: Lake, related: float = RELATED, edit: float = EDIT) -> tuple[DataFrame, DataFrame]:
    """columns(col, score) and entries(col, row_id, value): each unmapped column of each related table, laid beside the query's rows."""
    found = related_tables(query, lake, related, edit)
    wide = found.join(lake.tables.select("table_id", "num_cols"), "table_id")
    spread = wide.select("rank", "table_id", "score", F.explode(F.array_except(F.sequence(F.lit(1), F.greatest(F.col("num_cols") - 1, F.lit(1))), "mapping")).alias("c"), "num_cols").where(F.col("c") < F.col("num_cols"))
    numbered = ranked(spread, [F.col("rank"), F.col("c")], "col", 0)
    rows = row_matches(query, lake, found, edit)
    entries = rows.join(small_side(numbered.select("table_id", "c", "col")), "table_id").select("col", "row_id", F.coalesce(F.get("cells", F.col("c")), F.lit("")).alias("value"))
    return numbered.select("col", "score"), entries.where("value <> ''")


def representatives(entries: DataFrame) -> DataFrame:
    """(col, rep): rep is the lowest of the columns that hold the same values in the same rows."""
    held = settled(entries.groupBy("col").agg(F.array_sort(F.collect_list(F.struct("row_id", "value"))).alias("held")))
    lowest = held.groupBy("held").agg(F.min("col").alias("rep"))
    return settled(held.join(small_side(lowest), "held").select("col", "rep"))


def _agreeing(entries: DataFrame) -> DataFrame:
    """(a, b, overlap) for columns a <= b that agree in some row.

    Only agreeing cells are joined; the rows where both have a value are
    counted from the columns' lists of rows. These are few for each column, one
    for each row of the query table at most.
    """
    tasks = entries.sparkSession.sparkContext.defaultParallelism
    x, y = entries.select(F.col("col").alias("a"), "row_id", "value"), entries.select(F.col("col").alias("b"), "row_id", "value")
    met = x.repartition(tasks, "a").join(small_side(y), ["row_id", "value"]).where("a <= b").groupBy("a", "b").agg(F.count("*").alias("same"))
    rows = settled(entries.groupBy("col").agg(F.collect_set("row_id").alias("rows")))
    of = lambda c, name: small_side(rows.select(F.col("col").alias(c), F.col("rows").alias(name)))
    both = F.size(F.array_intersect("x", "y"))
    return met.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", (F.col("same") / both).alias("overlap"))


def overlaps(entries: DataFrame, digits: int | None = None) -> DataFrame:
    """(a, b, overlap) for columns a < b that agree in some row: agreeing rows over the rows where both have a value.

    Equal columns are compared once, by their representatives, and each pair is
    laid out over the columns that these stand for, without a shuffle of pairs.
    ``digits`` rounds overlaps before that.
    """
    reps = representatives(entries)
    alone = settled(entries.join(small_side(reps.where("col = rep").select("col")), "col", "left_semi"))
    found = _agreeing(alone).withColumnsRenamed({"a": "ra", "b": "rb"})
    if digits is not None:
        found = found.withColumn("overlap", F.round("overlap", digits))
    found = settled(found).repartition(4 * entries.sparkSession.sparkContext.defaultParallelism)
    members = lambda c, rep: small_side(reps.select(F.col("rep").alias(rep), F.col("col").alias(c)))
    laid = found.join(members("x", "ra"), "ra").join(members("y", "rb"), "rb").where((F.col("ra") != F.col("rb")) | (F.col("x") < F.col("y")))
    return laid.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")


def group_columns(columns: DataFrame, entries: DataFrame, threshold: float = GROUPING) -> DataFrame:
    """(col, group): columns of the same type tag whose overlap reaches the threshold, directly or through others; group is the lowest member.

    Equal columns overlap in whole and are one, the lowest of them. Labels
    spread along links of these until none changes; each round is an
    aggregation and a join over one row for each of them and each link.
    """
    if threshold > 1:
        return columns.select("col", F.col("col").alias("group"))
    reps = representatives(entries)
    alone = settled(entries.join(small_side(reps.where("col = rep").select("col")), "col", "left_semi"))
    tags = column_tags(alone, ["col"])
    t1, t2 = tags.select(F.col("col").alias("a"), F.col("tag").alias("ta")), tags.select(F.col("col").alias("b"), F.col("tag").alias("tb"))
    links = _agreeing(alone).where(F.col("a") < F.col("b")).where(F.col("overlap") >= threshold).join(t1, "a").join(t2, "b").where(F.col("ta") == F.col("tb")).select("a", "b")
    links = settled(links)
    both = settled(links.union(links.select("b", "a")).toDF("a", "b"))
    label = settled(reps.where("col = rep").select("col", F.col("col").alias("group")))
    while True:
        low = both.join(small_side(label), both["b"] == label["col"]).groupBy("a").agg(F.min("group").alias("low"))
        new = settled(label.join(low, label["col"] == low["a"], "left").select("col", F.least("group", F.coalesce("low", "group")).alias("group")))
        if not new.join(label.withColumnRenamed("group", "old"), "col").where("group <> old").limit(1).count():
            break
        label = new
    of = reps.join(small_side(label.withColumnRenamed("col", "rep")), "rep").select("col", "group")
    # A column without a value is a group of its own.
    return settled(columns.select("col").join(small_side(of), "col", "left").select("col", F.coalesce("group", "col").alias("group")))


def consolidate(grouped: DataFrame, columns: DataFrame, entries: DataFrame, rule: str = "sum", multiplier: float = MULTIPLIER) -> DataFrame:
    """(group, row_id, value, score): the best value of each row of each group; the one of the lowest column among equals.

    sum: the scores of the columns that hold the value, added. product: the
    scores of the columns that hold it and ``multiplier`` for each that doesn't.
    """
    if rule not in ("sum", "product"):
        raise ValueError("the rule is sum or product")
    sizes = grouped.groupBy("group").agg(F.count("*").alias("size"))
    known = entries.join(grouped, "col").join(columns, "col")
    by = known.groupBy("group", "row_id", "value").agg(F.sum("score").alias("s"), F.product("score").alias("p"), F.count("*").alias("n"), F.min("col").alias("first")).join(sizes, "group")
    score = F.col("s") if rule == "sum" else F.col("p") * F.pow(F.lit(float(multiplier)), F.col("size") - F.col("n"))
    best = Window.partitionBy("group", "row_id").orderBy(F.desc(F.round("score", 12)), "first")
    return by.withColumn("score", score).withColumn("r", F.row_number().over(best)).where("r = 1").select("group", "row_id", "value", "score")


def extend_columns(query: DataFrame, lake: Lake, related: float = RELATED, edit: float = EDIT, grouping: float = GROUPING, rule: str = "sum", multiplier: float = MULTIPLIER, empty: float = EMPTY) -> DataFrame:
    """The query table with a column for each group of candidate columns, in the order of their first members.

    Groups without a value are left out, and so are those with more than
    ``empty`` of the rows empty.
    """
    columns, entries = candidate_columns(query, lake, related, edit)
    columns, entries = settled(columns), settled(entries)
    grouped = group_columns(columns, entries, grouping)
    chosen = settled(consolidate(grouped, columns, entries, rule, multiplier))
    n, w = shape(query).rows, shape(query).width
    full = chosen.groupBy("group").agg(F.count("*").alias("filled")).where(n - F.col("filled") <= F.lit(n * empty))
    order = [r["group"] for r in full.orderBy("group").collect()]
    by_row = chosen.join(small_side(full), "group", "left_semi").groupBy("row_id").agg(F.map_from_entries(F.collect_list(F.struct("group", "value"))).alias("m"))
    base = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(w) - F.size("cells"), F.lit(0))))
    more = [F.coalesce(F.element_at("m", F.lit(g).cast("long")), F.lit("")) for g in order]
    return query.join(by_row, "row_id", "left").select("row_id", (F.concat(base, F.array(*more)) if more else base).alias("cells"))
