"""Operations on one query table (row numbers and column numbers from 1). Each gives a new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import joined
from .model import width


class TableError(ValueError):
    """An operation that the table doesn't allow."""


def _renumbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Row ids from 0 in the order given. Query tables are small; a lake is never numbered this way."""
    at = Window.orderBy(*(order or (F.col("row_id"),)))
    return rows.select((F.row_number().over(at) - 1).cast("long").alias("row_id"), "cells")


def insert(rows: DataFrame, values: list[str]) -> DataFrame:
    """Adds a row at the end. It may be shorter than the table is wide, not longer."""
    if not values or not values[0]:
        raise TableError("the key can't be empty")
    if len(values) > width(rows):
        raise TableError("the row is wider than the table")
    new = rows.agg((F.coalesce(F.max("row_id"), F.lit(-1)) + 1).cast("long").alias("row_id")).withColumn("cells", F.array(*map(F.lit, values)))
    return rows.unionByName(new)


def delete(rows: DataFrame, values: list[str]) -> DataFrame:
    """Removes the first row equal to the values."""
    same = rows.where(F.col("cells") == F.array(*map(F.lit, values))).agg(F.min("row_id").alias("m")).first()["m"]
    if same is None:
        raise TableError("there is no such row")
    return _renumbered(rows.where(F.col("row_id") != same))


def delete_rows(rows: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Removes the rows from first to last."""
    last, n = first if last is None else last, rows.count()
    if not 1 <= first <= last <= n:
        raise TableError(f"rows are numbered from 1 to {n}")
    return _renumbered(rows.where(~F.col("row_id").between(first - 1, last - 1)))


def delete_columns(rows: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Removes the columns from first to last, the highest first. For the key, the first later column without empty cells moves in its place."""
    last, w = first if last is None else last, width(rows)
    if not 1 <= first <= last <= w:
        raise TableError(f"columns are numbered from 1 to {w}")
    for col in range(last, first - 1, -1):
        cells = F.col("cells")
        if col > 1:
            rows = rows.withColumn("cells", _without(cells, col - 1))
        elif w == 1:
            rows = rows.where(F.lit(False))
        else:
            full = [F.count_if(F.coalesce(F.get("cells", F.lit(i)), F.lit("")) == "").alias(f"c{i}") for i in range(1, w)]
            empty = rows.agg(*full).first()
            good = [i for i in range(1, w) if empty[f"c{i}"] == 0]
            if not good:
                raise TableError("no other column can be the key")
            rest = _without(cells, good[0])
            rows = rows.withColumn("cells", F.concat(F.array(F.get(cells, F.lit(good[0]))), F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0)))))
        w -= 1
    return rows


def _without(cells: Column, index: int) -> Column:
    return F.filter(cells, lambda _, i: i != index)


def update_cell(rows: DataFrame, row: int, col: int, value: str) -> DataFrame:
    """Sets one cell outside the key column; a short row is padded with empty cells up to it."""
    w = width(rows)
    if col == 1:
        raise TableError("the key column can't be changed")
    if not 2 <= col <= w or not 1 <= row <= rows.count():
        raise TableError("there is no such cell")
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(col) - F.size("cells"), F.lit(0))))
    changed = F.transform(padded, lambda x, i: F.when(i == col - 1, F.lit(value)).otherwise(x))
    return rows.withColumn("cells", F.when(F.col("row_id") == row - 1, changed).otherwise(F.col("cells")))


def delete_cell(rows: DataFrame, row: int, col: int) -> DataFrame:
    """Empties one cell outside the key column."""
    return update_cell(rows, row, col, "")


def swap(rows: DataFrame, i: int, j: int) -> DataFrame:
    """Swaps two columns; a column with empty cells can't become the key."""
    w = width(rows)
    if not (1 <= i <= w and 1 <= j <= w):
        raise TableError(f"columns are numbered from 1 to {w}")
    if i == j:
        return rows
    a, b = sorted((i, j))
    if a == 1 and rows.where(F.coalesce(F.get("cells", F.lit(b - 1)), F.lit("")) == "").limit(1).count():
        raise TableError("the key column can't hold empty cells")
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.greatest(F.lit(b) - F.size("cells"), F.lit(0))))
    at = F.col("p")
    swapped = F.transform(at, lambda x, k: F.when(k == a - 1, F.get(at, F.lit(b - 1))).when(k == b - 1, F.get(at, F.lit(a - 1))).otherwise(x))
    return rows.withColumn("p", padded).withColumn("cells", swapped).drop("p")


def sort(rows: DataFrame, col: int, descending: bool = False) -> DataFrame:
    """Rows by one column in code-point order; equal ones keep their order. Repeated rows stay."""
    if not 1 <= col <= width(rows):
        raise TableError("there is no such column")
    value = F.coalesce(F.get("cells", F.lit(col - 1)), F.lit(""))
    return _renumbered(rows, value.desc() if descending else value.asc(), F.col("row_id"))


def column_groups(marks: str) -> dict[str, list[int]]:
    """Columns (from 0) of each mark in a string such as ``a-b-a``; a dash leaves a column out."""
    out: dict[str, list[int]] = {}
    for i, c in enumerate(marks):
        if c != "-":
            out.setdefault(c, []).append(i)
    return out


def concatenate(rows: DataFrame, marks: str) -> DataFrame:
    """Joins the columns of each mark at the place of its first; other columns stay where they are."""
    groups = column_groups(marks)
    first = {g[0]: g for g in groups.values()}
    gone = {i for g in groups.values() for i in g[1:]}
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    out = [joined([cell(k) for k in first[i]]) if i in first else cell(i) for i in range(width(rows)) if i not in gone]
    return rows.select("row_id", F.array(*out).alias("cells"))


def extract(rows: DataFrame, columns: list[int]) -> DataFrame:
    """entries(row_id, entry): a column, or several joined, in lower case. Rows without the column are left out."""
    there = rows.where(F.size("cells") > max(columns))
    return there.select("row_id", F.lower(joined([F.get("cells", F.lit(i)) for i in columns])).alias("entry"))


def contains(rows: DataFrame, tables: DataFrame, threshold: float) -> DataFrame:
    """(row_id, table_id): query rows that some row of a table holds, by key and with each value in some other column; empty values match any."""
    from .related import match_rows

    return match_rows(rows, tables, threshold).select("row_id", "table_id").distinct()
