"""The data model: bare tables as cells, rows and statistics.

A lake is a relation ``cells(table_id, row_id, col_id, value)``. Tables have no
column names and no types; column 0 is the key; rows may be ragged. A query
table is a relation ``rows(row_id, cells)``.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "table_id long, row_id int, col_id int, value string"
ROWS = "row_id long, cells array<string>"


@dataclass
class Lake:
    """A collection of bare tables: its cells and, if the source has them, its rows, which else are gathered from the cells."""

    cells: DataFrame
    wide: DataFrame | None = None

    @cached_property
    def rows(self) -> DataFrame:
        """rows(table_id, row_id, cells)."""
        if self.wide is not None:
            return self.wide
        packed = self.cells.groupBy("table_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", "value"))).alias("c"))
        return packed.select("table_id", "row_id", F.col("c.value").alias("cells"))

    @cached_property
    def columns(self) -> DataFrame:
        """columns(table_id, col_id, n, avg_chars): entries and truncated mean length, for the columns below the table's width."""
        sizes = self.cells.groupBy("table_id", "col_id").agg(F.count("*").alias("n"), F.floor(F.avg(F.length("value"))).alias("avg_chars"))
        return sizes.join(self.tables.select("table_id", "num_cols"), "table_id").where("col_id < num_cols").drop("num_cols")

    @cached_property
    def tables(self) -> DataFrame:
        """tables(table_id, num_rows, num_cols, words). num_cols is the commonest row length, the one seen first among equals.

        One small row for each table, settled, as every search and comparison needs it.
        """
        if self.wide is not None:
            words = F.aggregate("cells", F.lit(0), lambda n, c: n + F.size(F.split(c, " ")))
            per_row = self.wide.select("table_id", "row_id", F.size("cells").cast("long").alias("width"), words.alias("words"))
        else:
            per_row = self.cells.groupBy("table_id", "row_id").agg(F.count("*").alias("width"), F.sum(F.size(F.split("value", " "))).alias("words"))
        widths = per_row.groupBy("table_id", "width").agg(F.count("*").alias("rows"), F.min("row_id").alias("first"), F.sum("words").alias("words"))
        w = Window.partitionBy("table_id")
        best = widths.withColumn("r", F.row_number().over(w.orderBy(F.desc("rows"), "first"))).withColumn("num_rows", F.sum("rows").over(w)).withColumn("all_words", F.sum("words").over(w))
        return settled(best.where("r = 1").select("table_id", "num_rows", F.col("width").cast("int").alias("num_cols"), F.col("all_words").alias("words")))

    @cached_property
    def stats(self) -> dict:
        """Counts and means over the lake: one row, fetched once."""
        t = self.tables.agg(F.count("*").alias("tables"), F.sum("num_rows").alias("rows"), F.avg("words").alias("avg_words")).first()
        return t.asDict()

    def append(self, other: Lake) -> Lake:
        """Both lakes; the other's tables are numbered on after this one's."""
        top = self.cells.agg(F.max("table_id").alias("m")).first()["m"]
        moved = lambda df: df.withColumn("table_id", F.col("table_id") + F.lit(0 if top is None else top + 1))
        wide = self.wide.unionByName(moved(other.wide)) if self.wide is not None and other.wide is not None else None
        return Lake(self.cells.unionByName(moved(other.cells)), wide)


def lake_from_rows(wide: DataFrame) -> Lake:
    """A lake of rows (table_id, row_id, cells)."""
    return Lake(wide.select("table_id", "row_id", F.posexplode("cells").alias("col_id", "value")), wide)


def lake_from_frame(df: DataFrame, table: str, order: list[str], values: list[str], null: str | None = "") -> Lake:
    """Each distinct ``table`` value is a bare table; its rows in ``order``; ``values`` become columns as strings, null as empty or as ``null``."""
    at = Window.partitionBy(table).orderBy(*order)
    cells = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in values])
    return lake_from_rows(df.select(F.col(table).cast("long").alias("table_id"), (F.row_number().over(at) - 1).alias("row_id"), cells.alias("cells")))


def lake_from_lines(df: DataFrame, table: str, text: str) -> Lake:
    """Each row of df is a bare table of one column, with a row for each line of its text."""
    lines = df.select(F.col(table).cast("long").alias("table_id"), F.posexplode(F.split(text, "\n")).alias("row_id", "value"))
    return Lake(lines.select("table_id", "row_id", F.lit(0).alias("col_id"), "value"), lines.select("table_id", "row_id", F.array("value").alias("cells")))


def query_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A query table from literal rows; keys can't be empty."""
    data = [(i, ["" if v is None else str(v) for v in r]) for i, r in enumerate(rows)]
    if any(not r or not r[0] for _, r in data):
        raise ValueError("a row's key can't be empty")
    return spark.createDataFrame(data, ROWS)


def settled(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared checkpoint folder, its lineage cut.

    For small results that several later steps read, and for iterations. The
    folder is the one the session names in ``spark.checkpoint.dir``; a temporary
    one is set only where the session names none.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, order: list, name: str = "row_id") -> DataFrame:
    """df with dense numbers from 0 in an order that no two rows share, without gathering the rows in one task.

    Rows are sorted by ranges over the cluster and settled; a range's first
    number is the sum of the sizes of those before it, of which there is one
    row for each partition.
    """
    placed = settled(df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    at = F.col("__offset") + F.col("__id").bitwiseAND((1 << 33) - 1)
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(name, at.cast("long")).select(name, *df.columns)


#: Rows up to which numbers are given in one task.
FEW_ROWS = 100_000


def ranked(df: DataFrame, order: list, name: str = "rank", first: int = 1) -> DataFrame:
    """df, settled, with dense numbers from ``first`` in an order that no two rows share: in one task if a count that stops at FEW_ROWS shows few rows, else over the cluster."""
    df = settled(df)
    if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) + (first - 1)).cast("long")).select(name, *df.columns)
    return numbered(df, order, name).withColumn(name, F.col(name) + first)


def rows_to_cells(rows: DataFrame) -> DataFrame:
    """cells(row_id, col_id, value) of a query table."""
    return rows.select("row_id", F.posexplode("cells").alias("col_id", "value"))


@dataclass(frozen=True)
class Shape:
    """Facts about a query table: rows, the commonest length of a row (the one seen first among equals), longest key and cell."""

    rows: int
    width: int
    longest_key: int
    longest_cell: int


def shape(rows: DataFrame) -> Shape:
    """The shape of a query table, found in one job and kept with the frame, which doesn't change."""
    known = rows.__dict__.get("_shape")
    if known is None:
        by = rows.groupBy(F.size("cells").alias("w")).agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max(F.length(F.get("cells", F.lit(0)))).alias("k"), F.max(F.array_max(F.transform("cells", F.length))).alias("c"))
        found = by.collect()
        best = min(found, key=lambda r: (-r["n"], r["first"]), default=None)
        known = rows._shape = Shape(sum(r["n"] for r in found), best["w"] if best else 0, max((r["k"] or 0 for r in found), default=0), max((r["c"] or 0 for r in found), default=0))
    return known


def width(rows: DataFrame) -> int:
    """The commonest length of a query table's rows; 0 without rows."""
    return shape(rows).width


def collect_rows(rows: DataFrame) -> list[tuple]:
    """The rows of a query table in order, for display and for operators whose cost lies in a small example table."""
    return [tuple(r["cells"]) for r in rows.orderBy("row_id").collect()]
