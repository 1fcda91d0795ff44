"""Databases of bare tables in text files, and lakes as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.model import Lake, lake_from_rows, numbered, query_table
from .rows import format_cells, parse_cells


def tables_from_blocks(blocks: DataFrame) -> Lake:
    """A lake from (table_id, block), a block holding the lines of one table."""
    lines = blocks.select("table_id", F.posexplode(F.filter(F.split("block", "\r?\n"), lambda s: F.trim(s) != "")).alias("row_id", "line"))
    return lake_from_rows(lines.select("table_id", "row_id", parse_cells(F.col("line")).alias("cells")))


def read_database(spark: SparkSession, path: str) -> Lake:
    """Tables separated by blank lines; the first line of each file is its header, whatever it says.

    A blank line is the record separator, so files are split and read in
    parallel, a record being a table; no line is numbered across a file. Table
    ids follow the files' order and the places in them.
    """
    raw = spark.read.option("lineSep", "\n\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = raw.withColumn("id", F.monotonically_increasing_id())
    first = placed.where("start = 0").groupBy("file").agg(F.min("id").alias("id")).select(F.col("id").alias("first_id"))
    marked = placed.join(F.broadcast(first), F.col("id") == F.col("first_id"), "left")
    # The header is the file's first line; a table may follow it without a blank line.
    headless = F.when(F.col("first_id").isNull(), F.col("value")).otherwise(F.regexp_replace("value", r"^[^\n]*(\n|$)", ""))
    blocks = marked.select("id", headless.alias("block")).where(F.trim(F.regexp_replace("block", r"[\r\n]+", "")) != "")
    return tables_from_blocks(numbered(blocks, ["id"], "table_id").select("table_id", "block"))


def import_database(lake: Lake, path: str) -> Lake:
    """The lake with a file's tables added, numbered on."""
    return lake.append(read_database(lake.cells.sparkSession, path))


def database_text(lake: Lake) -> DataFrame:
    """One row (table_id, value) for each table: its lines and the blank line after it."""
    lines = lake.rows.select("table_id", "row_id", format_cells(F.col("cells")).alias("line"))
    by = lines.groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("row_id", "line"))).alias("l"))
    return by.select("table_id", F.concat(F.array_join("l.line", "\n"), F.lit("\n")).alias("value"))


def export_database(lake: Lake, path: str, single_file: bool = False) -> None:
    """Writes a lake as text with a header line in each file. A single file is for lakes that one task can write."""
    tables = database_text(lake)
    if single_file:
        stats = lake.tables.agg(F.count("*").alias("n"), F.avg("num_rows").alias("r"), F.avg("num_cols").alias("c"))
        header = stats.select(F.lit(-1).cast("long").alias("table_id"), F.format_string("%d %.3f %.3f\n", "n", F.coalesce("r", F.lit(0.0)), F.coalesce("c", F.lit(0.0))).alias("value"))
        tables.unionByName(header).orderBy("table_id").coalesce(1).select("value").write.mode("overwrite").text(path)
        return
    by_part = tables.sortWithinPartitions("table_id")
    first = by_part.withColumn("id", F.monotonically_increasing_id()).withColumn("head", F.when(F.col("id").bitwiseAND((1 << 33) - 1) == 0, F.lit("0 0 0\n\n")).otherwise(F.lit("")))
    first.select(F.concat("head", "value").alias("value")).write.mode("overwrite").text(path)


def read_query_table(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """A query table from a text or CSV file, a row to a line; the first line is skipped if it is a header.

    Query tables are small: the lines are numbered in one task.
    """
    raw = spark.read.text(path).withColumn("id", F.monotonically_increasing_id()).where(F.trim("value") != "")
    rows = raw.select((F.row_number().over(Window.orderBy("id")) - 1).cast("long").alias("row_id"), parse_cells(F.col("value")).alias("cells"))
    return rows.where("row_id > 0").withColumn("row_id", F.col("row_id") - 1) if header else rows


def export_query_table(rows: DataFrame, path: str) -> None:
    rows.orderBy("row_id").coalesce(1).select(format_cells(F.col("cells")).alias("value")).write.mode("overwrite").text(path)


def save_lake(lake: Lake, path: str) -> None:
    """Cells as Parquet, ordered by table, so that a table's cells share few row groups."""
    lake.cells.repartitionByRange("table_id").sortWithinPartitions("table_id", "row_id", "col_id").write.mode("overwrite").parquet(path)


def load_lake(spark: SparkSession, path: str) -> Lake:
    return Lake(spark.read.parquet(path))


def save_key_index(lake: Lake, path: str, shards: int = 64) -> None:
    """(key, table_id) partitioned by a hash of the key: a lookup reads one shard, and within it the row groups that may hold the key."""
    from ..operators.search import key_postings

    keyed = key_postings(lake).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    keyed.repartition("shard").sortWithinPartitions("shard", "key").write.mode("overwrite").partitionBy("shard").parquet(path)


def lookup_keys(spark: SparkSession, path: str, keys: list[str], shards: int = 64) -> DataFrame:
    """(key, table_id) of the given keys from a saved index, shards pruned."""
    wanted = spark.createDataFrame([(k.lower(),) for k in keys], "key string")
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    numbers = [r[0] for r in wanted.select(shard).distinct().collect()]
    return spark.read.parquet(path).where(F.col("shard").isin(numbers) & F.col("key").isin([k.lower() for k in keys])).select("key", "table_id")


def literal_table(spark: SparkSession, text: str) -> DataFrame:
    """A query table from a literal."""
    from .rows import parse_literal

    return query_table(spark, parse_literal(text))
