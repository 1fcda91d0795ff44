"""Raw corpora as lakes, benchmark directories, and made-up datasets."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.model import Lake, numbered, ranked
from ..operators.units import Literal, Split, SplitSubstr, Substring, Transformation


def _numbered(df: DataFrame) -> DataFrame:
    """Ids in the order of reading."""
    return df.withColumn("table_id", F.monotonically_increasing_id())


def from_column_json(spark: SparkSession, path: str) -> Lake:
    """JSON documents whose ``relation`` is a table, column by column. Archives are unpacked beforehand."""
    raw = _numbered(spark.read.schema("relation array<array<string>>").option("multiLine", True).json(path))
    cols = raw.select("table_id", F.posexplode("relation").alias("col_id", "c"))
    return Lake(cols.select("table_id", F.posexplode("c").alias("row_id", "value"), "col_id").select("table_id", "row_id", "col_id", F.coalesce("value", F.lit("")).alias("value")))


def from_row_json(spark: SparkSession, path: str) -> Lake:
    """JSON lines, perhaps compressed, whose ``tableData`` is a table, row by row, of cells with a ``text``."""
    raw = _numbered(spark.read.schema("tableData array<array<struct<text:string>>>").json(path))
    rows = raw.select("table_id", F.posexplode("tableData").alias("row_id", "r"))
    return Lake(rows.select("table_id", "row_id", F.posexplode("r.text").alias("col_id", "value")).select("table_id", "row_id", "col_id", F.coalesce("value", F.lit("")).alias("value")))


def from_csv_files(spark: SparkSession, path: str, header: bool = True, name: str = "*.csv") -> Lake:
    """All CSV files below a folder, one table each, whatever their widths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(path)

    def parsed(batches):
        import csv
        import io

        for pdf in batches:
            out = []
            for file, content in zip(pdf["path"], pdf["content"]):
                lines = list(csv.reader(io.StringIO(content.decode("utf-8-sig", "replace"))))[1 if header else 0 :]
                out += [(file, r, c, v) for r, row in enumerate(lines) for c, v in enumerate(row)]
            yield pd.DataFrame(out, columns=["file", "row_id", "col_id", "value"])

    cells = files.select("path", "content").mapInPandas(parsed, "file string, row_id int, col_id int, value string")
    ids = numbered(files.select("path"), ["path"], "table_id")
    return Lake(cells.join(ids, F.col("file") == F.col("path")).select("table_id", "row_id", "col_id", "value"))


def from_xml(spark: SparkSession, path: str, row_tag: str, table: str, fields: list[str]) -> Lake:
    """XML elements ``row_tag`` as rows, those with one value of ``table`` as one table, ``fields`` as columns."""
    schema = ", ".join(f"`{f}` string" for f in dict.fromkeys([table, *fields]))
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path).withColumn("id", F.monotonically_increasing_id())
    ids = numbered(raw.select(F.col(table).alias("__table")).distinct(), ["__table"], "table_id")
    at = Window.partitionBy(table).orderBy("id")
    rows = raw.join(ids, F.col(table).eqNullSafe(F.col("__table"))).select("table_id", (F.row_number().over(at) - 1).alias("row_id"), F.array(*[F.coalesce(F.col(f), F.lit("")) for f in fields]).alias("cells"))
    return Lake(rows.select("table_id", "row_id", F.posexplode("cells").alias("col_id", "value")))


def from_wiki_text(pages: DataFrame, id_col: str = "page_id", text_col: str = "text") -> Lake:
    """The tables of wiki markup: ``{| … |}`` with rows ``|-`` and cells ``|`` or ``!``, links and markup stripped."""
    tables = pages.select(F.col(id_col).alias("p"), F.posexplode(F.regexp_extract_all(text_col, F.lit(r"(?s)\{\|(.*?)\|\}"), 1)).alias("k", "t"))
    ids = tables.withColumn("table_id", F.xxhash64("p", "k"))
    rows = ids.select("table_id", F.posexplode(F.filter(F.split("t", r"\n\|-[^\n]*"), lambda r: r.rlike(r"(?m)^\s*[|!]"))).alias("row_id", "r"))
    cells = F.filter(F.split(F.regexp_replace(F.concat(F.lit("\n"), "r"), r"\|\||!!", "\n|"), r"\n\s*[|!](?![-+}])"), lambda c: F.trim(c) != "")
    return Lake(rows.select("table_id", "row_id", F.posexplode(F.transform(cells, strip_markup)).alias("col_id", "value")))


def strip_markup(cell):
    """Plain text of a cell of wiki markup."""
    for pattern, to in (
        (r"(?s)<ref[^>]*?(?:/>|>.*?</ref>)", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"(?s)<[^>]+>", ""),
        (r"\{\{[^{}]*\}\}", ""),
        (r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]", "$1"),
        (r"\[https?://\S+ ([^\]]*)\]", "$1"),
        (r"'{2,}", ""),
        (r'^\s*(?:\w+\s*=\s*"[^"]*"\s*)+\|', ""),
    ):
        cell = F.regexp_replace(cell, pattern, to)
    return F.trim(F.translate(cell, "\n", " "))


def from_html(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Lake:
    """The tables of HTML pages, by rows and cells of the innermost table tags."""
    tables = pages.select(F.col(id_col).alias("p"), F.posexplode(F.regexp_extract_all(html_col, F.lit(r"(?is)<table[^>]*>((?:(?!<table).)*?)</table>"), 1)).alias("k", "t"))
    rows = tables.select(F.xxhash64("p", "k").alias("table_id"), F.posexplode(F.regexp_extract_all("t", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_id", "r"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", ""), r"\s+", " "))
    return Lake(rows.select("table_id", "row_id", F.posexplode(F.transform(F.regexp_extract_all("r", F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), 1), clean)).alias("col_id", "value")))


def split_column(rows: DataFrame, column: int, delimiter: str, parts: int) -> DataFrame:
    """A left-hand table: one column (from 0) of a table cut at a delimiter into so many columns, the last taking the rest."""
    pieces = F.split(F.coalesce(F.get("cells", F.lit(column)), F.lit("")), "\\Q" + delimiter + "\\E", parts)
    padded = F.concat(pieces, F.array_repeat(F.lit(""), F.greatest(F.lit(parts) - F.size(pieces), F.lit(0))))
    return rows.select("row_id", F.transform(padded, F.trim).alias("cells"))


def read_named_csv(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, <title>…): lines in lower case, cut at commas without quoting, titles in the first line."""
    raw = spark.read.text(path).withColumn("id", F.monotonically_increasing_id()).where(F.trim("value") != "")
    parts = ranked(raw.select("id", F.split(F.trim(F.lower("value")), ",").alias("c")), [F.col("id")], "row_id", 0)
    titles = [t.strip() for t in parts.where("row_id = 0").first()["c"]]
    return parts.where("row_id > 0").select((F.col("row_id") - 1).alias("row_id"), *[F.trim(F.coalesce(F.get("c", F.lit(i)), F.lit(""))).alias(t) for i, t in enumerate(titles)])


def read_benchmark(spark: SparkSession, folder: str) -> dict:
    """A benchmark directory: source and target tables, the columns to join, the richer side, and the ground truth if there is one."""
    source, target = read_named_csv(spark, f"{folder}/source.csv"), read_named_csv(spark, f"{folder}/target.csv")
    lines = [r["value"].strip().lower() for r in spark.read.text(f"{folder}/rows.txt").collect() if r["value"].strip()]
    src, _, tgt = lines[0].partition(":")
    if src not in source.columns or tgt not in target.columns:
        raise ValueError(f"rows.txt names a column that isn't there: {lines[0]}")
    out = {"source": source, "target": target, "src_col": src, "tgt_col": tgt, "rich": lines[1] if len(lines) > 1 else "source", "truth": None}
    try:
        truth = read_named_csv(spark, f"{folder}/ground truth.csv")
    except Exception as e:  # the ground truth is optional
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return out
    # Titles may carry the side as a prefix; the source's come first.
    plain = [t.removeprefix("source-").removeprefix("target-") for t in truth.columns[1:]]
    n = len(source.columns) - 1
    a, b = truth.columns[1:][:n], truth.columns[1:][n:]
    out["truth"] = truth.select(F.col(a[plain[:n].index(src)]).alias("src"), F.col(b[plain[n:].index(tgt)]).alias("tgt"))
    return out


def basic_values(data: dict) -> tuple[list[str], list[str], list[tuple[str, str]] | None]:
    """The join columns' values, repeats kept, and the golden pairs, of a small benchmark."""
    src = [r[0] for r in data["source"].orderBy("row_id").select(data["src_col"]).collect()]
    tgt = [r[0] for r in data["target"].orderBy("row_id").select(data["tgt_col"]).collect()]
    golden = None if data["truth"] is None else [(r["src"], r["tgt"]) for r in data["truth"].select("src", "tgt").collect()]
    return src, tgt, golden


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 -.,"


def random_transformation(rng: random.Random, shortest: int, blocks: tuple[int, int] = (2, 3), literals: tuple[int, int] = (1, 2), literal_length: tuple[int, int] = (1, 4)) -> Transformation:
    """Random units for inputs of at least so many characters."""
    units: list = []
    for _ in range(rng.randint(*blocks)):
        a = rng.randrange(shortest - 2)
        b = rng.randint(a + 1, shortest - 1)
        units.append(rng.choice([Substring(a, b), Split(rng.choice(" -."), (rng.randint(0, 1),)), SplitSubstr(rng.choice(" -."), 0, 0, rng.randint(1, 5))]))
    for _ in range(rng.randint(*literals)):
        units.insert(rng.randrange(len(units) + 1), Literal("".join(rng.choices("xyz#:/", k=rng.randint(*literal_length)))))
    return Transformation(tuple(units))


def synthetic(spark: SparkSession, rows: int = 500, length: tuple[int, int] = (20, 35), transformations: int = 3, seed: int = 42) -> DataFrame:
    """(id, inp, out, transformation): random inputs, each mapped by one of a few random transformations that applies to it."""
    chosen = [random_transformation(random.Random(seed + k), length[0]) for k in range(transformations)]

    def made(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = random.Random(f"{seed}:{i}")
                while True:
                    x = "".join(rng.choices(_LETTERS, k=rng.randint(*length)))
                    t = chosen[i % transformations]
                    y = t.apply(x)
                    if y:
                        break
                out.append((i, x, y, str(t)))
            yield pd.DataFrame(out, columns=["id", "inp", "out", "transformation"])

    return spark.range(rows).mapInPandas(made, "id long, inp string, out string, transformation string")
