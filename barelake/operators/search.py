"""Searching a lake by keywords and by columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bm25
from ..functions.text import JOINT, keyword_tokens, qgrams, query_words
from .dml import column_groups, concatenate, extract
from .model import Lake, ranked, settled
from .related import EDIT, MAX_BROADCAST_ROWS, RELATED, related_tables, small_side

NGRAM, RESULTS = 5, 10


def keyword_postings(lake: Lake) -> DataFrame:
    """(word, table_id, row_id, col_id) for each occurrence of a word."""
    return lake.cells.select(F.explode(keyword_tokens(F.col("value"))).alias("word"), "table_id", "row_id", "col_id")


def cell_postings(lake: Lake) -> DataFrame:
    """(term, table_id, row_id, col_id) for each cell."""
    return lake.cells.select(F.lower("value").alias("term"), "table_id", "row_id", "col_id")


def gram_postings(lake: Lake, n: int) -> DataFrame:
    """(term, table_id, row_id, col_id) for each distinct n-gram of each cell, and each cell shorter than that."""
    cell = F.lower("value")
    terms = F.when(F.length(cell) < n, F.array(cell)).otherwise(qgrams(cell, n))
    return lake.cells.select(F.explode(terms).alias("term"), "table_id", "row_id", "col_id")


def key_postings(lake: Lake) -> DataFrame:
    """(key, table_id) for each row."""
    return lake.cells.where("col_id = 0").select(F.lower("value").alias("key"), "table_id")


def keyword_search(lake: Lake, keywords: str, num_results: int | None = RESULTS, b: float = bm25.B, k: float = bm25.K, cell_frequency: bool = False) -> DataFrame:
    """(rank, table_id, score): tables by the BM25 scores of comma-separated search terms, added up.

    Of a term of several words, a table counts if some cell holds all of them;
    its frequency is that of the last word in the table, or with
    ``cell_frequency`` the number of such cells. The lake is read once: only the
    query's words are kept before anything is shuffled.
    """
    spark = lake.cells.sparkSession
    terms = [(i, query_words(t)) for i, t in enumerate(keywords.split(","))]
    wanted = spark.createDataFrame([(i, w, len(set(ws)), j == len(ws) - 1) for i, ws in terms for j, w in enumerate(ws)], "term int, word string, size int, last boolean")
    known = sorted({w for _, ws in terms for w in ws})
    words = lake.cells.select(F.explode(F.filter(keyword_tokens(F.col("value")), lambda w: w.isin(known))).alias("word"), "table_id", "row_id", "col_id")
    # Per cell first: how often each word of a term is there.
    counted = words.groupBy("word", "table_id", "row_id", "col_id").agg(F.count("*").alias("n"))
    met = counted.join(F.broadcast(wanted.groupBy("term", "word", "size").agg(F.max("last").alias("last"))), "word")
    per_cell = met.groupBy("term", "table_id", "row_id", "col_id", "size").agg(F.count("*").alias("words"), F.sum(F.when(F.col("last"), F.col("n")).otherwise(0)).alias("last_n"))
    per_table = per_cell.groupBy("term", "table_id").agg(F.sum("last_n").alias("last_n"), F.count_if(F.col("words") == F.col("size")).alias("whole"))
    hits = per_table.where("whole > 0").select("term", "table_id", F.col("whole" if cell_frequency else "last_n").alias("tf"))
    frequency = hits.groupBy("term").agg(F.count("*").alias("df"))
    n, mean = lake.stats["tables"], lake.stats["avg_words"]
    scored = hits.join(F.broadcast(frequency), "term").join(lake.tables.select("table_id", "words"), "table_id")
    score = bm25.idf(F.lit(n), F.col("df")) * bm25.saturation(F.col("tf"), F.col("words"), F.lit(mean), b, k)
    total = scored.groupBy("table_id").agg(F.round(F.sum(score), 9).alias("score"))
    return _ranked(total, num_results)


def _ranked(scored: DataFrame, num_results: int | None) -> DataFrame:
    """The best results, ties by table id, null last. A limit is part of the search; without one, ranks are given over all."""
    order = [F.desc("score"), F.asc_nulls_last("table_id")]
    if num_results is None:
        return ranked(scored, order)
    top = scored.orderBy(*order).limit(num_results)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select("rank", *scored.columns)


def corpus_statistics(lake: Lake, n: int = NGRAM) -> dict[str, float]:
    """Mean size of a table's columns together, in rows and in n-grams, and mean words: each over the number of tables."""
    grams = F.sum(F.col("n") * F.greatest(F.lit(1), F.col("avg_chars") - n - 1))
    row = lake.columns.agg(F.sum("n").alias("rows"), grams.alias("grams")).first()
    tables = lake.stats["tables"]
    return {"avg_col_size": row["rows"] / tables, "avg_gram_length": row["grams"] / tables, "avg_table_words": lake.stats["avg_words"], "tables": tables, "rows": lake.stats["rows"]}


def _query_terms(entries: DataFrame, n: int | None) -> DataFrame:
    """(term, weight, qtf, size): summed weight of each term of a query column, the entries that hold it, and the entries."""
    size = entries.count()
    if n is None:
        terms = entries.select("row_id", F.col("entry").alias("term"), F.lit(1.0).alias("weight"))
    else:
        fields = entries.withColumn("fields", F.split("entry", JOINT))
        total = F.aggregate("fields", F.lit(0), lambda a, f: a + F.greatest(F.lit(1), F.length(f) - n + 1))
        each = fields.select("row_id", F.explode("fields").alias("field"), (1 / total).alias("weight"))
        terms = each.select("row_id", "weight", F.explode(F.when(F.length("field") < n, F.array("field")).otherwise(qgrams(F.col("field"), n))).alias("term"))
    return terms.groupBy("term").agg(F.sum("weight").alias("weight"), F.count_distinct("row_id").alias("qtf")).withColumn("size", F.lit(size))


def column_search(query: DataFrame, lake: Lake, groups: str, ngram: int | None = None, num_results: int | None = RESULTS, b: float = bm25.B, k: float = bm25.K) -> DataFrame:
    """(rank, table_id, score, columns): tables that can be joined by the marked columns of a query table.

    ``groups`` marks query columns; those with one mark are one key. Entries
    are compared whole, or by n-grams. For each query column, the best column
    of a table gives its score; scores multiply, and a table that lacks one
    query column isn't punished. columns maps marks to data columns.
    """
    stats = corpus_statistics(lake, ngram or NGRAM)
    mean = stats["avg_col_size"] if ngram is None else stats["avg_gram_length"]
    postings = cell_postings(lake) if ngram is None else gram_postings(lake, ngram)
    length = F.col("n") if ngram is None else F.when(F.col("avg_chars") < ngram, F.col("n")).otherwise(F.col("n") * (F.col("avg_chars") - ngram + 1))
    marked = column_groups(groups)
    if not marked:
        raise ValueError("no column is marked")
    # The terms of all query columns meet the lake in one pass.
    each = [_query_terms(extract(query, columns), ngram).select(F.lit(mark).alias("mark"), "term", "weight", bm25.idf(F.col("size"), F.col("qtf")).alias("qidf")) for mark, columns in marked.items()]
    terms = settled(reduce(DataFrame.unionByName, each))
    few = terms.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    side = F.broadcast if few else (lambda df: df)
    tf = postings.join(side(terms), "term").groupBy("mark", "term", "weight", "qidf", "table_id", "col_id").agg(F.count("*").alias("tf"))
    # Postings of a term over all tables: one row for each query term at most.
    everywhere = tf.groupBy("mark", "term").agg((F.sum("tf") + 1).alias("df"))
    known = tf.join(side(everywhere), ["mark", "term"]).join(lake.columns.withColumn("length", length), ["table_id", "col_id"])
    score = F.col("weight") * F.col("qidf") * bm25.idf(F.lit(stats["rows"]), F.col("df")) * bm25.saturation(F.col("tf"), F.col("length"), F.lit(mean), b, k)
    by = known.groupBy("mark", "table_id", "col_id").agg(F.round(F.sum(score), 12).alias("score"))
    best = by.groupBy("mark", "table_id").agg(F.max(F.struct("score", (-F.col("col_id")).alias("c"))).alias("m"))
    found = best.select("table_id", "mark", F.col("m.score").alias("score"), (-F.col("m.c")).alias("col_id"))
    total = found.groupBy("table_id").agg(F.round(F.product("score"), 9).alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("mark", "col_id")))).alias("columns"))
    return _ranked(total, num_results)


def unionable_search(query: DataFrame, lake: Lake, groups: str, related: float = RELATED, edit: float = EDIT) -> DataFrame:
    """related(rank, table_id, mapping, score) by the marked columns only; columns with one mark are concatenated first."""
    marks = column_groups(groups)
    together = concatenate(query, groups)
    gone = sorted(i for g in marks.values() for i in g[1:])
    marked = [g[0] - sum(i < g[0] for i in gone) for g in marks.values()]
    return related_tables(together, lake, related, edit, [c for c in marked if c > 0])


def jaccard_search(query: DataFrame, lake: Lake, ngram: int = NGRAM, num_results: int | None = RESULTS) -> DataFrame:
    """(rank, table_id, score): tables by the Jaccard similarity of their n-grams with the query table's; null cells have none."""
    terms = lambda c: F.when(F.length(c) < ngram, F.array(c)).otherwise(qgrams(c, ngram))
    mine = query.select(F.explode("cells").alias("c")).select(F.explode(terms(F.lower("c"))).alias("term")).distinct()
    theirs = gram_postings(lake, ngram).select("table_id", "term").distinct()
    met = theirs.join(small_side(mine.withColumn("mine", F.lit(True))), "term", "left")
    sizes = met.groupBy("table_id").agg(F.count("*").alias("size"), F.count("mine").alias("same")).where("same > 0")
    score = F.col("same") / (F.col("size") + F.lit(mine.count()) - F.col("same"))
    return _ranked(sizes.select("table_id", F.round(score, 9).alias("score")), num_results)
