"""Mixing sources to target weights by Poisson replication (operator 2).

Each source has a mean repetition rate: its target share of the mixture over
its share of the documents. Each document's number of copies inverts the
Poisson distribution of that rate at a uniform number hashed from the
document's id and the seed, so a document keeps its count whatever else is in
the table and however often a task is run again. The copies are then dealt over
all partitions and ordered within them by a hash of id, copy and seed.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, row_identity, uniform

SEED = 42


def _cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... far into the tail, summed from logarithms so that no rate underflows."""
    top = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["log"] + F.log(rate) - F.log(k.cast("double"))
        total = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), total.alias("sum"), F.concat(acc["all"], F.array(total)).alias("all"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: float = 1.0, source_col: str = "source") -> DataFrame:
    """Rows (source, n_docs, rate, cumulative), one for each source found, null included.

    A source's weight is that in ``weights``, else ``default_weight``; weights
    are relative to their sum over the sources found. ``size`` is the expected
    number of rows of the mixture over that of docs.
    """
    if default_weight < 0 or any(w < 0 for w in (weights or {}).values()):
        raise ValueError("weights can't be negative")
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    counts = counts.withColumn("w", weight)
    totals = counts.agg(F.sum("n_docs").alias("docs"), F.sum("w").alias("weights")).first()
    n, total = totals["docs"] or 0, totals["weights"] or 0.0
    rate = F.col("w") * F.lit(float(size) * n) / F.lit(total) / F.col("n_docs") if total else F.lit(0.0)
    return counts.select("source", "n_docs", rate.alias("rate")).withColumn("cumulative", _cumulative(F.col("rate")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, size: float = 1.0, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture: the columns of docs, then ``copy`` (from 0) and ``shuffle_key``, in a global random order.

    Without weights all sources found get the same share. Null is a source of
    its own. Rows with a null id draw by their text; rows that repeat an id
    draw alike. Texts aren't read otherwise, so empty and very long ones behave
    as any. Sources of weight zero leave nothing. An empty table gives an empty
    one. Columns of docs named copy or shuffle_key are replaced.
    """
    plain = docs.drop("copy", "shuffle_key")
    table = rates(plain, weights, default_weight, size, source_col).select(F.col("source").alias("__source"), "cumulative")
    ident = row_identity(plain, id_col, text_col)
    known = lookup(plain.withColumn("__u", uniform(ident, F.lit(seed))).withColumn("__source", F.col(source_col)).withColumn("__ident", ident), "__source", table.withColumnRenamed("cumulative", "__cumulative"))
    count = F.size(F.filter("__cumulative", lambda c: c <= F.col("__u")))
    copies = known.withColumn("__n", count).where("__n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", "__ident", "copy", F.lit(seed), F.lit("shuffle"))))
    out = keyed.select(*plain.columns, F.col("copy").cast("long").alias("copy"), "shuffle_key")
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ORACLE = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT count(*) FROM documents)::DOUBLE / (SELECT count(*) FROM s) / n AS rate FROM s),
p AS (SELECT source, rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS mass
      FROM r, LATERAL (SELECT unnest(generate_series(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT)) AS k)),
c AS (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS cumulative FROM p),
u AS (SELECT *, ('0x' || substr(md5(doc_id || ':42'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
d AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, count(*) AS n
      FROM u JOIN c ON c.source = u.source AND c.cumulative <= u.u
      GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, i AS copy, md5(doc_id || ':' || i || ':42:shuffle') AS shuffle_key
FROM d, LATERAL (SELECT unnest(range(n)) AS i)
"""
