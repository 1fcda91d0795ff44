"""Connected components of a graph given by its links, as DataFrame operations.

Alternating large-star and small-star steps (Kiveris et al., 2014). Each step
is an aggregation with map-side combining and an equi-join, so the links of one
very large component stay spread over the cluster; nothing goes to the driver
but one count and one checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reliable


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.shiftright(F.xxhash64("u", "v"), 20)).alias("s")).first()
    return row["n"], row["x"], row["s"]


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, few: int = 0) -> DataFrame:
    """Rows (node, root) for each node that isn't the smallest of its component.

    ``links`` has two long columns. Nulls and links of a node with itself are
    ignored; direction and repetition don't matter; an empty table gives an
    empty table. Nodes without links don't appear. Raises RuntimeError if
    ``most_rounds`` rounds don't suffice (the rounds grow with the logarithm of
    the longest chain). Up to ``few`` links, by their count, a round is one
    task without exchanges, which saves many small files; beyond it rounds are
    spread over the cluster. The result is the same.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = reliable(links.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    mark = _mark(now)
    narrow = (lambda df: df.coalesce(1)) if mark[0] <= few else (lambda df: df)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        both = narrow(now.select("u", "v").union(now.select(F.col("v"), F.col("u"))))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["k"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = narrow(reliable(large))
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(low, large["u"] == low["k"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = narrow(reliable(narrow(small.union(low.select("k", "m"))).distinct()))
        new = _mark(then)
        now, old, mark = then, mark, new
        if new == old:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
