"""BM25 as Catalyst expressions, with the defaults b = 1.2 and k = 0.75."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

B, K = 1.2, 0.75


def idf(total: Column, having: Column) -> Column:
    return F.log((total - having + 0.5) / (having + 0.5) + 1)


def saturation(tf: Column, length: Column, mean_length: Column, b: float = B, k: float = K) -> Column:
    """The term frequency's share of a score, between 0 and k + 1 for b up to 1."""
    return tf * (k + 1) / (tf + k * (1 - b + b * (length / mean_length)))
