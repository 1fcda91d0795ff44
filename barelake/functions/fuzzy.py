"""Approximate equality of strings as Catalyst expressions.

Two strings are approximately equal under a threshold t if t is 0 or either is
so short that its length times t is under 1, and they are equal; or else if
their indel distance (insertions and deletions only, so a substitution costs
two) over the sum of their lengths is under t.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def indel(a: Column, b: Column) -> Column:
    """Insertions and deletions that turn a into b, by rows of the usual table."""
    letters = F.filter(F.split(a, ""), lambda c: c != "")
    others = F.filter(F.split(b, ""), lambda c: c != "")
    numbers = F.sequence(F.lit(0), F.length(b))

    def row(before: Column, c: Column) -> Column:
        def cell(done: Column, j: Column) -> Column:
            diagonal = F.element_at(before, j)
            step = F.least(F.element_at(before, j + 1), F.element_at(done, -1)) + 1
            return F.array_append(done, F.when(F.element_at(others, j) == c, diagonal).otherwise(step))

        first = F.array(F.element_at(before, 1) + 1)
        return F.when(F.size(others) > 0, F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(others), F.lit(1))), first, cell)).otherwise(first)

    return F.element_at(F.aggregate(letters, numbers, row), -1)


def exact_only(a: Column, t: float) -> Column:
    """Whether a string is compared by equality because it is short."""
    return F.lit(True) if t == 0 else F.length(a) * F.lit(t) < 1


def approx_equal(a: Column, b: Column, t: float) -> Column:
    """Cheap tests come first: lengths, then Levenshtein distance, which never exceeds indel, cut off at the bound."""
    if t == 0:
        return a == b
    bound = F.lit(t) * (F.length(a) + F.length(b))
    ceiling = F.greatest(F.ceil(bound).cast("int"), F.lit(0))
    far = (F.abs(F.length(a) - F.length(b)) >= bound) | (F.levenshtein(a, b) > ceiling)
    fuzzy = F.when(a == b, F.lit(True)).when(far, F.lit(False)).otherwise(indel(a, b) < bound)
    return F.when(exact_only(a, t) | exact_only(b, t), a == b).otherwise(fuzzy)
