"""Type tags of values and columns: date, numeric or text."""


import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

try:
    from dateutil import parser as _dates
except ImportError:  # without the library no value is a date
    _dates = None


@lru_cache(maxsize=1 << 16)
def value_tag(value: str | None) -> str | None:
    """The tag of one value; None for an empty one. Dates have several words; all that float() takes is numeric."""
    if not value:
        return None
    words = re.sub(r"[/-]", " ", value).translate({ord("."): None, ord(","): None})
    if _dates is not None and len(words.split()) > 1:
        try:
            _dates.parse(words)
            return "date"
        except (ValueError, OverflowError, TypeError):
            pass
    try:
        float(value)
        return "numeric"
    except ValueError:
        return "text"


@F.pandas_udf(StringType())
def _tags(values: pd.Series) -> pd.Series:
    return values.map(value_tag, na_action="ignore").astype(object).where(values.notna(), None)


def tag(value: Column) -> Column:
    return _tags(value)


def column_tags(cells: DataFrame, keys: list[str]) -> DataFrame:
    """The commonest tag of the non-empty cells of each column, the one seen first among equals; null without such cells.

    Values are tagged once each, however often they occur.
    """
    values = cells.groupBy(*keys, "value").agg(F.count("*").alias("n"), F.min("row_id").alias("first")).withColumn("tag", tag(F.col("value")))
    by = values.groupBy(*keys, "tag").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    best = Window.partitionBy(*keys).orderBy(F.col("tag").isNull(), F.desc("n"), "first")
    return by.withColumn("r", F.row_number().over(best)).where("r = 1").select(*keys, "tag")
