"""One missing value, NULL: NaN comparisons must be false and aggregates must skip them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(value: Column) -> Column:
    """The value as a double, NaN as NULL."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def parsed(text: Column) -> Column:
    """Text as a double; blank, NaN in any case, or no number as NULL."""
    clean = F.trim(text)
    return F.when(F.lower(clean) == "nan", None).otherwise(known(clean.try_cast("double")))


def numeric_or_missing(text: Column) -> Column:
    """Whether the text is blank, NaN or a number; true for NULL."""
    clean = F.trim(text)
    return F.coalesce((clean == "") | (F.lower(clean) == "nan") | clean.try_cast("double").isNotNull(), F.lit(True))
