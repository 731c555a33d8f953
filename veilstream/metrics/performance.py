"""Performance similarity: how near a modified stream's load profile is to the original's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_error(original: Column, modified: Column) -> Column:
    """Relative to the original, squared; where that is zero, whether the modified is not."""
    return F.when(original == 0, (modified != 0).cast("double")).otherwise(F.pow((original - modified) / original, 2.0))


def _largest(tuples: Column, keys: Column, filter_only: bool) -> Column:
    """Each non-empty cell off by all it has, or by twice that where tuples can multiply."""
    most = F.when(tuples != 0, F.lit(1.0 if filter_only else 4.0)).otherwise(0.0) + F.when(keys != 0, F.lit(1.0)).otherwise(0.0)
    return F.sqrt(F.coalesce(F.sum(most), F.lit(0.0))).alias("d_max")


def largest_distance(original: DataFrame, filter_only: bool) -> DataFrame:
    """One row (d_max)."""
    return original.agg(_largest(F.col("tuples"), F.col("keys"), filter_only))


def performance_frame(original: DataFrame, modified: DataFrame, filter_only: bool = False) -> DataFrame:
    """One row (distance, d_max, similarity), from one pass over the cells of both."""
    b = modified.select("stream", "bucket", F.col("tuples").alias("t2"), F.col("keys").alias("k2"))
    cells = original.join(b, ["stream", "bucket"], "full").na.fill(0, ["tuples", "keys", "t2", "k2"])
    error = squared_error(F.col("tuples"), F.col("t2")) + squared_error(F.col("keys"), F.col("k2"))
    both = cells.agg(F.sqrt(F.coalesce(F.sum(error), F.lit(0.0))).alias("distance"), _largest(F.col("tuples"), F.col("keys"), filter_only))
    score = F.when(F.col("d_max") == 0, (F.col("distance") == 0).cast("double")).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("distance") / F.col("d_max")))
    return both.withColumn("similarity", score)


def performance_similarity(original: DataFrame, modified: DataFrame | None, filter_only: bool = False) -> float:
    return 0.0 if modified is None else float(performance_frame(original, modified, filter_only).first()["similarity"])
