"""Profiles of stages: tuples and distinct keys in each time bucket between fixed bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.operators.analysis import Analysis


def _checked(low: int, high: int, resolution: int) -> int:
    if low > high or resolution <= 0:
        raise ValueError("bounds must be ordered and the resolution positive")
    return (high - low) // resolution


def _bucket(low: int, high: int, resolution: int) -> Column:
    most = _checked(low, high, resolution)
    return F.greatest(F.lit(0), F.least(F.lit(most), F.floor((F.col("ts") - low) / F.lit(resolution)))).cast("int").alias("bucket")


def _counted(each: DataFrame) -> DataFrame:
    """From (stream, bucket, key): first by key, so that distinct keys are counted without holding them."""
    counted = each.groupBy("stream", "bucket", "key").agg(F.count("*").alias("n"))
    return counted.groupBy("stream", "bucket").agg(F.sum("n").alias("tuples"), F.count("key").alias("keys"))


def _key() -> Column:
    return F.when(F.col("event_type") != "EMPTY_WINDOW", F.col("key")).alias("key")


def profile(stream: DataFrame, name: str, low: int, high: int, resolution: int) -> DataFrame:
    """(stream, bucket, tuples, keys) of the buckets with tuples; markers count as tuples but not as keys."""
    if not name:
        raise ValueError("a profile needs a name")
    return _counted(stream.select(F.lit(name).alias("stream"), _bucket(low, high, resolution), _key()))


def profile_stages(analysis: Analysis, low: int, high: int, resolution: int) -> DataFrame:
    """The profiles of all stages; each frame of the analysis is gone through once for all stages that are parts of it."""
    bucket = _bucket(low, high, resolution)
    parts = []
    for df, named in analysis.frames:
        names = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in named.items()]))
        parts.append(df.select(names.alias("names"), bucket, _key()).select(F.explode("names").alias("stream"), "bucket", "key"))
    return _counted(reduce(DataFrame.unionByName, parts))


def dense(profiles: DataFrame, names: list[str], low: int, high: int, resolution: int) -> DataFrame:
    """Every bucket of every named stream, with zeros where nothing came."""
    spark = profiles.sparkSession
    most = _checked(low, high, resolution)
    grid = spark.range(0, most + 1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("stream"), F.col("id").cast("int").alias("bucket"))
    joined = grid.join(profiles, ["stream", "bucket"], "left")
    return joined.select("stream", "bucket", F.coalesce("tuples", F.lit(0)).alias("tuples"), F.coalesce("keys", F.lit(0)).alias("keys"))


def difference(one: DataFrame, other: DataFrame) -> DataFrame:
    """one - other, cell by cell."""
    b = other.select("stream", "bucket", F.col("tuples").alias("t2"), F.col("keys").alias("k2"))
    joined = one.join(b, ["stream", "bucket"], "full")
    zero = F.lit(0)
    return joined.select("stream", "bucket", (F.coalesce("tuples", zero) - F.coalesce("t2", zero)).alias("tuples"), (F.coalesce("keys", zero) - F.coalesce("k2", zero)).alias("keys"))
