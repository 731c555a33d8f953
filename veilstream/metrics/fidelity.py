"""Results similarity: F1 of a modified stream's results, with a relative tolerance for values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.sources.streams import q


def similar(truth: Column, predicted: Column, tolerance: float) -> Column:
    """Within the tolerance of the true value, or near zero if that is zero; missing values are never similar."""
    gap = F.abs(truth - predicted)
    close = F.when(F.abs(truth) < 1e-9, F.abs(predicted) <= 1e-9).otherwise(gap / F.abs(truth) <= tolerance)
    return F.coalesce(close, F.lit(False))


def f1_counts(truth: DataFrame, predicted: DataFrame, attributes: tuple[str, ...], tolerance: float) -> DataFrame:
    """One row (matched, n_truth, n_predicted, f1). Each result is matched at most once, by time and key.

    Predictions come in the order of events, and each takes the first true result of its time and key, in their order,
    that is similar and not yet taken. Results of an analysis are unique by time and key; other results need not be.
    """
    names = [f"a{k}" for k in range(len(attributes))]

    def listed(df: DataFrame, name: str) -> DataFrame:
        values = F.struct("seq", "dup_path", *[q(a).alias(n) for n, a in zip(names, attributes, strict=True)])
        return df.groupBy("ts", "key").agg(F.array_sort(F.collect_list(values)).alias(name))

    def take(state: Column, made: Column) -> Column:
        ok = lambda true: reduce(Column.__and__, [similar(true[n], made[n], tolerance) for n in names], F.lit(True))
        first = F.array_position(F.transform(state["left"], ok), F.lit(True))  # from 1 on, 0 if there is none
        return F.struct(F.filter(state["left"], lambda _, k: k + 1 != first).alias("left"), (state["n"] + (first > 0).cast("bigint")).alias("n"))

    both = listed(truth, "true").join(listed(predicted, "made"), ["ts", "key"])
    start = F.struct(F.col("true").alias("left"), F.lit(0).cast("bigint").alias("n"))
    counts = both.agg(F.coalesce(F.sum(F.aggregate("made", start, take, lambda state: state["n"])), F.lit(0)).alias("matched"))
    counts = counts.join(truth.agg(F.count("*").alias("n_truth"))).join(predicted.agg(F.count("*").alias("n_predicted")))
    total = F.col("n_truth") + F.col("n_predicted")
    return counts.withColumn("f1", F.when(F.col("matched") == 0, F.lit(0.0)).otherwise(2.0 * F.col("matched") / total))


def results_similarity(truth: DataFrame, predicted: DataFrame, attributes: tuple[str, ...], tolerance: float) -> float:
    return float(f1_counts(truth, predicted, attributes, tolerance).first()["f1"])
