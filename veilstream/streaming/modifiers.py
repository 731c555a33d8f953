"""Modifiers on a stream that arrives. Filters, duplicates and noise are the batch expressions themselves; the two
modifiers with state over the whole stream carry it from one micro-batch to the next, in the order of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilstream.functions.draws import uniform
from veilstream.operators.modifiers import apply_duplicate, apply_filter, apply_noise
from veilstream.plans.ir import Aggregate, Duplicate, Filter, MovingAggregate, Noise, Pipeline, RandomInRange


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["seq", "dup_path"], kind="stable")


def stateful_aggregate(stream: DataFrame, node: MovingAggregate) -> DataFrame:
    """The last valid values are the state; it has one group, as the operator's meaning is one order over all events."""
    name, back = node.attribute, node.window

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(batches)
        kept = list(state.get[0]) if state.exists else []
        valid = rows[name].notna()
        values = pd.Series([*kept, *rows.loc[valid, name]])
        rolled = getattr(values.rolling(back, min_periods=1), {Aggregate.AVG: "mean", Aggregate.MIN: "min", Aggregate.MAX: "max"}[node.function])()
        rows.loc[valid, name] = rolled.iloc[len(kept) :].to_numpy()
        state.update((values.iloc[-(back - 1) :].tolist() if back > 1 else [],))
        yield rows

    return _one_group(stream, step, "kept array<double>")


def stateful_random_in_range(stream: DataFrame, node: RandomInRange, salt: str) -> DataFrame:
    name = node.attribute
    drawn = stream.withColumn("__u", uniform(salt))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(batches)
        low, high = state.get if state.exists else (float("inf"), float("-inf"))
        valid = rows[name].notna()
        lows, highs = rows.loc[valid, name].cummin().clip(upper=low), rows.loc[valid, name].cummax().clip(lower=high)
        rows.loc[valid, name] = lows + rows.loc[valid, "__u"] * (highs - lows)
        if valid.any():
            state.update((float(lows.iloc[-1]), float(highs.iloc[-1])))
        yield rows

    return _one_group(drawn, step, "low double, high double").drop("__u")


def _one_group(stream: DataFrame, step, state: str) -> DataFrame:
    out = stream.withColumn("__all", F.lit(1))
    schema = out.schema
    return out.groupBy("__all").applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout).drop("__all")


def run_pipeline_stream(stream: DataFrame, pipeline: Pipeline, seed: int = 0) -> DataFrame:
    for number, node in enumerate(pipeline.nodes):
        salt = f"{seed}/{number}"
        if isinstance(node, Filter):
            stream = apply_filter(stream, node)
        elif isinstance(node, Duplicate):
            stream = apply_duplicate(stream, node, salt)
        elif isinstance(node, Noise):
            stream = apply_noise(stream, node, salt)
        elif node.attribute in stream.columns:
            stream = stateful_random_in_range(stream, node, salt) if isinstance(node, RandomInRange) else stateful_aggregate(stream, node)
    return stream
