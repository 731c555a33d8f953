"""The five modifiers. Two of them keep state over the whole interleaved stream, not per key; they run in blocks.

A block is a range of sequence numbers. Within a block a window function does the work; what a block needs from earlier
ones (running bounds, or the last few valid values) is gathered from one short summary of each block, so that no task
ever sees the whole stream. Each of the two reads its input twice; behind another one the input is written first, so that
the work of a pipeline grows with the number of its operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilstream.functions.draws import gaussian, uniform
from veilstream.plans.ir import Aggregate, Condition, Duplicate, Filter, MovingAggregate, Noise, Pipeline, RandomInRange, simplified
from veilstream.sources.scratch import written
from veilstream.sources.streams import q

BLOCK_BITS = 17


def value_of(stream: DataFrame, name: str) -> Column:
    """An attribute's column; an unknown attribute is missing everywhere."""
    return q(name) if name in stream.columns else F.lit(None).cast("double")


def with_value(stream: DataFrame, name: str, value: Column) -> DataFrame:
    return stream.withColumn(name, value) if name in stream.columns else stream


def apply_filter(stream: DataFrame, node: Filter) -> DataFrame:
    value = value_of(stream, node.attribute)
    return stream.where(value < node.value if node.condition is Condition.LT else value > node.value)


def apply_duplicate(stream: DataFrame, node: Duplicate, salt: str) -> DataFrame:
    """Each event, and right after it, with the given probability, a copy."""
    copies = F.when(uniform(salt) < node.probability, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("0")))
    names = [q(c) for c in stream.columns if c not in ("dup_path", "event_type")]
    out = stream.select("*", F.explode(copies).alias("__copy"))
    return out.select(
        *[c for c in names],
        F.concat("dup_path", "__copy").alias("dup_path"),
        F.when(F.col("__copy") == "1", "DUPLICATE").otherwise(F.col("event_type")).alias("event_type"),
    ).select(*[q(c) for c in stream.columns])


def apply_noise(stream: DataFrame, node: Noise, salt: str) -> DataFrame:
    return with_value(stream, node.attribute, value_of(stream, node.attribute) * (1.0 + node.percentage * gaussian(salt)))


def _blocked(stream: DataFrame, name: str, bits: int) -> DataFrame:
    return stream.withColumns({"__block": F.shiftright("seq", bits), "__v": value_of(stream, name)})


def apply_random_in_range(stream: DataFrame, node: RandomInRange, salt: str, bits: int = BLOCK_BITS) -> DataFrame:
    """A valid value becomes uniform between the smallest and the largest valid value so far, itself included."""
    if node.attribute not in stream.columns:
        return stream
    rows = _blocked(stream, node.attribute, bits)
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("__block").agg(F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    blocks = blocks.select("__block", F.min("lo").over(before).alias("__lo"), F.max("hi").over(before).alias("__hi"))
    so_far = Window.partitionBy("__block").orderBy("seq", "dup_path").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(blocks, "__block")
    low = F.least(F.min("__v").over(so_far), F.col("__lo"))
    high = F.greatest(F.max("__v").over(so_far), F.col("__hi"))
    rows = rows.withColumns({"__low": low, "__high": high})
    drawn = F.when(F.col("__v").isNotNull(), F.col("__low") + uniform(salt) * (F.col("__high") - F.col("__low")))
    return with_value(rows, node.attribute, drawn).select(*[q(c) for c in stream.columns])


def apply_moving_aggregate(stream: DataFrame, node: MovingAggregate, bits: int = BLOCK_BITS) -> DataFrame:
    """A valid value becomes the average, minimum or maximum of the last valid values, itself included; NULL stays."""
    if node.attribute not in stream.columns:
        return stream
    rows = _blocked(stream, node.attribute, bits).withColumn("__own", F.lit(True))
    back = node.window - 1
    if back:  # each block gets the last valid values before it: a few rows of each block, in order
        latest = Window.partitionBy("__block").orderBy(F.desc("seq"), F.desc("dup_path"))
        valid = _blocked(stream, node.attribute, bits).where("__v is not null").select("__block", "seq", "dup_path", "__v")
        tails = valid.withColumn("r", F.row_number().over(latest)).where(F.col("r") <= back)
        order = Window.orderBy("__block", "seq", "dup_path")
        tails = tails.withColumns({"before": F.collect_list(F.struct("seq", "dup_path", "__v")).over(order.rowsBetween(-back, -1)), "last": F.lag("__block").over(order)})
        carried = tails.where("last <> __block").select("__block", F.inline("before"))
        rows = rows.unionByName(carried.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    valid_rows = Window.partitionBy("__block", F.col("__v").isNull()).orderBy("seq", "dup_path").rowsBetween(-back, 0)
    made = {Aggregate.AVG: F.avg, Aggregate.MIN: F.min, Aggregate.MAX: F.max}[node.function](F.col("__v")).over(valid_rows)
    rows = rows.withColumn("__new", made).where("__own")
    return with_value(rows, node.attribute, F.col("__new")).select(*[q(c) for c in stream.columns])


def run_pipeline(stream: DataFrame, pipeline: Pipeline, seed: int = 0, bits: int = BLOCK_BITS) -> DataFrame:
    """The modified stream. Draws are salted with the seed and the operator's number."""
    _, nothing = simplified(pipeline)
    if nothing:
        return stream.where(F.lit(False))
    out, stateful = stream, False
    for number, node in enumerate(pipeline.nodes):
        salt = f"{seed}/{number}"
        if isinstance(node, RandomInRange | MovingAggregate):
            out, stateful = written(out, "stream") if stateful else out, True
        if isinstance(node, Filter):
            out = apply_filter(out, node)
        elif isinstance(node, Duplicate):
            out = apply_duplicate(out, node, salt)
        elif isinstance(node, Noise):
            out = apply_noise(out, node, salt)
        elif isinstance(node, RandomInRange):
            out = apply_random_in_range(out, node, salt, bits)
        elif isinstance(node, MovingAggregate):
            out = apply_moving_aggregate(out, node, bits)
    return out
