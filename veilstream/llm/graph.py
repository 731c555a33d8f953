"""Connected components by repeated contraction, without collecting links or labels anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.llm.common import discard, materialize


def connected(edges: DataFrame) -> DataFrame | None:
    """(node, label) for every node of edges (a, b): equal labels for connected nodes. None if there is no edge.

    Nodes are renamed by a hash that maps longs one to one, and labels are such names, so that nodes in a row along a chain
    come in no order and rounds grow with the logarithm of its length; a node without edges would have xxhash64(node).
    In each round every node takes its smallest neighbour (or itself) and, by one jump, that one's choice; edges are
    carried over to the labels, and those inside a label vanish. What was chosen before is carried along. Every round
    is a written table; the smallest neighbour is aggregated before the shuffle, so large stars are no hot spot.
    """
    labels: DataFrame | None = None
    edges = edges.where("a <> b").select(F.xxhash64(F.col("a").cast("bigint")).alias("a"), F.xxhash64(F.col("b").cast("bigint")).alias("b"), F.col("a").alias("node_a"), F.col("b").alias("node_b"))
    named = edges.select("a", F.col("node_a").alias("node")).union(edges.select("b", "node_b"))
    named = materialize(named.distinct().withColumnRenamed("a", "name"), "names")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        chosen = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "chosen")
        jump = chosen.select(F.col("node").alias("to"), F.col("to").alias("further"))
        chosen_twice = materialize(chosen.join(jump, "to").select("node", F.col("further").alias("to")), "jumped")
        discard(chosen)
        if labels is None:
            carried = chosen_twice.select("node", F.col("to").alias("label"))
        else:
            step = chosen_twice.select(F.col("node").alias("label"), "to")
            carried = materialize(labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        to_a, to_b = (chosen_twice.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}")) for c in "ab")
        moved = edges.join(to_a, "a").join(to_b, "b").where("to_a <> to_b")
        after = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        discard(edges)
        if labels is not None:
            discard(labels)
            discard(chosen_twice)
        else:
            carried._veil_path = chosen_twice._veil_path
        edges, labels = after, carried
    discard(edges)
    if labels is None:
        discard(named)
        return None
    out = materialize(labels.withColumnRenamed("node", "name").join(named, "name").select("node", "label"), "labels")
    discard(labels)
    discard(named)
    return out
