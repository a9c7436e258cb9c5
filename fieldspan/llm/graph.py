"""Connected components as DataFrame operations, for any orderable node type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node, component (the smallest node reachable) of every node with an edge.

    Each round takes the least label among the neighbours and then jumps to that label's own
    label, so the rounds grow with the logarithm of a chain's length. Every round is written to
    the shared folder; a hot node is split by AQE's skew join, minima combine before the shuffle.
    No edges give an empty table; loops and repeated edges do no harm.
    """
    pairs = cut(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u <> v").union(edges.select(F.col(b), F.col(a)).where(F.col(a) != F.col(b)))
        .distinct(), "edges")
    # nobody needs a label from a larger neighbour at the start: the least neighbour is the first label
    state = cut(pairs.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (pairs.join(state.withColumnRenamed("node", "u"), "u")
                .groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near")))
        hooked = state.join(near, "node", "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        hooked = cut(hooked, "hooked")
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        new = cut(hooked.join(jump, "label", "left").select(
            "node", F.least("label", "jump").alias("label"),
            (F.least("label", "jump") != F.col("old")).alias("moved")), "labels")
        drop(hooked)
        drop(state)
        state = new
        if state.where("moved").limit(1).count() == 0:
            break
    drop(pairs)
    return state.select("node", F.col("label").alias("component"))
