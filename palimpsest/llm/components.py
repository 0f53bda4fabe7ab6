"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is one of its nodes.

    Each round, every node points to the neighbour (or itself) that comes first in an order
    drawn anew for the round, the edges are contracted along the pointers, and loops and
    repeats are dropped.  The number of nodes falls by a constant factor a round in
    expectation, whatever the graph, and a star of any size takes one shuffle with partial
    aggregation: no neighbour list is ever gathered.  No edges give no rows.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    labels = None
    for turn in range(64):
        if edges.isEmpty():
            break
        draw = lambda c: F.xxhash64(F.col(c), F.lit(turn))
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(draw("b").alias("r"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(draw("a").alias("r"), F.col("a").alias("v"))
        points = materialize(best.select(F.col("a").alias("node"), F.least(own, F.col("m")).getField("v").alias("to")), "points")
        hop = lambda c: points.select(F.col("node").alias(c), F.col("to").alias(f"{c}_to"))
        edges = materialize(
            edges.join(hop("a"), "a").join(hop("b"), "b").where("a_to <> b_to")
            .select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(),
            "edges",
        )
        if labels is None:
            labels = points.select("node", F.col("to").alias("component"))
        else:
            step = points.select(F.col("node").alias("component"), "to")
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    else:
        raise RuntimeError("the contraction did not end")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
