"""What readers see: each node's read point, how far behind it is, and which reads repeat one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import with_running


def staleness(steps: DataFrame) -> DataFrame:
    """(step, node, read_point, behind) for each get over (step, node, op, vdl): vdl is the log's after the step.

    A node's own puts and refreshes move its read point; behind is what the log is ahead of it.
    """
    rows = steps.select("step", "node", "op", "vdl", F.when(F.col("op").isin("put", "refresh"), F.col("vdl")).alias("_moved"))
    rows = with_running(rows, ["step"], {"read_point": ("last", "_moved")}, ["node"]).where("op = 'get'").withColumn("read_point", F.coalesce("read_point", F.lit(0)))
    return rows.select("step", "node", "read_point", (F.col("vdl") - F.col("read_point")).alias("behind"))


def repeated_reads(reads: DataFrame) -> DataFrame:
    """(step, page_id, read_point, hit): whether the same page at the same read point was read before."""
    first = reads.groupBy("page_id", "read_point").agg(F.min("step").alias("_first"))
    return reads.join(first, ["page_id", "read_point"]).select("step", "page_id", "read_point", (F.col("step") > F.col("_first")).alias("hit"))
