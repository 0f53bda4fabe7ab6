"""Watermarks and recovery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .log import page_index


def vcl(log: DataFrame) -> DataFrame:
    """(vcl): the greatest N with all LSNs from 1 to N present; 0 without LSN 1.

    The first gap ends at the smallest LSN of which the next is missing; an anti-join finds it without a
    global order.  Repeated LSNs count once.
    """
    lsns = log.select("lsn").where("lsn > 0")
    following = lsns.select((F.col("lsn") - 1).alias("lsn"))
    gap = lsns.join(following, "lsn", "left_anti").agg(F.min("lsn").alias("gap"))
    first = lsns.agg(F.min("lsn")).scalar()
    return gap.select(F.when(first == 1, F.col("gap")).otherwise(F.lit(0)).cast("long").alias("vcl"))


def durability(log: DataFrame) -> DataFrame:
    """(vcl, vdl): complete, and complete up to the end of a group. The VCL is a scalar subquery, a filter of the scan."""
    complete = vcl(log).scalar()
    ends = log.where("is_mtr_end").where(F.col("lsn") <= complete)
    return ends.agg(F.coalesce(F.max("lsn"), F.lit(0)).cast("long").alias("vdl")).select(complete.alias("vcl"), "vdl")


def live_state(log: DataFrame) -> DataFrame:
    """(vcl, vdl) as appends advance them: the last record, and the last end flag."""
    return log.agg(F.coalesce(F.max("lsn"), F.lit(0)).alias("vcl"), F.coalesce(F.max(F.when(F.col("is_mtr_end"), F.col("lsn"))), F.lit(0)).alias("vdl"))


@dataclass
class Recovered:
    log: DataFrame
    index: DataFrame
    vcl: int
    vdl: int
    truncated_rows: int


def recover(log: DataFrame) -> Recovered:
    """Survivors up to VDL, their page index, the watermarks before truncation, and the rows cut off."""
    state = durability(log).first()
    kept = log.where(F.col("lsn") <= state["vdl"])
    cut = log.where(F.col("lsn") > state["vdl"]).count()
    return Recovered(kept, page_index(kept), state["vcl"], state["vdl"], cut)


def truncation_point(log: DataFrame, vdl: int) -> DataFrame:
    """(segment_id, file_offset): the exact end of the last surviving entry."""
    end = F.col("file_offset") + F.col("entry_bytes")
    return log.where(F.col("lsn") <= vdl).agg(F.max(F.struct("segment_id", end.alias("end"))).alias("m")).select(F.coalesce("m.segment_id", F.lit(1)).alias("segment_id"), F.coalesce("m.end", F.lit(0)).alias("file_offset"))
