"""Operators on the redo log: numbering, chains, groups, indexes.  Each is DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entry_bytes, overflows
from ..schema import Corruption
from ..sources.shared import written
from .order import by_crowd, with_position, with_running, with_running_sum


def assign_lsns(writes: DataFrame, next_lsn: int = 1, order: list[str] | None = None) -> DataFrame:
    """Consecutive LSNs in batch order."""
    return with_position(writes, order or ["batch_id", "pos"], "lsn", next_lsn)


def link_previous(log: DataFrame, compat: bool = False) -> DataFrame:
    """prev_lsn: the LSN before on the same page, 0 if none.

    ``compat`` takes the page's latest LSN as of the start of the batch, so that of several records of a page
    in a batch only the last one can be reached.
    """
    log = log.drop("prev_lsn")
    if not compat:
        return with_running(log, ["lsn"], {"prev_lsn": ("max", "lsn")}, ["page_id"], before=True).withColumn("prev_lsn", F.coalesce("prev_lsn", F.lit(0)))
    # Small pages are dealt once and sorted once: a record takes what its batch's first record finds before it.
    small, large = by_crowd(log, ["page_id"])
    before = F.expr("max(lsn) over (partition by page_id order by batch_id, lsn rows between unbounded preceding and 1 preceding)")
    linked = small.withColumn("_before", before).withColumn("prev_lsn", F.expr("first(_before) over (partition by page_id, batch_id order by lsn)")).drop("_before")
    if large is not None:
        batches = large.groupBy("page_id", "batch_id").agg(F.max("lsn").alias("_top"))
        heads = with_running(batches, ["batch_id"], {"prev_lsn": ("max", "_top")}, ["page_id"], before=True).drop("_top")
        linked = linked.unionByName(large.join(heads, ["page_id", "batch_id"]))
    return linked.withColumn("prev_lsn", F.coalesce("prev_lsn", F.lit(0)))


def mark_ends(writes: DataFrame) -> DataFrame:
    """is_mtr_end: the last record of each batch."""
    last = writes.groupBy("batch_id").agg(F.max("pos").alias("_last"))
    return writes.join(last, "batch_id").withColumn("is_mtr_end", F.col("pos") == F.col("_last")).drop("_last")


def mtr_groups(log: DataFrame) -> DataFrame:
    """group_no: one more than the end flags before the record; groups by prefix, as recovery sees them."""
    ended = with_running_sum(log.withColumn("_end", F.col("is_mtr_end").cast("long")), ["lsn"], "_end", "_ends")
    return ended.withColumn("group_no", F.col("_ends") - F.col("_end") + 1).drop("_end", "_ends")


def rejected_writes(writes: DataFrame) -> DataFrame:
    """The writes that do not fit their page; one of them rejects its whole batch."""
    return writes.where(overflows(F.col("offset"), F.col("data")))


def accepted_writes(writes: DataFrame) -> DataFrame:
    return writes.join(rejected_writes(writes).select("batch_id").distinct(), "batch_id", "left_anti")


def page_index(log: DataFrame, lsn: int | None = None) -> DataFrame:
    """(page_id, latest_lsn), up to an LSN."""
    seen = log if lsn is None else log.where(F.col("lsn") <= lsn)
    return seen.groupBy("page_id").agg(F.max("lsn").alias("latest_lsn"))


def reachable(log: DataFrame) -> DataFrame:
    """The records that compat chains reach: the last of each page and batch."""
    last = log.groupBy("page_id", "batch_id").agg(F.max("lsn").alias("lsn"))
    return log.join(last, ["page_id", "batch_id", "lsn"], "left_semi")


def lost_writes(log: DataFrame) -> DataFrame:
    """The records that compat chains do not reach."""
    last = log.groupBy("page_id", "batch_id").agg(F.max("lsn").alias("_last"))
    return log.join(last, ["page_id", "batch_id"]).where("lsn < _last").drop("_last")


def chain(log: DataFrame, page_id: int, lsn: int) -> DataFrame:
    """A page's records up to an LSN: what the chain walk returns, as a filter."""
    return log.where((F.col("page_id") == page_id) & (F.col("lsn") <= lsn))


def chain_walk(log: DataFrame) -> DataFrame:
    """(lsn, page_id, depth, first_lsn) of every record: how many records its links lead through, itself included, and to which they come at last.

    All chains are followed at once, by doubling: each round joins every pointer that has not arrived with the one it
    points to, so a chain of n links takes log n joins on the LSN, which no two records share.  A link to a record
    that is not there, or is of another page, is an error (``Corruption``).
    """
    bad = broken_links(log).first()
    if bad:
        raise Corruption(f"record {bad['lsn']} of page {bad['page_id']} follows record {bad['prev_lsn']}, which is not there")
    walk = written(log.select("lsn", "page_id", F.col("prev_lsn").alias("to"), F.lit(1).cast("long").alias("depth"), F.col("lsn").alias("first_lsn")), "walk")
    while not (open_ := walk.where("to <> 0")).isEmpty():
        step = walk.select(F.col("lsn").alias("_at"), F.col("to").alias("_to"), F.col("depth").alias("_depth"), F.col("first_lsn").alias("_first"))
        moved = open_.join(step, F.col("to") == F.col("_at")).select("lsn", "page_id", F.col("_to").alias("to"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_first").alias("first_lsn"))
        walk = written(moved.union(walk.where("to = 0")), "walk")
    return walk.select("lsn", "page_id", "depth", "first_lsn")


def chain_lengths(log: DataFrame) -> DataFrame:
    return log.groupBy("page_id").agg(F.count("*").alias("chain_len"), F.max("lsn").alias("latest_lsn"))


def broken_links(log: DataFrame) -> DataFrame:
    """Records whose prev_lsn names no record of their page."""
    held = log.select(F.col("lsn").alias("prev_lsn"), "page_id")
    return log.where("prev_lsn <> 0").join(held, ["page_id", "prev_lsn"], "left_anti")


def batch_bytes(log: DataFrame) -> DataFrame:
    return log.groupBy("batch_id").agg(F.sum(entry_bytes(F.col("data"))).alias("bytes"), F.count("*").alias("records"))
