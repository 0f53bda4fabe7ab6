"""Segments: greedy assignment, summaries, cooling, cost of cold reads."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import entry_bytes, segment_filename
from ..schema import HEADER_BYTES
from .order import range_of, with_running


#: Records of which a task holds the sizes at a time.
RANGE_RECORDS = 100_000


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], list(columns))


def _ranges(batches: Iterator[pa.RecordBatch], most: int = RANGE_RECORDS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, LSNs, sizes) of each range, from (range, lsn, size) rows sorted by range and LSN; a range of more than ``most``
    records comes in pieces of that many.  No more than one piece is held, and where pieces end does not depend on the batches."""
    own, held, lsns, sizes = None, 0, [], []
    for batch in batches:
        of, lsn, size = (c.to_numpy() for c in batch.columns)
        a = 0
        while a < len(of):
            if of[a] != own or held == most:
                if lsns:
                    yield own, np.concatenate(lsns), np.concatenate(sizes)
                own, held, lsns, sizes = int(of[a]), 0, [], []
            b = min(int(np.searchsorted(of, own, side="right")), a + most - held)
            lsns.append(lsn[a:b].copy())
            sizes.append(size[a:b].copy())
            held, a = held + b - a, b
    if lsns:
        yield own, np.concatenate(lsns), np.concatenate(sizes)


def _range(log: DataFrame, low: int, high: int, records: int, parts: int) -> Column:
    """The range of each record, by width; by quantiles where LSNs have gaps, since most records could fall into one range of a width."""
    if high - low < 2 * records:
        return F.floor((F.col("lsn") - low) / max(1, -(-(high - low + 1) // parts)))
    return range_of(log, ["lsn"], parts).cast("long")


def _next_starts(total: np.ndarray, most: int) -> np.ndarray:
    """For a segment that starts at each record of a range: where the next one starts (the number of records if not in the range)."""
    n = len(total) - 1
    return np.r_[np.maximum(np.searchsorted(total, total[:-1] + most, side="right") - 1, np.arange(n) + 1), n]


def _ends(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For a segment that starts at each record of a range: the rotations to the end of the range and the bytes in its last segment."""
    total = np.r_[0, np.cumsum(sizes)]
    n = len(sizes)
    to = _next_starts(total, most)
    turns, last = (to < n).astype(np.int64), np.where(to < n, to, np.arange(n + 1))
    while (open_ := to < n).any():  # jumps twice as long each time
        turns += np.where(open_, turns[to], 0)
        last = np.where(open_, last[to], last)
        to = to[to]
    return turns, total[n] - total[last]


def assign_segments(log: DataFrame, segment_bytes: int, first_id: int = 1, parts: int | None = None) -> DataFrame:
    """segment_id and file_offset of each record: a segment that is not empty and would grow beyond ``segment_bytes``
    is closed first; a larger record stands alone.

    Greedy filling is a chain from record to record, but what a range of records does to it depends on
    the bytes it finds open only up to its first new segment.  Each range works that out for itself,
    the driver chains a few numbers a range, and each range then assigns its records.
    """
    low, high, records = log.agg(F.min("lsn"), F.max("lsn"), F.count("lsn")).first()
    if low is None:
        return log.withColumn("segment_id", F.lit(first_id).cast("long")).withColumn("file_offset", F.lit(0).cast("long"))
    piece = RANGE_RECORDS
    by = _range(log, low, high, records, parts or max(1, -(-records // piece)))
    size = F.coalesce(entry_bytes(F.col("data")), F.lit(HEADER_BYTES).cast("long"))
    sized = log.where("lsn is not null").select(by.alias("range"), "lsn", size.alias("size"))
    dealt = sized.repartition("range").sortWithinPartitions("range", "lsn", "size")

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lsn, sizes in _ranges(batches, piece):
            total = np.r_[0, np.cumsum(sizes)]
            turns, left = _ends(sizes, segment_bytes)
            # With b bytes open, the first new segment starts at the first record i with b + total[i + 1] > most.
            first = np.arange(min(len(sizes), int(np.searchsorted(total, segment_bytes, side="right"))))
            yield _batch(begins=np.full(len(first), lsn[0]), fits=segment_bytes - total[first + 1], turns=turns[first] + 1, left=left[first], bytes=np.full(len(first), total[-1]))

    outlines = dealt.mapInArrow(outline, "begins long, fits long, turns long, left long, bytes long")
    segment, open_bytes, starts = first_id, 0, {}
    held = {}
    for row in outlines.collect():
        held.setdefault(row["begins"], []).append(row)
    for key in sorted(held):
        rows = held[key]
        starts[key] = segment, open_bytes
        # fits falls with the records: the first record that does not fit is the largest fits below the open bytes.
        over = [r for r in rows if r["fits"] < open_bytes]
        if open_bytes == 0:  # an empty segment takes its first record whatever its size
            own = max(rows, key=lambda r: r["fits"])
            segment, open_bytes = segment + own["turns"] - 1, own["left"]
        elif over:
            own = max(over, key=lambda r: r["fits"])
            segment, open_bytes = segment + own["turns"], own["left"]
        else:
            open_bytes += rows[0]["bytes"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lsn, sizes in _ranges(batches, piece):
            total = np.r_[0, np.cumsum(sizes)]
            segment, held = starts[int(lsn[0])]
            to = _next_starts(total, segment_bytes)
            begins = [int(np.searchsorted(total[1:], segment_bytes - held, side="right")) if held else int(to[0])]
            while begins[-1] < len(sizes):  # a step a segment
                begins.append(int(to[begins[-1]]))
            turn = np.searchsorted(np.array(begins), np.arange(len(sizes)), side="right")
            begin = np.r_[0, begins][turn]
            yield _batch(lsn=lsn, segment_id=segment + turn, file_offset=total[:-1] - total[begin] + np.where(turn == 0, held, 0))

    placed = dealt.mapInArrow(assign, "lsn long, segment_id long, file_offset long")
    return log.join(placed, "lsn")


def segment_table(placed: DataFrame) -> DataFrame:
    """The segments of a log with segment_id: all but the last are sealed; true first and last LSNs."""
    sums = placed.groupBy(F.col("segment_id").alias("id")).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.sum(entry_bytes(F.col("data"))).alias("size_bytes"))
    top = sums.agg(F.max("id").alias("top"))
    return sums.join(F.broadcast(top)).select("id", segment_filename(F.col("id")).alias("filename"), F.lit("Hot").alias("tier"), "first_lsn", "last_lsn", "size_bytes", (F.col("id") < F.col("top")).alias("sealed"))


def cool(segments: DataFrame, keep_hot: int) -> DataFrame:
    """The segments with all sealed hot ones but the newest ``keep_hot`` made cold."""
    sealed_hot = F.expr("sealed and tier = 'Hot'")
    if keep_hot > 0:
        oldest_kept = segments.where(sealed_hot).select("id").orderBy(F.desc("id")).limit(int(keep_hot)).agg(F.min("id"))
        sealed_hot &= F.coalesce(F.col("id") < oldest_kept.scalar(), F.lit(False))
    return segments.withColumn("tier", F.when(sealed_hot, "Cold").otherwise(F.col("tier")))


def cold_read_cost(placed: DataFrame, segments: DataFrame, read_point: int, latency_ms: int = 50) -> DataFrame:
    """(page_id, charges, cold_ms) of reading each page newest to oldest: a charge for each switch into a cold segment."""
    rows = placed.where(F.col("lsn") <= read_point).select("page_id", "segment_id", (-F.col("lsn")).alias("_back"))
    rows = with_running(rows, ["_back"], {"_from": ("last", "segment_id")}, ["page_id"], before=True)
    rows = rows.join(segments.select(F.col("id").alias("segment_id"), "tier"), "segment_id").withColumn("_charge", ((F.col("tier") == "Cold") & ~F.col("_from").eqNullSafe(F.col("segment_id"))).cast("long"))
    return rows.groupBy("page_id").agg(F.sum("_charge").alias("charges")).withColumn("cold_ms", F.col("charges") * latency_ms)


def iterate_sizes(sizes: Iterator[int], segment_bytes: int) -> Iterator[int]:
    """Segment numbers from 0 for a stream of entry sizes: the rule itself, for checks on small input."""
    segment = held = 0
    for s in sizes:
        if held and held + s > segment_bytes:
            segment, held = segment + 1, 0
        held += s
        yield segment
