"""Pages as views of the log: snapshots, versions, differences, as-of reads."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ..functions.columns import overflows, zero_page
from ..schema import PAGE_SIZE
from ..sources.shared import written
from . import order
from .order import with_position, with_running

LINE = 64
#: Images that a task of as-of reads hands over at a time.
IMAGE_ROWS = 256


def checked(log: DataFrame) -> DataFrame:
    """The log, failing on a record that does not fit its page."""
    error = F.raise_error(F.format_string("page %d: record %d exceeds the page", "page_id", "lsn"))
    return log.withColumn("offset", F.when(overflows(F.col("offset"), F.col("data")), error.cast("int")).otherwise(F.col("offset")))


def winning_bytes(log: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, byte): the byte written last at each place, as two hex digits.

    A maximum by LSN, so it aggregates before the shuffle: a page with a third of all records costs no task
    more than its 8192 bytes.
    """
    at = F.posexplode(F.expr("filter(split(hex(data), '(?<=\\\\G..)'), x -> x <> '')")).alias("i", "byte")
    wide = log.select(*keys, "lsn", "offset", at)
    return wide.select(*keys, "lsn", (F.col("offset") + F.col("i")).alias("place"), "byte").groupBy(*keys, "place").agg(F.max_by("byte", "lsn").alias("byte"))


def _lines(winners: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lines): winning bytes as a map of maps, line of 64 bytes and place in it, so that no group is large."""
    line = winners.groupBy(*keys, F.floor(F.col("place") / LINE).cast("int").alias("line")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("place") % LINE).cast("int").alias("k"), "byte"))).alias("m"))
    return line.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("line", "m"))).alias("lines"))


def _laid(old: str | None = None) -> Column:
    """The page of ``lines`` laid on an image (a binary column ``old``), or on zeroes; a line without bytes is taken as it is."""
    some = lambda at, n: f"coalesce(hex(substring({old}, {at} + 1, {n})), '{'00' * n}')" if old else f"'{'00' * n}'"
    line = f"array_join(transform(sequence(0, {LINE - 1}), j -> coalesce(lines[i][j], {some(f'i * {LINE} + j', 1)})), '')"
    return F.unhex(F.expr(f"array_join(transform(sequence(0, {PAGE_SIZE // LINE - 1}), i -> if(lines[i] is null, {some(f'i * {LINE}', LINE)}, {line})), '')"))


def assembled(winners: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page) from winning bytes."""
    return _lines(winners, keys).select(*keys, _laid().alias("page"))


def snapshot(log: DataFrame, read_point: int, base: DataFrame | None = None, base_lsn: int = 0) -> DataFrame:
    """(page_id, read_point, page, chain_len, last_lsn) of every page with a record up to ``read_point``.

    ``base`` has (page_id, page, chain_len, last_lsn) as of ``base_lsn`` <= read_point; then only later records are read,
    and laid on the images of their pages. Images without later records stay as they are.
    """
    seen = checked(log.where((F.col("lsn") <= read_point) & (F.col("lsn") > base_lsn)).select("page_id", "lsn", "offset", "data"))
    chains = seen.groupBy("page_id").agg(F.count("*").alias("chain_len"), F.max("lsn").alias("last_lsn"))
    new = chains.join(_lines(winning_bytes(seen, ["page_id"]), ["page_id"]), "page_id", "left")
    page = F.when(F.col("lines").isNull(), zero_page()).otherwise(_laid())
    if base is not None:
        was = base.select("page_id", F.col("page").alias("_page"), F.col("chain_len").alias("_len"), F.col("last_lsn").alias("_lsn"))
        new = new.join(was, "page_id", "full_outer").withColumns({"chain_len": F.coalesce("chain_len", F.lit(0)) + F.coalesce("_len", F.lit(0)), "last_lsn": F.coalesce("last_lsn", "_lsn")})
        page = F.when(F.col("lines").isNull(), F.coalesce("_page", zero_page())).otherwise(_laid("_page"))
    return new.select("page_id", F.lit(read_point).cast("long").alias("read_point"), page.alias("page"), "chain_len", "last_lsn")


def fold_snapshot(log: DataFrame, read_point: int) -> DataFrame:
    """(page_id, page) by replaying each page's records in order; for short chains, whose records fit a task."""
    seen = checked(log.where(F.col("lsn") <= read_point))
    page = F.aggregate(F.array_sort(F.collect_list(F.struct("lsn", "offset", "data"))), zero_page(), lambda acc, x: F.overlay(acc, x["data"], x["offset"] + 1, F.octet_length(x["data"])))
    return seen.groupBy("page_id").agg(page.alias("page"))


def version_history(log: DataFrame) -> DataFrame:
    """(page_id, version, lsn, valid_until): the LSN interval in which each version of a page is the latest."""
    rows = with_position(log.select("page_id", "lsn"), ["lsn"], "version", keys=["page_id"]).withColumn("_back", -F.col("lsn"))
    return with_running(rows, ["_back"], {"valid_until": ("last", "lsn")}, ["page_id"], before=True).select("page_id", "version", "lsn", "valid_until")


def page_diff(log: DataFrame, before: int, after: int) -> DataFrame:
    """(page_id, place, old_byte, new_byte) of the bytes that differ between two read points; hex."""
    old = winning_bytes(log.where(F.col("lsn") <= before), ["page_id"]).withColumnRenamed("byte", "old")
    new = winning_bytes(log.where((F.col("lsn") <= after) & (F.col("lsn") > before)), ["page_id"]).withColumnRenamed("byte", "new")
    both = new.join(old, ["page_id", "place"], "left").select("page_id", F.col("place").cast("long").alias("place"), F.coalesce("old", F.lit("00")).alias("old_byte"), F.col("new").alias("new_byte"))
    return both.where("old_byte <> new_byte")


def _asked(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Records and requests of a page in one order: (page_id, at, is_request, req_id, read_point, lsn), a request after the records it sees."""
    records = log.select("page_id", F.col("lsn").alias("at"), F.lit(0).alias("is_request"), F.lit(None).cast(requests.schema["req_id"].dataType).alias("req_id"), F.lit(None).cast("long").alias("read_point"), "lsn")
    asked = requests.select("page_id", F.col("read_point").alias("at"), F.lit(1).alias("is_request"), "req_id", F.col("read_point").cast("long").alias("read_point"), F.lit(None).cast("long").alias("lsn"))
    return records.union(asked)


def read_status(requests: DataFrame, log: DataFrame, vdl: int) -> DataFrame:
    """(req_id, page_id, read_point, last_lsn, chain_len, status) of versioned reads: ok, not_found or beyond_durable.

    Requests meet no records: both stand in one order, and the records before a request are a running count and maximum.
    """
    both = with_running(_asked(requests, log), ["at", "is_request"], {"last_lsn": ("max", "lsn"), "chain_len": ("sum", "1L - is_request")}, ["page_id"])
    beyond = F.col("read_point") > vdl
    found = both.where("is_request = 1").select(
        "req_id", "page_id", "read_point", F.when(~beyond, F.col("last_lsn")).alias("last_lsn"), F.when(beyond, F.lit(0)).otherwise(F.col("chain_len")).cast("long").alias("chain_len")
    )
    return found.withColumn("status", F.when(beyond, "beyond_durable").when(F.col("chain_len") == 0, "not_found").otherwise("ok"))


def asof_reads(requests: DataFrame, log: DataFrame, vdl: int) -> DataFrame:
    """(req_id, page_id, read_point, page) of the requests that succeed.

    Records and requests of a page are replayed in one order: a record goes into the page's image, a request takes the
    image as it stands.  Only the order is shuffled, no image is, and a task holds one image and a batch of results.
    Pages with more than RANGE_ROWS records and requests are replayed by ranges, each from what the ranges before left.
    """
    kinds = {c: requests.schema[c].dataType for c in ("req_id", "page_id", "read_point")}
    # A record comes before the requests at its LSN; these are in any order, so that many for one read point need not be in one range.
    records = checked(log.where(F.col("lsn") <= vdl).select("page_id", "lsn", "offset", "data")).select(
        F.col("page_id").cast(kinds["page_id"]).alias("page_id"), F.col("lsn").cast("long").alias("at"), F.lit(-1).alias("turn"), "offset", "data", F.lit(None).cast(kinds["req_id"]).alias("req_id")
    )
    asked = requests.where(F.col("read_point") <= vdl).select(
        "page_id", F.col("read_point").cast("long").alias("at"), F.pmod(F.xxhash64("req_id"), F.lit(1000)).cast("int").alias("turn"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("binary").alias("data"), "req_id"
    )
    small, large = order.by_crowd(records.union(asked).where("page_id is not null"), ["page_id"])
    steps = small.withColumn("_range", F.lit(0))
    if large is not None:
        parts = -(-large.count() // order.RANGE_ROWS)
        large = large.withColumn("_range", order.range_of(large, ["at", "turn"], parts))
        steps = steps.union(large).unionByName(_left_before(large).withColumns({"at": F.lit(None).cast("long"), "turn": F.lit(-1), "req_id": F.lit(None).cast(kinds["req_id"])}))
    dealt = steps.repartition(int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), "page_id", "_range").sortWithinPartitions("page_id", "_range", F.asc_nulls_first("at"), "turn")
    schema = StructType([StructField("req_id", kinds["req_id"]), StructField("page_id", kinds["page_id"]), StructField("read_point", LongType()), StructField("page", BinaryType())])
    shown = dealt.select("page_id", "_range", "at", "turn", "offset", "data", "req_id").mapInArrow(_replayed, schema)
    return shown.withColumn("read_point", F.col("read_point").cast(kinds["read_point"]))


def _left_before(steps: DataFrame) -> DataFrame:
    """(page_id, _range, offset, data): what the records of a page's earlier ranges leave, as records of a byte; one without bytes tells that there were any."""
    records = steps.where("turn < 0").withColumnRenamed("at", "lsn")
    own = winning_bytes(records, ["page_id", "_range"])
    own = written(own.union(records.select("page_id", "_range", F.lit(-1).alias("place"), F.lit("").alias("byte")).distinct()), "ranges")
    # A row for each page, range and byte: windows of no more rows than there are ranges.
    grid = own.select("page_id", "place").distinct().join(steps.select("page_id", "_range").distinct(), "page_id").join(own, ["page_id", "_range", "place"], "left")
    left = F.expr("last(byte, true) over (partition by page_id, place order by _range rows between unbounded preceding and 1 preceding)")
    return grid.withColumn("byte", left).where("byte is not null").select("page_id", "_range", F.greatest("place", F.lit(0)).cast("int").alias("offset"), F.unhex("byte").alias("data"))


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(req_id, page_id, read_point, page) of steps sorted by page, range and place in the order."""
    own, image, still, out = None, None, None, []
    for batch in batches:
        req = batch.schema.field("req_id").type
        kinds = [req, batch.schema.field("page_id").type, pa.int64(), pa.binary()]
        made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["req_id", "page_id", "read_point", "page"])  # noqa: B023, E731
        for page, part, at, turn, offset, data, req_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if own != (page, part):
                own, image = (page, part), None
            if turn < 0:
                if image is None:
                    image = bytearray(PAGE_SIZE)
                if data:
                    data, offset = data[max(0, -offset) :], max(0, offset)
                    image[offset : offset + len(data)] = data
                still = None
            elif image is not None:
                still = still or bytes(image)
                out.append((req_id, page, at, still))
                if len(out) == IMAGE_ROWS:
                    yield made()
                    out = []
        if out:
            yield made()
            out = []
