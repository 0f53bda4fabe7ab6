"""Event traces: parsing, metrics, and the state that events add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The kinds of events.
EVENT_KINDS = (
    "MtrCreated AssignLsns LinkPrevLsn WalAppend WalSync UpdatePageIndex UpdateLsnOffset AdvanceVcl AdvanceVdl UpdateReadPoint BufferPoolInvalidate "
    "BufferPoolLookup PageCacheLookup PageIndexLookup ChainWalkStep ChainCollected MaterializeApply MaterializeComplete PageCacheInsert BufferPoolInsert "
    "SegmentRotation ColdTierRead SegmentCooled StateSnapshot"
).split()


def parse_trace(lines: DataFrame) -> DataFrame:
    """(seq, timestamp_us, kind, fields) of NDJSON lines (value); an event is an object named by its kind, or the bare name."""
    raw = lines.select(F.from_json("value", "seq bigint, timestamp_us bigint, event string").alias("t")).select("t.*")
    obj = F.from_json("event", "map<string, string>")
    bare = F.when(F.col("event").startswith("{"), F.map_keys(obj)[0]).otherwise(F.regexp_replace("event", '"', ""))
    return raw.select("seq", "timestamp_us", bare.alias("kind"), F.when(F.col("event").startswith("{"), F.from_json(F.map_values(obj)[0], "map<string, string>")).alias("fields"))


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    return parse_trace(spark.read.text(path))


def write_trace(events: DataFrame, path: str) -> None:
    """(seq, timestamp_us, kind, fields) as NDJSON."""
    body = F.when(F.col("fields").isNull(), F.concat(F.lit('"'), "kind", F.lit('"'))).otherwise(F.concat(F.lit('{"'), "kind", F.lit('":'), F.to_json("fields"), F.lit("}")))
    line = F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"timestamp_us":'), F.col("timestamp_us").cast("string"), F.lit(',"event":'), body, F.lit("}"))
    events.select(line.alias("value")).write.text(path)


def metrics(events: DataFrame, after_seq: int = -1) -> DataFrame:
    """One row of counters over (seq, kind, fields); ``after_seq`` starts them anew.

    Writes are batches, reads are misses of the buffer pool, the hit ratio is a whole percentage cut down, 0 without lookups.
    """
    e = events.where(F.col("seq") > after_seq)
    of = lambda k: F.col("kind") == k
    hit = F.col("fields")["hit"] == "true"
    last = lambda k: F.coalesce(F.max_by(F.when(of(k), F.col("fields")["new"].cast("bigint")), F.when(of(k), F.col("seq"))), F.lit(0))
    sums = e.agg(
        F.count_if(of("WalAppend")).alias("writes"), F.coalesce(F.sum(F.when(of("WalAppend"), F.col("fields")["bytes"].cast("bigint"))), F.lit(0)).alias("bytes_written"),
        F.count_if(of("BufferPoolLookup") & ~hit).alias("reads"), F.count_if(of("BufferPoolLookup") & hit).alias("buffer_hits"), F.count_if(of("BufferPoolLookup") & ~hit).alias("buffer_misses"),
        F.count_if(of("PageCacheLookup") & hit).alias("cache_hits"), F.count_if(of("PageCacheLookup") & ~hit).alias("cache_misses"),
        F.count_if(of("MaterializeComplete")).alias("materializations"), last("AdvanceVcl").alias("vcl"), last("AdvanceVdl").alias("vdl"),
    )
    looked = F.col("cache_hits") + F.col("cache_misses")
    return sums.withColumn("cache_hit_percent", F.when(looked == 0, 0).otherwise(F.expr("100 * cache_hits div (cache_hits + cache_misses)")).cast("long")).withColumn("kb_written", F.expr("bytes_written div 1024"))


def events_by_kind(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def node_state(events: DataFrame) -> DataFrame:
    """(node, read_point, next_mtr, pages): each node's last read point and group number, and the pages its pool holds."""
    own = events.where(F.col("fields").isNotNull()).withColumn("node", F.col("fields")["node"]).where("node is not null")
    last = lambda k, f: F.max_by(F.when(F.col("kind") == k, F.col("fields")[f].cast("bigint")), F.when(F.col("kind") == k, F.col("seq")))
    points = own.groupBy("node").agg(F.coalesce(last("UpdateReadPoint", "new"), F.lit(0)).alias("read_point"), (F.coalesce(last("MtrCreated", "mtr_id"), F.lit(0)) + 1).alias("next_mtr"))
    pool = own.where(F.col("kind").isin("BufferPoolInsert", "BufferPoolInvalidate")).groupBy("node", F.col("fields")["page_id"].cast("bigint").alias("page_id")).agg(F.max_by("kind", "seq").alias("k"))
    held = pool.where("k = 'BufferPoolInsert'").groupBy("node").agg(F.count("*").alias("pages"))
    return points.join(held, "node", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))


def shared_state(events: DataFrame) -> DataFrame:
    """(vcl, vdl, log_bytes, pages): the log's state that the events of all nodes add up to."""
    of = lambda k: F.col("kind") == k
    value = lambda f: F.col("fields")[f].cast("bigint")
    last = lambda k: F.coalesce(F.max_by(F.when(of(k), value("new")), F.when(of(k), F.col("seq"))), F.lit(0))
    sums = events.agg(last("AdvanceVcl").alias("vcl"), last("AdvanceVdl").alias("vdl"), F.coalesce(F.sum(F.when(of("WalAppend"), value("bytes"))), F.lit(0)).alias("log_bytes"))
    pages = events.where(of("UpdatePageIndex")).select(value("page_id").alias("page_id")).distinct().agg(F.count("page_id").alias("pages"))
    return sums.select("vcl", "vdl", "log_bytes", pages.scalar().alias("pages"))


def indexed_pages(events: DataFrame) -> DataFrame:
    """(page_id, latest_lsn) of the index that the events leave, in the order of pages."""
    own = events.where("kind = 'UpdatePageIndex'").select(F.col("fields")["page_id"].cast("bigint").alias("page_id"), F.col("fields")["lsn"].cast("bigint").alias("lsn"), "seq")
    return own.groupBy("page_id").agg(F.max_by("lsn", "seq").alias("latest_lsn")).orderBy("page_id")


def tail(events: DataFrame, n: int = 15) -> DataFrame:
    return events.orderBy(F.desc("seq")).limit(n)
