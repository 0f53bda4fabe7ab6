"""Registered queries over redo logs that Spark derives from the given tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import durability, log, pages, reads, segments, trace
from ..operators.order import with_position
from ..sources.derived import events_log, events_stream, lineitem_writes, linked_events_log
from ..sources.shared import written
from ..sources.wal import decode_segments, encode_segments
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WRITTEN = 136  # bytes of a page that the derived log can write; the oracle knows that the rest is zeroes
SEGMENT = 4096

REDO = """WITH redo AS (
  SELECT event_id + 1 AS lsn, user_id AS page_id, CAST((event_id % 16) * 8 AS INTEGER) AS "offset", event_type AS data, octet_length(encode(event_type)) AS n,
    event_id // 4 + 1 AS batch_id, event_id % 4 = 3 AS is_mtr_end, CASE WHEN event_id % 3 = 0 THEN 'B' ELSE 'A' END AS node FROM events)"""
IMAGES = """, b AS (SELECT r.*, unnest(range(n)) AS i FROM {log} r),
w AS (SELECT {keys}, "offset" + i AS place, arg_max(substr(hex(encode(data)), CAST(2 * i + 1 AS BIGINT), 2), lsn) AS byte FROM b GROUP BY ALL),
k AS (SELECT DISTINCT {keys} FROM {log}), z AS (SELECT k.*, unnest(range(136)) AS place FROM k),
hexed AS (SELECT {keys}, string_agg(coalesce(byte, '00'), '' ORDER BY place) AS page_prefix FROM z LEFT JOIN w USING ({keys}, place) GROUP BY {keys}),
img AS (SELECT {keys}, page_prefix, sha256(unhex(page_prefix || repeat('00', 8056))) AS page_sha256 FROM hexed)"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _middle(spark: SparkSession, d: str) -> int:
    """Half the log's durable LSN."""
    return (spark.read.parquet(f"{d}/events.parquet").agg(F.max("event_id")).first()[0] + 1) // 2


MID = "(SELECT (max(event_id) + 1) // 2 FROM events)"


def _prefix(df: DataFrame) -> DataFrame:
    """The page's written bytes in hex, and the hash of all its 8192 bytes."""
    return df.withColumns({"page_prefix": F.hex(F.substring("page", 1, WRITTEN)), "page_sha256": F.sha2("page", 256)}).drop("page")


# Filters and projections


@query(f"{REDO} SELECT lsn, page_id, \"offset\", hex(encode(data)) AS data_hex FROM redo WHERE lsn > {MID} // 2 AND lsn <= {MID}")
def log_scan_filter(spark, d):
    mid = _middle(spark, d)
    return events_log(spark, d).where((F.col("lsn") > mid // 2) & (F.col("lsn") <= mid)).select("lsn", "page_id", "offset", F.hex("data").alias("data_hex"))


@query(f"{REDO} SELECT lsn, 41 + n AS bytes FROM redo")
def entry_sizes(spark, d):
    return events_log(spark, d).select("lsn", C.entry_bytes(F.col("data")).alias("bytes"))


@query(f"{REDO} SELECT batch_id, sum(41 + n)::BIGINT AS bytes, count(*) AS records FROM redo GROUP BY 1")
def bytes_per_mtr(spark, d):
    return log.batch_bytes(events_log(spark, d))


@query("SELECT page_id, 0 AS \"offset\", octet_length(encode(html)) AS length FROM pages WHERE octet_length(encode(html)) > 8192")
def overflow_writes(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("batch_id"), "page_id", F.lit(0).alias("offset"), F.col("html").cast("binary").alias("data"))
    return log.rejected_writes(p).select("page_id", "offset", F.octet_length("data").alias("length"))


@query("SELECT page_id FROM pages WHERE octet_length(encode(html)) <= 8192")
def accepted_batches(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").alias("batch_id"), "page_id", F.lit(0).alias("offset"), F.col("html").cast("binary").alias("data"))
    return log.accepted_writes(p).select("page_id")


# Numbering, chains, groups

ITEMS = """WITH li AS (SELECT l_orderkey AS batch_id, l_suppkey AS page_id, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS lsn FROM lineitem)"""
ITEM_ORDER = ["batch_id", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]


def _items(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a numbered log, at rest as logs are."""
    return written(log.assign_lsns(lineitem_writes(spark, d), 1, ITEM_ORDER).select("lsn", "batch_id", "page_id"), "items")


@query(f"{ITEMS} SELECT batch_id, page_id, lsn FROM li")
def assign_lsn(spark, d):
    return log.assign_lsns(lineitem_writes(spark, d), 1, ITEM_ORDER).select("batch_id", "page_id", "lsn")


@query(f"{ITEMS} SELECT lsn, page_id, coalesce(lag(lsn) OVER (PARTITION BY page_id ORDER BY lsn), 0) AS prev_lsn FROM li")
def prev_lsn_strict(spark, d):
    return log.link_previous(_items(spark, d)).select("lsn", "page_id", "prev_lsn")


@query(f"{ITEMS} SELECT lsn, page_id, coalesce(max(lsn) OVER (PARTITION BY page_id ORDER BY batch_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_lsn FROM li")
def prev_lsn_compat(spark, d):
    return log.link_previous(_items(spark, d), compat=True).select("lsn", "page_id", "prev_lsn")


@query(f"{ITEMS} SELECT lsn, batch_id, page_id FROM li QUALIFY lsn < max(lsn) OVER (PARTITION BY batch_id, page_id)")
def lost_writes_compat(spark, d):
    return log.lost_writes(_items(spark, d)).select("lsn", "batch_id", "page_id")


@query(f"{ITEMS} SELECT lsn, batch_id, lsn = max(lsn) OVER (PARTITION BY batch_id) AS is_mtr_end FROM li")
def mark_cpl(spark, d):
    return log.mark_ends(_items(spark, d).withColumn("pos", F.col("lsn"))).select("lsn", "batch_id", "is_mtr_end")


@query(f"{REDO} SELECT lsn, 1 + coalesce(sum(is_mtr_end::INT) OVER (ORDER BY lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS group_no FROM redo")
def mtr_groups(spark, d):
    return log.mtr_groups(events_log(spark, d)).select("lsn", "group_no")


@query(f"{REDO} SELECT node, lsn, row_number() OVER (PARTITION BY node ORDER BY lsn) AS mtr_id FROM redo WHERE is_mtr_end")
def mtr_numbering(spark, d):
    return with_position(events_log(spark, d).where("is_mtr_end").select("node", "lsn"), ["lsn"], "mtr_id", keys=["node"])


@query(f"{REDO} SELECT page_id, max(lsn) AS latest_lsn FROM redo GROUP BY 1")
def page_index(spark, d):
    return log.page_index(events_log(spark, d))


@query(f"{REDO} SELECT page_id, max(lsn) AS latest_lsn FROM redo WHERE lsn <= {MID} GROUP BY 1")
def page_index_at_lsn(spark, d):
    return log.page_index(events_log(spark, d), _middle(spark, d))


@query(f"{REDO} SELECT page_id, count(*) AS chain_len, max(lsn) AS latest_lsn FROM redo GROUP BY 1")
def chain_lengths(spark, d):
    return log.chain_lengths(events_log(spark, d))


@query(f"{REDO} SELECT page_id, lsn, row_number() OVER (PARTITION BY page_id ORDER BY lsn) AS place FROM redo WHERE lsn <= {MID}")
def chain_lsns(spark, d):
    """Every page's chain from its oldest record on, a row a record."""
    e = events_log(spark, d).where(F.col("lsn") <= _middle(spark, d)).select("page_id", "lsn")
    return with_position(e, ["lsn"], "place", keys=["page_id"])


@query(f"{REDO} SELECT lsn, page_id, row_number() OVER (PARTITION BY page_id ORDER BY lsn) AS depth, min(lsn) OVER (PARTITION BY page_id) AS first_lsn FROM redo")
def chain_recursive(spark, d):
    """All chains by their links alone."""
    return log.chain_walk(linked_events_log(spark, d))


@query(f"{REDO}, c AS (SELECT lsn, node, coalesce(lag(lsn) OVER (PARTITION BY page_id ORDER BY lsn), 0) AS prev_lsn FROM redo) SELECT c.lsn, c.prev_lsn FROM c JOIN redo p ON p.lsn = c.prev_lsn WHERE c.node = 'A' AND p.node = 'B'")
def chain_integrity(spark, d):
    """The links that break when one node's records are lost."""
    return log.broken_links(linked_events_log(spark, d).where("node = 'A'")).select("lsn", "prev_lsn")


# Durability and recovery

GAP = "(SELECT (max(event_id) + 1) * 3 // 4 FROM events)"


def _gapped(spark: SparkSession, d: str) -> DataFrame:
    e = events_log(spark, d)
    return e.where(F.col("lsn") != _middle(spark, d) * 2 * 3 // 4)


STATE = "SELECT vcl, coalesce((SELECT max(lsn) FROM {t} WHERE is_mtr_end AND lsn <= vcl), 0) AS vdl FROM (SELECT coalesce(max(lsn), 0) AS vcl FROM (SELECT lsn, row_number() OVER (ORDER BY lsn) AS r FROM {t}) WHERE lsn = r)"


@query(f"{REDO} SELECT coalesce(max(lsn), 0) AS vcl FROM (SELECT lsn, row_number() OVER (ORDER BY lsn) AS r FROM redo) WHERE lsn = r")
def vcl(spark, d):
    return durability.vcl(events_log(spark, d))


@query(f"{REDO} {STATE.format(t='redo')}")
def vdl(spark, d):
    return durability.durability(events_log(spark, d))


@query(f"{REDO} SELECT max(lsn) AS vcl, max(lsn) FILTER (WHERE is_mtr_end) AS vdl FROM redo")
def live_watermarks(spark, d):
    return durability.live_state(events_log(spark, d))


@query(f"{REDO}, g AS (SELECT * FROM redo WHERE lsn <> {GAP}) {STATE.format(t='g')}")
def vcl_with_gap(spark, d):
    return durability.durability(_gapped(spark, d))


@query(f"{REDO}, g AS (SELECT * FROM redo WHERE lsn < (SELECT max(lsn) - 1 FROM redo)) {STATE.format(t='g')}")
def vdl_incomplete_tail(spark, d):
    e = events_log(spark, d)
    return durability.durability(e.where(F.col("lsn") < _middle(spark, d) * 2 - 1))


@query(f"{REDO}, g AS (SELECT * FROM redo WHERE lsn <> {GAP}), s AS ({STATE.format(t='g')}) SELECT lsn, page_id FROM g WHERE lsn <= (SELECT vdl FROM s)")
def recovered_log(spark, d):
    return durability.recover(_gapped(spark, d)).log.select("lsn", "page_id")


@query(f"{REDO}, g AS (SELECT * FROM redo WHERE lsn <> {GAP}), s AS ({STATE.format(t='g')}) SELECT page_id, max(lsn) AS latest_lsn FROM g WHERE lsn <= (SELECT vdl FROM s) GROUP BY 1")
def recovered_index(spark, d):
    return durability.recover(_gapped(spark, d)).index


# Pages


@query(f"{REDO}, l AS (SELECT * FROM redo WHERE lsn <= {MID}){IMAGES.format(log='l', keys='page_id')} SELECT page_id, {MID} AS read_point, page_prefix, page_sha256, count(*) AS chain_len, max(lsn) AS last_lsn FROM img JOIN l USING (page_id) GROUP BY ALL")
def page_snapshot_at(spark, d):
    return _prefix(pages.snapshot(events_log(spark, d), _middle(spark, d)))


@query(f"{REDO}{IMAGES.format(log='redo', keys='page_id')} SELECT page_id, page_prefix, page_sha256 FROM img")
def page_snapshot_latest(spark, d):
    return _prefix(pages.snapshot(events_log(spark, d), 1 << 62)).select("page_id", "page_prefix", "page_sha256")


@query(ORACLE_SQL["page_snapshot_latest"])
def page_snapshot_fold(spark, d):
    return _prefix(pages.fold_snapshot(events_log(spark, d), 1 << 62))


@query(ORACLE_SQL["page_snapshot_latest"])
def page_snapshot_from_base(spark, d):
    """Pages as a base image at the middle of the log and the records after it."""
    e, mid = events_log(spark, d), _middle(spark, d)
    return _prefix(pages.snapshot(e, 1 << 62, pages.snapshot(e, mid), mid)).select("page_id", "page_prefix", "page_sha256")


@query(f"{REDO} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY lsn) AS version, lsn, lead(lsn) OVER (PARTITION BY page_id ORDER BY lsn) AS valid_until FROM redo")
def version_history(spark, d):
    return pages.version_history(events_log(spark, d)).withColumn("version", F.col("version").cast("long"))


@query(f"""{REDO}, o AS (SELECT page_id, "offset" + i AS place, arg_max(substr(hex(encode(data)), CAST(2 * i + 1 AS BIGINT), 2), lsn) AS byte FROM (SELECT r.*, unnest(range(n)) AS i FROM redo r WHERE lsn <= {MID}) GROUP BY ALL),
p AS (SELECT page_id, "offset" + i AS place, arg_max(substr(hex(encode(data)), CAST(2 * i + 1 AS BIGINT), 2), lsn) AS byte FROM (SELECT r.*, unnest(range(n)) AS i FROM redo r) GROUP BY ALL)
SELECT p.page_id, p.place, coalesce(o.byte, '00') AS old_byte, p.byte AS new_byte FROM p LEFT JOIN o USING (page_id, place) WHERE coalesce(o.byte, '00') <> p.byte""")
def page_diff_between(spark, d):
    return pages.page_diff(events_log(spark, d), _middle(spark, d), 1 << 62)


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Every event asks for a page, as of an LSN of which half are beyond the log."""
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(F.col("event_id").alias("req_id"), ((F.col("user_id") * 7) % 2000).alias("page_id"), (F.col("event_id") * 2).alias("read_point"))


REQUESTS = f"{REDO}, q AS (SELECT event_id AS req_id, (user_id * 7) % 2000 AS page_id, event_id * 2 AS read_point FROM events), v AS (SELECT max(lsn) AS vdl FROM redo WHERE is_mtr_end)"


@query(f"""{REQUESTS} SELECT req_id, q.page_id, read_point, max(lsn) AS last_lsn, count(lsn) AS chain_len, CASE WHEN read_point > vdl THEN 'beyond_durable' WHEN count(lsn) = 0 THEN 'not_found' ELSE 'ok' END AS status
FROM q CROSS JOIN v LEFT JOIN redo r ON r.page_id = q.page_id AND r.lsn <= read_point AND read_point <= vdl GROUP BY req_id, q.page_id, read_point, vdl""")
def read_status(spark, d):
    e = events_log(spark, d)
    return pages.read_status(_requests(spark, d), e, durability.live_state(e).first()["vdl"])


@query(f"""{REQUESTS}, l AS (SELECT q.req_id, q.page_id AS page_id, read_point, lsn, "offset", data, n FROM q JOIN redo r ON r.page_id = q.page_id AND r.lsn <= read_point CROSS JOIN v WHERE read_point <= vdl)
{IMAGES.format(log='l', keys='req_id, page_id, read_point')} SELECT req_id, page_id, read_point, page_prefix, page_sha256 FROM img""")
def asof_reads(spark, d):
    e = events_log(spark, d)
    return _prefix(pages.asof_reads(_requests(spark, d), e, durability.live_state(e).first()["vdl"]))


# Segments

SEGMENTED = f"""{REDO.replace('WITH', 'WITH RECURSIVE', 1)}, s AS (SELECT lsn, page_id, 41 + n AS size FROM redo),
seg(lsn, segment_id, held) AS (SELECT lsn, CAST(1 AS BIGINT), CAST(size AS BIGINT) FROM s WHERE lsn = 1
  UNION ALL SELECT s.lsn, CASE WHEN held + size > {SEGMENT} THEN segment_id + 1 ELSE segment_id END, CASE WHEN held + size > {SEGMENT} THEN size ELSE held + size END FROM seg JOIN s ON s.lsn = seg.lsn + 1),
t AS (SELECT seg.lsn, page_id, segment_id, size, held - size AS file_offset FROM seg JOIN s USING (lsn)),
m AS (SELECT segment_id AS id, 'wal_' || lpad(segment_id::VARCHAR, 6, '0') || '.seg' AS filename, min(lsn) AS first_lsn, max(lsn) AS last_lsn, sum(size)::BIGINT AS size_bytes, segment_id < (SELECT max(segment_id) FROM t) AS sealed FROM t GROUP BY 1),
c AS (SELECT *, CASE WHEN sealed AND row_number() OVER (PARTITION BY sealed ORDER BY id DESC) > 3 THEN 'Cold' ELSE 'Hot' END AS tier FROM m)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return segments.assign_segments(events_log(spark, d), SEGMENT)


@query(f"{SEGMENTED} SELECT lsn, segment_id, CAST(file_offset AS BIGINT) AS file_offset FROM t")
def segment_assignment(spark, d):
    return _placed(spark, d).select("lsn", "segment_id", "file_offset")


@query(f"{SEGMENTED} SELECT id, filename, 'Hot' AS tier, first_lsn, last_lsn, size_bytes, sealed FROM m")
def segment_summary(spark, d):
    return segments.segment_table(_placed(spark, d))


@query(f"{SEGMENTED} SELECT id, filename FROM m")
def segment_filenames(spark, d):
    return segments.segment_table(_placed(spark, d)).select("id", "filename")


@query(f"{SEGMENTED} SELECT id, filename, tier FROM c")
def cooling_plan(spark, d):
    return segments.cool(segments.segment_table(_placed(spark, d)), 3).select("id", "filename", "tier")


@query(f"""{SEGMENTED} SELECT page_id, sum(CASE WHEN tier = 'Cold' AND segment_id IS DISTINCT FROM came THEN 1 ELSE 0 END)::BIGINT AS charges, 50 * sum(CASE WHEN tier = 'Cold' AND segment_id IS DISTINCT FROM came THEN 1 ELSE 0 END)::BIGINT AS cold_ms
FROM (SELECT t.*, tier, lag(segment_id) OVER (PARTITION BY page_id ORDER BY lsn DESC) AS came FROM t JOIN c ON c.id = t.segment_id) GROUP BY 1""")
def cold_read_cost(spark, d):
    placed = _placed(spark, d)
    return segments.cold_read_cost(placed, segments.cool(segments.segment_table(placed), 3), 1 << 62)


# Text of pages, codec


@query("SELECT page_id, CASE WHEN html = '' THEN '(empty page)' ELSE html END AS page_text FROM pages WHERE octet_length(encode(html)) <= 8192")
def page_text(spark, d):
    """The text of pages on which the whole html stands; longer ones do not fit."""
    p = spark.read.parquet(f"{d}/pages.parquet").where(~C.overflows(F.lit(0), F.col("html").cast("binary")))
    page = F.overlay(C.zero_page(), F.col("html").cast("binary"), F.lit(1), F.octet_length("html"))
    return p.select("page_id", C.page_text(page).alias("page_text"))


@query(f"{REDO} SELECT lsn, left(data, 5) || CASE WHEN n > 5 THEN '...' ELSE '' END AS preview FROM redo")
def data_preview(spark, d):
    return events_log(spark, d).select("lsn", C.data_preview(F.col("data"), 5).alias("preview"))


@query(f"{REDO} SELECT lsn, true AS crc_ok, true AS lsn_ok FROM redo")
def crc_check(spark, d):
    """Entries whose CRC by built-in functions is the one that the decoder, by zlib, has found to fit; and whether numbers survive the byte order."""
    cols = [F.col(c) for c in ("lsn", "page_id", "offset", "data", "prev_lsn", "mtr_id", "is_mtr_end")]
    read = decode_segments(encode_segments(segments.assign_segments(linked_events_log(spark, d), SEGMENT)))
    return read.select("lsn", (C.entry_crc(*cols) == F.col("crc32")).alias("crc_ok"), (C.from_little_endian(C.little_endian(F.col("lsn"), 8)) == F.col("lsn")).alias("lsn_ok"))


# Sessions, traces


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Events as session steps of two nodes: every second one a put, every twentieth a refresh."""
    e = spark.read.parquet(f"{d}/events.parquet")
    op = F.when(F.col("event_id") % 20 == 19, "refresh").when(F.col("event_id") % 2 == 0, "put").otherwise("get")
    node = F.when(F.col("user_id") % 2 == 0, "A").otherwise("B")
    return e.select(F.col("event_id").alias("step"), node.alias("node"), op.alias("op"), (F.col("user_id") % 50).alias("page_id"), F.floor(F.col("event_id") / 2 + 1).alias("vdl"))


STEPS = "WITH st AS (SELECT event_id AS step, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS node, CASE WHEN event_id % 20 = 19 THEN 'refresh' WHEN event_id % 2 = 0 THEN 'put' ELSE 'get' END AS op, user_id % 50 AS page_id, event_id // 2 + 1 AS vdl FROM events), rp AS (SELECT *, coalesce(last_value(CASE WHEN op <> 'get' THEN vdl END IGNORE NULLS) OVER (PARTITION BY node ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS read_point FROM st)"


@query(f"{STEPS} SELECT step, node, read_point, vdl - read_point AS behind FROM rp WHERE op = 'get'")
def staleness(spark, d):
    return reads.staleness(_steps(spark, d))


@query(f"{STEPS}, v AS (SELECT page_id, vdl AS lsn FROM st WHERE op = 'put') SELECT step, rp.node, max(lsn) AS sees, count(lsn) AS versions FROM rp LEFT JOIN v ON v.page_id = rp.page_id AND lsn <= read_point WHERE op = 'get' GROUP BY 1, 2")
def read_isolation(spark, d):
    """The version that each get sees: the latest at its node's read point."""
    steps = _steps(spark, d)
    gets = reads.staleness(steps).join(steps.select("step", "page_id"), "step").select(F.col("step").alias("req_id"), "node", "page_id", "read_point")
    puts = steps.where("op = 'put'").select("page_id", F.col("vdl").alias("lsn"))
    seen = pages.read_status(gets, puts, 1 << 62).select("req_id", F.col("last_lsn").alias("sees"), F.col("chain_len").alias("versions"))
    return gets.select("req_id", "node").join(seen, "req_id").select(F.col("req_id").alias("step"), "node", "sees", "versions")


@query(f"{STEPS} SELECT step, page_id, read_point, row_number() OVER (PARTITION BY page_id, read_point ORDER BY step) > 1 AS hit FROM rp WHERE op = 'get'")
def page_cache_sim(spark, d):
    steps = _steps(spark, d)
    return reads.repeated_reads(reads.staleness(steps).join(steps.select("step", "page_id"), "step").select("step", "page_id", "read_point"))


def _trace(spark: SparkSession, d: str) -> DataFrame:
    """Events as trace lines, parsed: an NDJSON line for each event, of one kind after another."""
    e = spark.read.parquet(f"{d}/events.parquet")
    kind = F.element_at(F.array(*[F.lit(k) for k in trace.EVENT_KINDS]), (F.col("event_id") % len(trace.EVENT_KINDS) + 1).cast("int"))
    body = F.to_json(F.struct((F.col("event_id") % 3 == 0).alias("hit"), (F.col("user_id") + 41).alias("bytes"), F.col("event_id").alias("new"), F.col("event_id").alias("mtr_id"), F.col("event_id").alias("lsn"), (F.col("user_id") % 20).alias("page_id"), F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("node")))
    event = F.when(kind == "WalSync", F.lit('"WalSync"')).otherwise(F.concat(F.lit('{"'), kind, F.lit('":'), body, F.lit("}")))
    line = F.concat(F.lit('{"seq":'), F.col("event_id").cast("string"), F.lit(',"timestamp_us":'), (F.col("event_id") * 10).cast("string"), F.lit(',"event":'), event, F.lit("}"))
    return trace.parse_trace(e.select(line.alias("value")))


TRACE = f"WITH t AS (SELECT event_id AS seq, string_split('{' '.join(trace.EVENT_KINDS)}', ' ')[CAST(event_id % {len(trace.EVENT_KINDS)} + 1 AS BIGINT)] AS kind, event_id % 3 = 0 AS hit, user_id + 41 AS bytes, event_id AS new, user_id % 20 AS page_id, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS node FROM events)"


@query(f"{TRACE} SELECT kind, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM t GROUP BY 1")
def events_by_kind(spark, d):
    return trace.events_by_kind(_trace(spark, d))


@query(f"""{TRACE}, s AS (SELECT count(*) FILTER (WHERE kind = 'WalAppend') AS writes, coalesce(sum(bytes) FILTER (WHERE kind = 'WalAppend'), 0)::BIGINT AS bytes_written,
  count(*) FILTER (WHERE kind = 'BufferPoolLookup' AND NOT hit) AS reads, count(*) FILTER (WHERE kind = 'BufferPoolLookup' AND hit) AS buffer_hits, count(*) FILTER (WHERE kind = 'BufferPoolLookup' AND NOT hit) AS buffer_misses,
  count(*) FILTER (WHERE kind = 'PageCacheLookup' AND hit) AS cache_hits, count(*) FILTER (WHERE kind = 'PageCacheLookup' AND NOT hit) AS cache_misses, count(*) FILTER (WHERE kind = 'MaterializeComplete') AS materializations,
  coalesce(max(new) FILTER (WHERE kind = 'AdvanceVcl'), 0) AS vcl, coalesce(max(new) FILTER (WHERE kind = 'AdvanceVdl'), 0) AS vdl FROM t)
SELECT *, CASE WHEN cache_hits + cache_misses = 0 THEN 0 ELSE 100 * cache_hits // (cache_hits + cache_misses) END AS cache_hit_percent, bytes_written // 1024 AS kb_written FROM s""")
def metrics_summary(spark, d):
    return trace.metrics(_trace(spark, d))


@query(f"""{TRACE}, p AS (SELECT node, max(new) FILTER (WHERE kind = 'UpdateReadPoint') AS read_point, max(new) FILTER (WHERE kind = 'MtrCreated') AS mtr FROM t WHERE kind <> 'WalSync' GROUP BY 1), k AS (SELECT node, page_id, arg_max(kind, seq) AS kind FROM t WHERE kind IN ('BufferPoolInsert', 'BufferPoolInvalidate') GROUP BY 1, 2), h AS (SELECT node, count(*) AS pages FROM k WHERE kind = 'BufferPoolInsert' GROUP BY 1)
SELECT node, coalesce(read_point, 0) AS read_point, coalesce(mtr, 0) + 1 AS next_mtr, coalesce(pages, 0) AS pages FROM p LEFT JOIN h USING (node)""")
def node_state(spark, d):
    return trace.node_state(_trace(spark, d))


@query(f"{TRACE} SELECT coalesce(max(new) FILTER (WHERE kind = 'AdvanceVcl'), 0) AS vcl, coalesce(max(new) FILTER (WHERE kind = 'AdvanceVdl'), 0) AS vdl, coalesce(sum(bytes) FILTER (WHERE kind = 'WalAppend'), 0)::BIGINT AS log_bytes, count(DISTINCT page_id) FILTER (WHERE kind = 'UpdatePageIndex') AS pages FROM t")
def shared_state(spark, d):
    return trace.shared_state(_trace(spark, d))


@query(f"{TRACE} SELECT page_id, arg_max(new, seq) AS latest_lsn FROM t WHERE kind = 'UpdatePageIndex' GROUP BY 1")
def indexed_pages(spark, d):
    return trace.indexed_pages(_trace(spark, d))


@query(f"{TRACE} SELECT 100 * count(*) FILTER (WHERE hit) // count(*) AS cache_hit_percent FROM t WHERE kind = 'PageCacheLookup'")
def cache_hit_ratio(spark, d):
    return trace.metrics(_trace(spark, d)).select("cache_hit_percent")


@query("SELECT event_id AS seq FROM events ORDER BY event_id DESC LIMIT 15")
def trace_tail(spark, d):
    return trace.tail(_trace(spark, d)).select("seq")


@query(f"{REDO} SELECT format('DurabilityState(VCL={{}}, VDL={{}})', max(lsn), max(lsn) FILTER (WHERE is_mtr_end)) AS state FROM redo")
def state_display(spark, d):
    return durability.live_state(events_log(spark, d)).select(C.state_display(F.col("vcl"), F.col("vdl")).alias("state"))


@query(f"{REDO} SELECT lsn, page_id, \"offset\", hex(encode(data)) AS data_hex, coalesce(lag(lsn) OVER (PARTITION BY page_id ORDER BY lsn), 0) AS prev_lsn, batch_id AS mtr_id, is_mtr_end, 41 + n AS entry_bytes FROM redo")
def wal_roundtrip(spark, d):
    """The log as binary segments and read back."""
    files = encode_segments(segments.assign_segments(linked_events_log(spark, d), SEGMENT))
    return decode_segments(files).select("lsn", "page_id", "offset", F.hex("data").alias("data_hex"), "prev_lsn", "mtr_id", "is_mtr_end", "entry_bytes")


# Streams, drained


@query(f"{REDO} SELECT page_id, max(lsn) AS latest_lsn FROM redo GROUP BY 1")
def stream_page_index(spark, d):
    return incremental.drained(incremental.page_index_stream(events_stream(spark, d)), ["page_id"])


@query(f"{REDO} SELECT 0 AS k, count(*) AS records, max(lsn) AS last_lsn, max(lsn) FILTER (WHERE is_mtr_end) AS last_end FROM redo")
def stream_durability(spark, d):
    return incremental.drained(incremental.live_state_stream(events_stream(spark, d)).withColumn("k", F.lit(0)), ["k"])


@query(f"{REDO}{IMAGES.format(log='redo', keys='page_id')} SELECT page_id, page_prefix, page_sha256, max(lsn) AS last_lsn, count(*) AS chain_len FROM img JOIN redo USING (page_id) GROUP BY ALL")
def stream_pages(spark, d):
    return _prefix(incremental.drained(incremental.pages_stream(events_stream(spark, d)), ["page_id"]))
