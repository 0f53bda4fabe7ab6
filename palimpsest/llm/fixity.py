"""Merkle fixity audit of WARC replicas.

Records are keyed by archive and byte offset.  The leaves of a tree are ordered offset
ranges: leaf i covers the records that start in [i * range_bytes, (i + 1) * range_bytes),
and its hash is the SHA-256 over their offsets, lengths and payload hashes in order.  A node
of the next level covers ``fanout`` neighbouring ranges.  Two replicas compare their roots;
where these differ, only the children of differing nodes are compared, level by level, down
to the leaves, whose records are then compared one by one.

Offsets fix the shape of the trees, so there is no running count over an archive: every
level is one aggregate by (archive, range), a group of which holds ``fanout`` hashes, or the
records of one range, and an archive with a third of all bytes spreads over its ranges.  What
moves are hashes, and after the roots only those of damaged branches.

Defined results: a payload that is null in one replica only, a record missing on one side or
standing twice is a difference ("changed", "missing", "extra"); a null payload hashes apart
from an empty one; rows with a null archive or offset belong to no tree and are reported
as "unplaced"; empty replicas agree; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import materialize

RANGE_BYTES = 1 << 16
FANOUT = 16


def warc_index(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", per_archive: int = 200, also: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """(archive, id, offset, length, hash) of WARC/1.0 resource records, ``per_archive`` ids an archive, in id order.

    Rows of one id stand in the order of URL, length and hash; a null id has a null archive and offset.  ``also`` names
    further columns, each the hash of a function of the payload.  Payloads are hashed where they are read and do not move.
    """
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    rows = pages.select(F.floor(F.col(id_col) / per_archive).alias("archive"), F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary")).alias("payload"))
    more = {name: F.sha2(make(F.col("payload")), 256) for name, make in (also or {}).items()}
    rows = rows.select("archive", "id", "url", F.octet_length("payload").cast("long").alias("length"), F.sha2("payload", 256).alias("hash"), *(c.alias(n) for n, c in more.items()))
    # An archive holds per_archive ids, so the window is small; rows without one are dealt by their hashes.
    start = "coalesce(sum(length) over (partition by archive, if(archive is null, hash, '') order by id, url, length, hash rows between unbounded preceding and 1 preceding), 0)"
    return rows.withColumn("offset", F.when(F.col("archive").isNotNull(), F.expr(start))).select("archive", "id", "offset", "length", "hash", *more)


def leaves(records: DataFrame) -> DataFrame:
    """(archive, offset, length, hash) of records with a payload."""
    mark = F.when(F.col("payload").isNull(), F.lit("null")).otherwise(F.sha2("payload", 256))
    return records.select("archive", "offset", F.col("length").cast("long").alias("length"), mark.alias("hash"))


def tree(records: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of the tree from the leaves up, each (archive, node, hash), over rows (archive, offset, length, hash)."""
    join = lambda: F.sha2(F.array_join(F.array_sort(F.collect_list("part")), "|").cast("binary"), 256).alias("hash")
    part = F.concat_ws(":", F.lpad(F.col("offset").cast("string"), 20, "0"), F.col("length").cast("string"), F.col("hash"))
    level = records.where("archive is not null and offset is not null").select("archive", F.floor(F.col("offset") / range_bytes).alias("node"), part.alias("part")).groupBy("archive", "node").agg(join())
    out = [level]
    for _ in range(levels):
        part = F.concat_ws(":", F.lpad(F.col("node").cast("string"), 20, "0"), "hash")
        level = level.select("archive", F.floor(F.col("node") / fanout).alias("node"), part.alias("part")).groupBy("archive", "node").agg(join())
        out.append(level)
    return out


def audit(left: DataFrame, right: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """(archive, offset, length, finding) of the records in which two replicas (archive, offset, length, hash) differ."""
    left, right = (materialize(x.select("archive", "offset", "length", "hash"), "leaves") for x in (left, right))
    most = reduce(max, (x.agg(F.max("offset")).first()[0] or 0 for x in (left, right)), 0)
    levels, span = 0, most // range_bytes
    while span > 0:
        span, levels = span // fanout, levels + 1
    trees = [[materialize(level, "tree") for level in tree(x, levels, range_bytes, fanout)] for x in (left, right)]
    suspects = None
    for depth in range(levels, -1, -1):
        a, b = trees[0][depth], trees[1][depth]
        if suspects is not None:  # only children of differing nodes
            above = suspects.select("archive", F.col("node").alias("parent"))
            a, b = (x.join(above, (x["archive"] == above["archive"]) & (F.floor(x["node"] / fanout) == above["parent"]), "left_semi") for x in (a, b))
        a, b = a.withColumnRenamed("hash", "a"), b.withColumnRenamed("hash", "b")
        suspects = a.join(b, ["archive", "node"], "full_outer").where("not (a <=> b)").select("archive", "node")
        suspects = materialize(suspects, "suspects")
    pick = lambda x: x.join(suspects, (x["archive"] == suspects["archive"]) & (F.floor(x["offset"] / range_bytes) == suspects["node"]), "left_semi")
    side = lambda x, n: pick(x).groupBy("archive", "offset", "length", "hash").agg(F.count("*").alias(n))
    odd = side(left, "na").join(side(right, "nb"), ["archive", "offset", "length", "hash"], "full_outer").where("not (na <=> nb)")
    # What stands at an offset on both sides is a change; on one side only, a record too few or too many.
    both = odd.groupBy("archive", "offset").agg(F.max(F.when(F.col("na") > F.coalesce("nb", F.lit(0)), F.col("length"))).alias("la"), F.max(F.when(F.col("nb") > F.coalesce("na", F.lit(0)), F.col("length"))).alias("lb"))
    finding = F.when(F.col("lb").isNull(), "missing").when(F.col("la").isNull(), "extra").otherwise("changed")
    found = both.select("archive", "offset", F.coalesce("la", "lb").alias("length"), finding.alias("finding"))
    loose = left.unionByName(right).where("archive is null or offset is null").select("archive", "offset", "length", F.lit("unplaced").alias("finding"))
    return found.unionByName(loose)
