"""A log on disk: bulk appends, recovery at open, snapshots.

An append is one Parquet write; it becomes part of the log when the manifest that names its files is replaced, so a
failed job leaves no trace and consumes no LSN.  One writer at a time: the manifest is replaced, not merged.
"""

from __future__ import annotations

import json
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import entry_bytes
from ..schema import SEGMENT_BYTES, LsnBeyondDurable, PageNotFound, PageOverflow
from .durability import recover
from .log import assign_lsns, link_previous, mark_ends, page_index, reachable, rejected_writes
from .pages import snapshot
from .segments import assign_segments, cool, segment_table

COLUMNS = "lsn bigint, page_id bigint, offset int, data binary, prev_lsn bigint, mtr_id bigint, is_mtr_end boolean, batch_id bigint, node string"


class PageLog:
    """``PageLog.open(spark, folder)`` recovers the log in the folder, or makes one."""

    def __init__(self, spark: SparkSession, folder: str, segment_bytes: int | None = None, compat: bool = False):
        self.spark, self.folder, self.segment_bytes, self.compat = spark, folder, segment_bytes, compat
        self.lock = threading.Lock()
        self.state = {"files": [], "next_lsn": 1, "next_batch": 1, "vcl": 0, "vdl": 0, "first_hot": 1}

    @classmethod
    def open(cls, spark: SparkSession, folder: str, preset: str = "base", segment_bytes: int = SEGMENT_BYTES, compat: bool = False) -> PageLog:
        if preset not in ("base", "tiered"):
            raise ValueError(f"no preset {preset}")
        os.makedirs(folder, exist_ok=True)
        log = cls(spark, folder, segment_bytes if preset == "tiered" else None, compat)
        if os.path.exists(log._manifest):
            with open(log._manifest) as f:
                log.state = json.load(f)
            found = recover(log.frame())
            if found.truncated_rows:
                path = log._write(found.log)
                log.state["files"] = [path]
            log.state |= {"vcl": found.vdl, "vdl": found.vdl, "next_lsn": found.vdl + 1}
            log._commit()
        return log

    @property
    def _manifest(self) -> str:
        return os.path.join(self.folder, "manifest.json")

    def _write(self, rows: DataFrame) -> str:
        path = os.path.join(self.folder, f"batch-{uuid.uuid4().hex}")
        rows.write.parquet(path)
        return path

    def _commit(self) -> None:
        with open(f"{self._manifest}.tmp", "w") as f:
            json.dump(self.state, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(f"{self._manifest}.tmp", self._manifest)

    def frame(self) -> DataFrame:
        """The log as a DataFrame."""
        if not self.state["files"]:
            return self.spark.createDataFrame([], COLUMNS)
        return self.spark.read.schema(COLUMNS).parquet(*self.state["files"])

    def durability(self) -> tuple[int, int]:
        return self.state["vcl"], self.state["vdl"]

    def append_frame(self, writes: DataFrame) -> int:
        """Batches of writes (batch_id, pos, node, page_id, offset, data) as one append; each batch is a group.

        Numbering, links and the write run on the executors; a write beyond its page rejects them all. Returns the VDL.
        """
        with self.lock:
            bad = rejected_writes(writes).first()
            if bad:
                raise PageOverflow(bad["page_id"], bad["offset"], len(bad["data"]))
            ends = writes.agg(F.min("batch_id"), F.max("batch_id")).first()
            if ends[0] is None:
                return self.state["vdl"]
            first = self.state["next_batch"] - ends[0]
            rows = mark_ends(assign_lsns(writes, self.state["next_lsn"])).withColumn("batch_id", F.col("batch_id") + first).withColumn("mtr_id", F.col("batch_id"))
            old = page_index(self.frame()).withColumnRenamed("latest_lsn", "_old")
            rows = link_previous(rows, self.compat).join(old, "page_id", "left").withColumn("prev_lsn", F.greatest("prev_lsn", F.coalesce("_old", F.lit(0))))
            path = self._write(rows.select([F.col(c.split()[0]).cast(c.split()[1]) for c in COLUMNS.split(", ")]))
            last, end = self.spark.read.schema(COLUMNS).parquet(path).agg(F.max("lsn"), F.max(F.when(F.col("is_mtr_end"), F.col("lsn")))).first()
            self.state["files"].append(path)
            self.state |= {"next_lsn": last + 1, "next_batch": ends[1] + first + 1, "vcl": last, "vdl": max(self.state["vdl"], end)}
            self._commit()
            return self.state["vdl"]

    def make_base(self) -> int:
        """Images of all pages at the VDL, from which later snapshots start; returns the LSN."""
        with self.lock:
            lsn = self.state["vdl"]
            path = os.path.join(self.folder, f"base-{uuid.uuid4().hex}")
            self.snapshot(lsn).drop("read_point").write.parquet(path)
            self.state["base"] = {"lsn": lsn, "path": path}
            self._commit()
            return lsn

    def snapshot(self, read_point: int) -> DataFrame:
        """All pages at a read point."""
        if read_point > self.state["vdl"]:
            raise LsnBeyondDurable(read_point, self.state["vdl"])
        log = reachable(self.frame()) if self.compat else self.frame()
        base = self.state.get("base")
        if base and base["lsn"] <= read_point:
            return snapshot(log, read_point, self.spark.read.parquet(base["path"]), base["lsn"])
        return snapshot(log, read_point)

    def get_page(self, page_id: int, read_point: int) -> bytes:
        row = self.snapshot(read_point).where(F.col("page_id") == page_id).first()
        if row is None:
            raise PageNotFound(page_id, read_point)
        return bytes(row["page"])

    def segments(self) -> DataFrame:
        """The segments of a tiered log; those before the manifest's first hot one are cold."""
        table = segment_table(assign_segments(self.frame(), self.segment_bytes or 1 << 62))
        return table.withColumn("tier", F.when(F.col("id") < self.state["first_hot"], "Cold").otherwise(F.col("tier")))

    def cool(self, keep_hot: int) -> int:
        """Make all sealed segments but the newest ``keep_hot`` cold; returns the first segment that is hot."""
        with self.lock:
            hot = cool(self.segments(), keep_hot).where("tier = 'Hot'").agg(F.min("id")).first()[0]
            self.state["first_hot"] = hot or self.state["first_hot"]
            self._commit()
            return self.state["first_hot"]

    def log_bytes(self) -> int:
        return self.frame().agg(F.sum(entry_bytes(F.col("data")))).first()[0] or 0
