"""The binary log: files of entries with a 41-byte little-endian header, and segments of them.

``read_wal`` goes through Spark's binaryFile source, so the files may lie in any store that Spark reads; a file
is one task, since an entry's start cannot be found from the middle.  ``WalSource`` registers the
format ``redo_wal`` for reading and writing on a mounted file system; it reads a file of any size entry by entry,
from the offset ``start`` up to the offset ``end`` if these options are given.

A file's entries end where it ends, at a torn entry (whose header or payload is cut off), or at a damaged one (whose
CRC does not fit): ``log_ends`` tells which, and where.
"""

from __future__ import annotations

import io
import json
import os
import shutil
import struct
import zlib
from collections.abc import Iterator
from itertools import islice
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.columns import entry_crc, header, little_endian, segment_filename
from ..schema import HEADER_BYTES, Corruption

HEADER = struct.Struct("<QQHHQQBI")
#: Decoded entries that a task hands over at a time.
DECODED = 2_000
END = pa.schema([("path", pa.string()), ("segment_id", pa.int64()), ("entries", pa.int64()), ("offset", pa.int64()), ("status", pa.string())])
ENTRY = "lsn bigint, page_id bigint, offset int, data binary, prev_lsn bigint, mtr_id bigint, is_mtr_end boolean, file_offset bigint, entry_bytes bigint, crc32 bigint, segment_id bigint"


def encode_entry(lsn: int, page_id: int, offset: int, data: bytes, prev_lsn: int, mtr_id: int, end: bool) -> bytes:
    if len(data) > 65535:
        raise ValueError(f"a payload of {len(data)} bytes does not fit its length field")
    head = HEADER.pack(lsn, page_id, offset, len(data), prev_lsn, mtr_id, int(end), 0)[:37]
    return head + struct.pack("<I", zlib.crc32(head + data)) + data


class Scan:
    """The valid entries of a binary file from an offset on; afterwards ``offset`` is the end of the last one, ``status`` why they end: end, torn or damaged."""

    def __init__(self, file: BinaryIO, start: int = 0, end: int | None = None):
        self.file, self.offset, self.end, self.status = file, start, end, "end"

    def __iter__(self) -> Iterator[tuple]:
        self.file.seek(self.offset)
        while self.end is None or self.offset < self.end:
            head = self.file.read(HEADER_BYTES)
            if len(head) < HEADER_BYTES:
                self.status = "torn" if head else "end"
                return
            lsn, page, offset, n, prev, mtr, flags, crc = HEADER.unpack(head)
            data = self.file.read(n)
            if len(data) < n or zlib.crc32(head[:37] + data) != crc:
                self.status = "torn" if len(data) < n else "damaged"
                return
            if max(lsn, page, prev, mtr) >= 1 << 63:
                raise ValueError(f"entry at {self.offset}: numbers of 2^63 and more are not supported")
            yield lsn, page, offset, data, prev, mtr, bool(flags & 1), self.offset, HEADER_BYTES + n, crc
            self.offset += HEADER_BYTES + n


def decode_entries(raw: bytes) -> Iterator[tuple]:
    """The valid entries from the start; a torn or damaged one ends the file."""
    return iter(Scan(io.BytesIO(raw)))


def segment_of(path: str) -> int | None:
    """The number in a segment's file name."""
    name = os.path.basename(path)
    return int(name[4:-4]) if name.startswith("wal_") and name.endswith(".seg") and name[4:-4].isdigit() else None


def read_wal(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """The entries of one log file, a folder of segments, or several of them. ``strict`` raises Corruption where a file holds a damaged entry."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if strict and (bad := log_ends(files).where("status = 'damaged'").orderBy("path").first()):
        raise Corruption(f"{bad['path']}: the entry at {bad['offset']} is damaged")
    return decode_segments(files)


def log_ends(files: DataFrame) -> DataFrame:
    """(path, segment_id, entries, offset, status) of (path, content) rows: how far a file's entries are valid, and whether what follows is nothing, torn or damaged."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                scan = Scan(io.BytesIO(content.as_py()))
                n = sum(1 for _ in scan)
                yield pa.RecordBatch.from_pylist([{"path": path, "segment_id": segment_of(path), "entries": n, "offset": scan.offset, "status": scan.status}], END)

    return files.mapInArrow(each, "path string, segment_id bigint, entries bigint, offset bigint, status string")


def read_segments(spark: SparkSession, folders: list[str], ids: list[int] | None = None) -> DataFrame:
    """The entries of the segments in some folders (hot and cold), all or those with the given ids; segments that are not there, or are empty, are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "wal_*.seg").load(folders).select("path", "content")
    if ids is not None:
        files = files.where(F.regexp_extract("path", r"wal_(\d+)\.seg$", 1).cast("bigint").isin([int(i) for i in ids]))
    return decode_segments(files)


def missing_segments(spark: SparkSession, folders: list[str], manifest: dict) -> DataFrame:
    """(segment_id) of a manifest's segments that have no file."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "wal_*.seg").load(folders).select(F.regexp_extract("path", r"wal_(\d+)\.seg$", 1).cast("bigint").alias("segment_id"))
    listed = spark.createDataFrame([(int(s["id"]),) for s in manifest["segments"]] + [(int(manifest["active_segment_id"]),)], "segment_id bigint")
    return listed.join(there, "segment_id", "left_anti")


def open_segment(spark: SparkSession, hot: str, cold: str, manifest: dict, segment_id: int) -> DataFrame:
    """The entries of one segment: the active one and hot ones lie in one folder, cold ones in another; FileNotFoundError for an unknown id."""
    tiers = {int(s["id"]): s.get("tier", "Hot") for s in manifest["segments"]} | {int(manifest["active_segment_id"]): "Hot"}
    if segment_id not in tiers:
        raise FileNotFoundError(f"no segment {segment_id}")
    return read_wal(spark, f"{(cold if tiers[segment_id] == 'Cold' else hot).rstrip('/')}/wal_{segment_id:06d}.seg")


def encode_segments(placed: DataFrame) -> DataFrame:
    """(path, content) of a log with segment_id: each segment's file, made by built-in functions.

    A segment is bounded by its size in bytes, so its entries fit a group.
    """
    cols = [F.col(c) for c in ("lsn", "page_id", "offset", "data", "prev_lsn", "mtr_id", "is_mtr_end")]
    entry = F.concat(header(*cols), little_endian(entry_crc(*cols), 4), F.col("data"))
    whole = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lsn", F.hex(entry).alias("entry")))), lambda x: x["entry"]), ""))
    return placed.groupBy("segment_id").agg(whole.alias("content")).select(segment_filename(F.col("segment_id")).alias("path"), "content")


def decode_segments(files: DataFrame) -> DataFrame:
    """The entries of (path, content) rows, one file each."""
    return files.mapInArrow(_decoded, ENTRY)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries DECODED at a time, of a part of a file or of several files."""
    names = [x.split()[0] for x in ENTRY.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def entries() -> Iterator[tuple]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                segment = segment_of(path.as_py())
                for e in decode_entries(content.as_py()):
                    yield (*e, segment)

    found = entries()
    while rows := list(islice(found, DECODED)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


class WalSource(DataSource):
    """``spark.read.format("redo_wal")`` / ``df.write.format("redo_wal")``; register with ``spark.dataSource.register``."""

    @classmethod
    def name(cls) -> str:
        return "redo_wal"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("start", 0)), int(self.options["end"]) if "end" in self.options else None)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], [f.name for f in schema.fields], overwrite)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str, start: int, end: int | None):
        self.path, self.start, self.end = path, start, end

    def partitions(self) -> list[InputPartition]:
        if not os.path.exists(self.path):
            raise FileNotFoundError(self.path)
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(self.path, n)) for n in sorted(os.listdir(self.path)) if n.endswith((".seg", ".wal"))]

    def read(self, partition: _File) -> Iterator[tuple]:
        segment = segment_of(partition.path)
        with open(partition.path, "rb", buffering=1 << 20) as f:
            for e in Scan(f, self.start, self.end):
                yield (*e, segment)


class _Names(WriterCommitMessage):
    def __init__(self, staged: list[tuple[str, str]]):
        self.staged = staged


class _Writer(DataSourceWriter):
    """A file for each segment_id (1 where there is none) of a task: rows must be dealt by segment and sorted by lsn.

    Nothing changes before the commit.  Appending to a segment that is there writes it anew, its valid entries and the
    new ones, under a temporary name, and replaces it; what is torn at its end goes, and a damaged entry is an error, as
    are LSNs that do not follow the segment's last.  Overwriting removes the folder's other segments.
    """

    def __init__(self, path: str, columns: list[str], overwrite: bool):
        self.path, self.columns, self.overwrite = path, columns, overwrite

    def write(self, rows) -> _Names:
        os.makedirs(self.path, exist_ok=True)
        open_files: dict[int, object] = {}
        staged = []
        try:
            for row in rows:
                r = row.asDict()
                segment = r.get("segment_id") or 1
                if segment not in open_files:
                    final = os.path.join(self.path, f"wal_{segment:06d}.seg")
                    part = f"{final}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
                    open_files[segment] = open(part, "wb")
                    staged.append((part, final))
                open_files[segment].write(encode_entry(r["lsn"], r["page_id"], r["offset"], bytes(r["data"]), r["prev_lsn"], r["mtr_id"], r["is_mtr_end"]))
        finally:
            for f in open_files.values():
                f.flush()
                os.fsync(f.fileno())
                f.close()
        return _Names(staged)

    def commit(self, messages: list[_Names]) -> None:
        names = [final for m in messages if m for _, final in m.staged]
        if len(names) != len(set(names)):
            raise ValueError("a segment was written by several tasks: deal the rows by segment_id first")
        staged = [x for m in messages if m for x in m.staged]
        if not self.overwrite:
            for part, final in staged:
                self._continue(part, final)
        for part, final in staged:
            os.replace(part, final)
        if self.overwrite and os.path.isdir(self.path):
            for name in os.listdir(self.path):
                if segment_of(name) is not None and os.path.join(self.path, name) not in names:
                    os.remove(os.path.join(self.path, name))

    @staticmethod
    def _continue(part: str, final: str) -> None:
        """Put the valid entries of a segment that is there before the new ones."""
        if not os.path.exists(final):
            return
        with open(final, "rb") as old, open(part, "rb") as new:
            scan = Scan(old)
            last = max((e[0] for e in scan), default=0)
            if scan.status == "damaged":
                raise ValueError(f"{final}: the entry at {scan.offset} is damaged")
            first = next(iter(Scan(new)), None)
            if first and first[0] <= last:
                raise ValueError(f"{final} ends with LSN {last}: LSN {first[0]} cannot follow")
            old.seek(0)
            new.seek(0)
            with open(f"{part}.all", "wb") as out:
                left = scan.offset
                while left and (piece := old.read(min(left, 1 << 20))):
                    left -= len(piece)
                    out.write(piece)
                shutil.copyfileobj(new, out)
                out.flush()
                os.fsync(out.fileno())
        os.replace(f"{part}.all", part)

    def abort(self, messages: list[_Names]) -> None:
        for part, _ in (x for m in messages if m for x in m.staged):
            for left in (part, f"{part}.all"):
                if os.path.exists(left):
                    os.remove(left)


def write_wal(placed: DataFrame, path: str, mode: str = "append") -> None:
    """A log with segment_id written as one file a segment; the job's commit is the durability point. The mode is append or overwrite."""
    rows = placed.select("lsn", "page_id", "offset", "data", "prev_lsn", "mtr_id", "is_mtr_end", "segment_id")
    rows.repartition("segment_id").sortWithinPartitions("segment_id", "lsn").write.format("redo_wal").mode(mode).save(path)


def save_manifest(path: str, segments: list[dict], active: int) -> None:
    """Sealed segments and the active one, through a temporary file and a rename."""
    with open(f"{path}.tmp", "w") as f:
        json.dump({"segments": segments, "active_segment_id": active}, f, indent=2)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)


def load_manifest(path: str) -> dict:
    if not os.path.exists(path):
        return {"segments": [], "active_segment_id": 1}
    with open(path) as f:
        return json.load(f)
