"""Column expressions on log entries and pages; all are built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HEADER_BYTES, PAGE_SIZE


def little_endian(value: Column, size: int) -> Column:
    """An integer as ``size`` little-endian bytes."""
    pairs = F.regexp_extract_all(F.lpad(F.hex(value), size * 2, "0"), F.lit("(..)"), F.lit(1))
    return F.unhex(F.array_join(F.reverse(F.slice(pairs, -size, size)), ""))


def from_little_endian(raw: Column) -> Column:
    """The integer of up to 8 little-endian bytes (below 2^63)."""
    pairs = F.regexp_extract_all(F.hex(raw), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).cast("long")


def entry_bytes(data: Column) -> Column:
    """Bytes of an entry on disk: header and payload."""
    return (F.lit(HEADER_BYTES) + F.octet_length(data)).cast("long")


def overflows(offset: Column, data: Column) -> Column:
    """Whether a write does not fit its page; one that ends at the page's end fits."""
    return offset + F.octet_length(data) > PAGE_SIZE


def header(lsn: Column, page_id: Column, offset: Column, data: Column, prev_lsn: Column, mtr_id: Column, end: Column) -> Column:
    """The first 37 header bytes, over which with the payload the CRC runs."""
    wide = [little_endian(lsn, 8), little_endian(page_id, 8), little_endian(offset, 2), little_endian(F.octet_length(data), 2)]
    return F.concat(*wide, little_endian(prev_lsn, 8), little_endian(mtr_id, 8), little_endian(end.cast("int"), 1))


def entry_crc(lsn: Column, page_id: Column, offset: Column, data: Column, prev_lsn: Column, mtr_id: Column, end: Column) -> Column:
    return F.crc32(F.concat(header(lsn, page_id, offset, data, prev_lsn, mtr_id, end), data))


def zero_page() -> Column:
    return F.unhex(F.lit("00" * PAGE_SIZE))


def page_text(page: Column, most: int | None = None) -> Column:
    """The page's bytes up to the first NUL as text, broken sequences replaced; ``(empty page)`` if there are none."""
    cut = page if most is None else F.substring(page, 1, most)
    text = F.substring_index(F.make_valid_utf8(cut.cast("string")), "\0", 1)
    return F.when(F.hex(F.substring(page, 1, 1)) == "00", F.lit("(empty page)")).otherwise(text)


def data_preview(data: Column, most: int = 20) -> Column:
    """The first bytes as text, or as 0x and hex where they are not valid UTF-8; ``...`` if cut."""
    cut = F.substring(data, 1, most)
    text = cut.cast("string")
    shown = F.when(F.is_valid_utf8(text), text).otherwise(F.concat(F.lit("0x"), F.hex(cut)))
    return F.concat(shown, F.when(F.octet_length(data) > most, F.lit("...")).otherwise(F.lit("")))


def segment_filename(segment_id: Column) -> Column:
    return F.format_string("wal_%06d.seg", segment_id)


def state_display(vcl: Column, vdl: Column) -> Column:
    return F.format_string("DurabilityState(VCL=%d, VDL=%d)", vcl, vdl)
