"""Schemas (as DDL), constants and errors of the redo log."""

from __future__ import annotations

PAGE_SIZE = 8192
HEADER_BYTES = 41
SEGMENT_BYTES = 4096


class LogError(Exception):
    """Base of all errors of the log."""


class PageNotFound(LogError):
    def __init__(self, page_id: int, lsn: int):
        super().__init__(f"page {page_id} not found at LSN {lsn}")
        self.page_id, self.lsn = page_id, lsn


class LsnBeyondDurable(LogError):
    def __init__(self, requested: int, durable: int):
        super().__init__(f"LSN {requested} is beyond the durable LSN {durable}")
        self.requested, self.durable = requested, durable


class PageOverflow(LogError):
    def __init__(self, page_id: int, offset: int, length: int):
        super().__init__(f"page {page_id}: {length} bytes at {offset} exceed {PAGE_SIZE}")
        self.page_id, self.offset, self.length = page_id, offset, length


class Corruption(LogError):
    """An entry that cannot be read, or a chain with a missing link."""
