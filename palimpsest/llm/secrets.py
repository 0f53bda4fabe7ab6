"""Secret scans by dictionary-primed zstandard novelty.

Three plain patterns give the base spans.  The method adds strings in a sensitive context
(a word such as ``auth`` or ``credential`` up to REACH characters before or after them) that are
incompressible there: the marginal cost of a candidate is the compressed size of the
surrounding text with it less the size without it, under a zstandard dictionary of the
surrounding text's identifiers and of common identifiers.  Ordinary words, repeated
identifiers and file names cost few bytes a character, random keys nearly the information
they hold.

Only a candidate's start, or its end before the word, must be in reach; it goes on to its true end.  Lines of one width
are one candidate (``wrapped``), and from a secret the context carries on over adjacent
incompressible runs parted by dots, colons or line breaks, so that keys of many lines and
tokens of several parts are one span each.

Every whole text is scanned once; a candidate is judged in blocks of bounded size, and is
taken whole if one of them is incompressible.

Defined results: a null text counts as empty and has no spans; the digest of no spans is
the SHA-256 of the empty string; offsets are code points, ends exclusive; repeated rows and
null ids are scanned as they come; an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import pieces

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns. A hex or access match that is too short leaves no other match in its run,
#: so their least lengths are part of the pattern; an assign match that is too short is dropped with what it took.
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
SENSITIVE = re.compile(r"(?:[Aa]uth|AUTH|[Bb]earer|BEARER|[Cc]redential|CREDENTIAL|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Pp]assw|PASSW|[Aa]pi.?[Kk]ey|API.?KEY|[Pp]rivate.?[Kk]ey|PRIVATE.?KEY|[Aa]ccess.?[Kk]ey|ACCESS.?KEY)")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: A part of a name: a word or a few in camel case, with a short number at most.
NAME_PART = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[a-z]+(?:[A-Z][a-z]{2,})+|(?:[A-Z][a-z]{2,})+)?\d{0,4}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]+")
#: What may part the lines of one secret, and the parts of one token; line breaks may be written as escapes.
BREAK = re.compile(r"""["'\\,;\x20\t]*(?:\r\n?|\n|(?:\\r)?\\n)(?:[\r\n"'\x20\t>#*|]|\\n)*""")
JOIN = re.compile(r"\.{1,2}|[:~|]|" + BREAK.pattern)
LINE_END = re.compile(r"""[\x20\t]*(?:[\r\n"'\\]|-----|\Z)""")
REACH = 60
AROUND = 256
NAME_MOST = 128  # characters of a name at most
JUDGED = 1024  # characters judged at once; twice as many at the end
WRAPPED = 32  # width from which lines may be one secret
SHORT_PARTS = 2  # too short or compressible ones, between incompressible parts
NOVELTY = 0.6  # marginal compressed bytes a character, at least
#: Common identifiers that prime every dictionary.
COMMON = " ".join(
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 access account address admin api application authorization bearer bucket "
    "certificate client config connection credential credentials database default description development email endpoint environment example "
    "export function header host https import integration key localhost login message module name number object option package parameter password "
    "private production property public region repository request response return secret server service session settings signature staging status "
    "string system test timestamp token type undefined update user username value variable version www".split()
)


_HEX_BYTE = np.zeros(256, np.int8)
_HEX_BYTE[list(b"0123456789abcdef")] = 1


def _has_hex(raw: bytes, least: int = 16) -> bool:
    """Whether some run of hex digits is long enough."""
    other = np.flatnonzero(_HEX_BYTE[np.frombuffer(raw, np.uint8)] == 0)
    return len(raw) >= least and bool((np.diff(other, prepend=-1, append=len(raw)) > least).any())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order. The cheap tests before each pattern miss no match."""
    raw = text.encode(errors="replace")
    low = raw.lower()
    spans: list[tuple[int, int, int]] = []
    if (b":" in raw or b"=" in raw) and any(w in low for w in (b"passw", b"secret", b"token", b"key")):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if b"AKIA" in raw:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    if _has_hex(raw):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    return spans


def novelty(candidate: str, before: str, after: str) -> float:
    """Marginal compressed bytes a character of the candidate between its surroundings."""
    words = " ".join(sorted(set(re.findall(r"[A-Za-z_]{3,}", before + " " + after))))
    primed = zstandard.ZstdCompressionDict(f"{COMMON} {words} {before} {after}".encode(errors="replace"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    rest = press.compress(f"{before} {after}".encode(errors="replace"))
    whole = press.compress(f"{before}{candidate}{after}".encode(errors="replace"))
    return (len(whole) - len(rest)) / max(1, len(candidate.encode(errors="replace")))


def keylike(candidate: str) -> bool:
    """Whether it has letters and digits and is no name of words and short numbers such as ``retry_count_v2``."""
    if not (re.search(r"[0-9]", candidate) and re.search(r"[A-Za-z]", candidate)):
        return False
    return len(candidate) > NAME_MOST or not all(map(NAME_PART.fullmatch, re.split(r"[_=+/-]", candidate)))


def wrapped(text: str, start: int, end: int, lines_most: int | None = None) -> tuple[int, str]:
    """End and characters of the candidate whose first line is text[start:end]: that line, those of the same width after it and a shorter last one."""
    width, lines = end - start, [text[start:end]]
    while width >= WRAPPED and len(lines) != lines_most:
        gap = BREAK.match(text, end)
        at = gap.end() if gap else end + 1 if text[end : end + 1] == " " else end
        run = RUN.match(text, at) if at > end else None
        if not run or len(run.group()) > width:
            break
        line = run.group()
        if len(line) < width and (line.startswith("--") or not LINE_END.match(text, run.end()) or not (re.search(r"[0-9+/=]", line) or (gap and len(lines) > 1))):
            break
        lines.append(line)
        end = run.end()
        if len(line) < width:
            break
    return end, "".join(lines)


def novel_spans(text: str, known: list[tuple[int, int, int]], least: float = NOVELTY) -> list[tuple[int, int, int]]:
    """Incompressible strings with letters and digits that start after or end before a sensitive word near it, to their true ends; none lies inside a known span."""
    low = text.encode(errors="replace").lower()
    if not any(w in low for w in (b"auth", b"bearer", b"credential", b"secret", b"token", b"passw", b"key")):
        return []
    runs = [c.span() for c in CANDIDATE.finditer(text)]
    ends = [b for _, b in runs]
    reached: list[int] = []  # furthest end of the known spans up to each one
    for _, _, b in known:
        reached.append(max(b, reached[-1] if reached else 0))
    starts = [a for a, _, _ in known]

    def is_known(start: int, end: int) -> bool:
        at = bisect_right(starts, start)
        return at > 0 and reached[at - 1] >= end

    def incompressible(own: str, start: int, end: int) -> bool:
        n = max(1, len(own) // JUDGED)
        for k in range(n):
            lo, hi = k * JUDGED, (k + 1) * JUDGED if k < n - 1 else len(own)
            before = own[max(0, lo - AROUND) : lo] if k else text[max(0, start - AROUND) : start]
            after = own[hi : hi + AROUND] if k < n - 1 else text[end : end + AROUND]
            if novelty(own[lo:hi], before, after) >= least:
                return True
        return False

    def carried(end: int) -> int:
        """The end of the secret whose first part ends here."""
        at, short = end, 0
        while short <= SHORT_PARTS:
            gap = JOIN.match(text, at)
            run = RUN.match(text, gap.end()) if gap else None
            if not run:
                break
            at, own = wrapped(text, *run.span())
            if len(own) < 16:
                short += 1
                continue
            mixed = at > run.end() or (re.search(r"[A-Za-z]", own) and (re.search(r"[0-9+/=]", own) or (len(own) >= WRAPPED and re.search(r"[a-z]", own) and re.search(r"[A-Z]", own))))
            if mixed and (is_known(run.start(), at) or incompressible(own, run.start(), at)):
                end, short = at, 0
            elif gap.group()[0] == ".":
                short += 1
            else:
                break
        return end

    found: list[tuple[int, int]] = []
    taken = [False] * len(runs)
    vain: set[int] = set()  # candidates before a word that were judged in vain
    judged = 0  # end of what was judged whole in vain: a later start inside is judged by its first block

    def secret(k: int, start: int) -> bool:
        """Whether candidate k is incompressible from here on."""
        own = text[start : ends[k]]
        return ends[k] - start >= 16 and keylike(own) and incompressible(own, start, ends[k])

    for m in SENSITIVE.finditer(text):
        for k in range(bisect_right(ends, m.start()) - 1, bisect_left(ends, m.start() - REACH) - 1, -1):
            if taken[k] or k in vain:
                continue
            start, end = runs[k]
            if is_known(start, end) or not secret(k, start):
                vain.add(k)
                continue
            to, first = carried(wrapped(text, start, end)[0]), k
            while first and JOIN.fullmatch(text, ends[first - 1], start) and secret(first - 1, runs[first - 1][0]):
                first, start = first - 1, runs[first - 1][0]
            for i in range(first, bisect_right(ends, to)):
                taken[i] = True
            found.append((start, to))
        for k in range(bisect_right(ends, m.end()), len(runs)):
            start, end = max(runs[k][0], m.end()), ends[k]
            if runs[k][0] > m.end() + REACH:
                break
            if start == runs[k][0] > 0 and text[start - 1] == "\\" and text[start] in "nrt":
                start += 1
            while start < end and text[start] == "=":
                start += 1
            if taken[k] or end - start < 16:
                continue
            again = end <= judged
            if again and end - start > 2 * JUDGED:
                to, own = end, text[start : start + 2 * JUDGED - 1]
            else:
                to, own = wrapped(text, start, end, 2 * JUDGED // WRAPPED if again else None)
            if not is_known(start, to):
                if not keylike(own) or not incompressible(own[: 2 * JUDGED - 1] if again else own, start, to):
                    judged = max(judged, to)
                    continue
            to = carried(wrapped(text, start, end)[0])
            while k < len(runs) and ends[k] <= to:
                taken[k] = True
                k += 1
            if not is_known(start, to):
                found.append((start, to))
    out: list[tuple[int, int, int]] = []
    for a, b in sorted(found):
        if out and a < out[-1][2]:
            out[-1] = (out[-1][0], 3, max(b, out[-1][2]))
        else:
            out.append((a, 3, b))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", novelty_least: float = NOVELTY) -> DataFrame:
    """(doc_id, spans: array of kind, start, end) for each row, in order of start and kind."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: int, end: int>>"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                spans = base_spans(text)
                spans = sorted(spans + novel_spans(text, spans, novelty_least))
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], ["doc_id", "spans"])

    return docs.mapInArrow(each, kind)


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    text = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "novel")
    return found.select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("novel"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by ``mark``; overlapping spans count as one. A null stays null."""
    where = docs.schema.fieldNames().index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole)):
            texts = []
            for value in batch.column(where):
                text = value.as_py()
                spans = base_spans(text) if text else []
                if text:
                    spans = sorted(spans + novel_spans(text, spans))
                if spans:
                    parts, at = [], 0
                    for a, _, b in spans:
                        if a >= at:
                            parts += [text[at:a], mark]
                        at = max(at, b)
                    text = "".join(parts) + text[at:]
                texts.append(text)
            columns = list(batch.columns)
            columns[where] = pa.array(texts, columns[where].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(each, docs.schema)


def scan_text(text: str | None) -> tuple[str, str]:
    """Digest of the base spans and all spans of one text; for tests and interactive use."""
    spans = base_spans(text or "")
    return hashlib.sha256(written(spans).encode()).hexdigest(), written(sorted(spans + novel_spans(text or "", spans)))
