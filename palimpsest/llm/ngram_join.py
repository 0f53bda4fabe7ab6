"""N-gram Jaccard join with token-combination prefixes.

A document is the set of its distinct ``k``-word shingles.  Two documents link when
100 * intersection >= percent * union; the result is one row per document with the
smallest id that links reach.

Method.  Equal sets are one class, found by a hash aggregate.  All shingles are counted
(``shingle_counts``); those above a frequency are *frequent* and come last in the global
order.  In that order a pair of classes that links shares two shingles in the prefixes
of length n - ceil(n * percent / 100) + 2, so it either shares a rare shingle there
(indexed singly) or two frequent ones (indexed as combinations).  Sets of more than
``pair_size`` shingles, where combinations would be many, index frequent shingles
singly; sizes that can meet both kinds do both, so no pair is lost.  Sets so small that
no other set can reach the threshold with them have no index entries.  Candidates pass a
size test and a parity-bitmap test, both of which reject only pairs that cannot link,
and the rest are verified on the whole sets.

Groups.  First every class meets the smallest class of its index entry (a frequent entry
is salted, and the leaders of the salts meet in turn), which joins a group of near
copies in linear work; then, ROUNDS times, drawn members of an entry's components meet.
Then, for completeness, entries whose classes are still in
several components pair the classes of different components; an entry of many classes is
split into blocks of CROWD, each of which meets the entry by itself.  Pairs inside a
component need no test.

``one_of_each`` keeps one row of each group of near copies; it works on classes of texts, so
rows that share an id but not a text are judged apart, and rows without an id as well.

Defined results: a null or blank text has no shingles and is linked with nothing; a row
with a null id is returned with a null component and takes no part in links; repeated
rows are returned as often as they come; an empty table gives an empty table; columns
other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .components import connected_components
from .session import materialize
from .textops import U64, distinct, document_shingles, mix, pieces

FREQUENT = 16
#: The largest number of frequent shingles handed to the tasks (8 bytes each). With more, the frequency rises.
MOST_FREQUENT = 2_000_000
PAIR_SIZE = 320
SALTS = 64
ROUNDS = 2
#: Classes of one index entry that one task pairs with the entry's others.
CROWD = 2000
#: With a frequency above this, the entries of rarer shingles are salted too.
SALTED_FROM = 4096
#: Bits of the filter that spares shuffling the sets of documents without candidates; a fixed size.
BLOOM_BITS = 1 << 23
#: Shingles counted by one group of the counting shuffle.
COUNT_GROUP = 1_000_000


def least_overlap(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The overlap that a set of n has with any set it links with, at least."""
    return (n * percent + 99) // 100


def class_id(s: np.ndarray) -> int:
    """Equal sets have equal ids."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = mix(np.array([np.add.reduce(mix(s + U64(0x51ED270B))) + U64(len(s))], U64))
    return int(x.astype(np.int64)[0])


def parity_bits(s: np.ndarray) -> bytes:
    """Bit h mod B is the parity of the elements that fall on it; B is a power of two, about the set's size.
    Bits in which two sets differ (at the smaller B) are never more than their symmetric difference."""
    bits = 1 << max(6, int(max(len(s), 1) - 1).bit_length())
    odd = np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    if len(a) > len(b):
        a, b = b, a
    while len(b) > len(a):
        half = len(b) // 2
        b = (int.from_bytes(b[:half], "little") ^ int.from_bytes(b[half:], "little")).to_bytes(half, "little")
    return (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()


def document_classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key, n, cls, bits) for each row of (doc_id, key, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cls, bits = [], [], []
            for s in document_shingles(batch.column(2), k):
                n.append(len(s))
                cls.append(class_id(s))
                bits.append(parity_bits(s))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(bits, pa.binary())], ["doc_id", "key", "n", "cls", "bits"])

    return docs.mapInArrow(each, "doc_id long, key long, n long, cls long, bits binary")


def _distinct_sets(column: pa.Array, k: int, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    seen = set()
    for s in document_shingles(column, k):
        # A set of n has a similarity of n / (n + 1) with another one at most.
        if len(s) * (100 - percent) >= percent and (c := class_id(s)) not in seen:
            seen.add(c)
            yield c, s


_SHIFT = U64(20)


def shingle_counts(docs: DataFrame, k: int, percent: int, total: int, least: int) -> DataFrame:
    """(token, df) of the shingles in at least ``least`` documents, over all documents.

    token is the upper 44 bits of the hash.  Each task sorts what it has seen and ships each
    range of tokens as one block of differences, a few bytes a shingle; a range is merged
    in one group of about COUNT_GROUP shingles, however frequent any of them is.
    """
    ranges = max(16, -(-total // COUNT_GROUP))
    width = -(-(1 << 44) // ranges)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s for _, s in _distinct_sets(batch.column(0), k, percent)]
            if not sets:
                continue
            tokens, counts = np.unique(np.concatenate(sets) >> _SHIFT, return_counts=True)
            part = (tokens // U64(width)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(part)) + 1
            rows = []
            for t, c, p in zip(np.split(tokens, cuts), np.split(counts, cuts), part[np.r_[0, cuts]], strict=True):
                step = np.diff(t, prepend=U64(int(p) * width))
                step = step.astype(np.uint32) if step.max() < 1 << 32 else step
                planes = step.view(np.uint8).reshape(len(step), -1).T.tobytes()
                rows.append((int(p), len(t), planes, np.minimum(c, 65535).astype(np.uint16).view(np.uint8).reshape(len(c), 2).T.tobytes()))
            p, n, d, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(n, pa.int64()), pa.array(d, pa.binary()), pa.array(c, pa.binary())], ["part", "n", "steps", "counts"])

    def merge(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        tokens, counts = [], []
        for n, d, c in zip(frame["n"], frame["steps"], frame["counts"], strict=True):
            size = len(d) // n
            step = np.ascontiguousarray(np.frombuffer(d, np.uint8).reshape(size, n).T).view(np.uint32 if size == 4 else np.uint64).ravel()
            tokens.append(np.cumsum(step.astype(U64)) + U64(int(key[0]) * width))
            counts.append(np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(2, n).T).view(np.uint16).ravel().astype(np.int64))
        t, c = np.concatenate(tokens), np.concatenate(counts)
        order = np.argsort(t, kind="stable")
        t, c = t[order], c[order]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
        df = np.add.reduceat(c, first)
        keep = df >= least
        return pd.DataFrame({"token": t[first][keep].astype(np.int64), "df": df[keep]})

    return docs.select("text").mapInArrow(local, "part long, n long, steps binary, counts binary").groupBy("part").applyInPandas(merge, "token long, df long")


def frequent_shingles(docs: DataFrame, k: int, percent: int, total: int) -> tuple[np.ndarray, int]:
    """Sorted tokens of the frequent shingles, MOST_FREQUENT at most, and the frequency from which they are."""
    counts = materialize(shingle_counts(docs, k, percent, total, FREQUENT), "counts")
    sizes = counts.groupBy(F.floor(F.log2("df")).alias("e")).count().collect()
    level, n = 64, 0
    for row in sorted(sizes, key=lambda r: -r["e"]):
        if n + row["count"] > MOST_FREQUENT:
            break
        level, n = row["e"], n + row["count"]
    rows = counts.where(F.col("df") >= F.lit(2.0) ** int(level)).select("token").toPandas()["token"]
    return np.sort(rows.to_numpy(np.int64).astype(U64)), 1 << int(level) if n else FREQUENT


def index_keys(s: np.ndarray, frequent: np.ndarray, percent: int, pair_size: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The index keys of a sorted set and the places of their first shingles in the order: of rare ones, of frequent
    ones.  Then the frequent shingles that are combined, and for each frequent key which two of them it has (-1: none)."""
    n = len(s)
    prefix = n - least_overlap(n, percent) + 1
    token = s >> _SHIFT
    at = np.searchsorted(frequent, token)
    often = frequent[np.minimum(at, len(frequent) - 1)] == token if len(frequent) else np.zeros(n, bool)
    rare, freq = s[~often], s[often]
    r = len(rare)
    none = np.zeros(0, np.int64)
    keys, places, firsts, seconds, front = [freq[:0]], [none], [none], [none], freq[:0]
    if r < prefix and len(freq):
        if n <= pair_size * 100 // percent + 1:
            front = freq[: prefix + 1 - r]
            i, j = np.triu_indices(len(front), 1)
            with np.errstate(over="ignore"):
                keys.append(mix(front[i] * U64(0x9E3779B97F4A7C15) + mix(front[j] + U64(7))))
            places.append(r + i)
            firsts.append(i)
            seconds.append(j)
        if n > pair_size:
            keys.append(freq[: prefix - r])
            places.append(np.arange(r, r + len(keys[-1])))
            firsts.append(np.full(len(keys[-1]), -1))
            seconds.append(np.full(len(keys[-1]), -1))
    return (rare[:prefix], np.arange(min(r, prefix))), (np.concatenate(keys), np.concatenate(places)), front, np.concatenate(firsts), np.concatenate(seconds)


POSTING = "key long, cls long, n long, place long, hot boolean, t1 long, t2 long, front array<long>"


def _posting_rows(c: int, s: np.ndarray, frequent: np.ndarray, percent: int, pair_size: int) -> Iterator[list[pa.Array]]:
    (rare, at), (freq, freq_at), front, first, second = index_keys(s, frequent, percent, pair_size)
    order = (front >> U64(1)).astype(np.int64)  # not negative, so the signed order is the order of shingles
    for keys, places, hot in ((rare, at, False), (freq, freq_at, True)):
        n = len(keys)
        if not n:
            continue
        if hot and len(order):
            t1, t2 = pa.array(order[first], mask=first < 0), pa.array(order[second], mask=second < 0)
            fronts = pa.array([order] + [None] * (n - 1), pa.list_(pa.int64()))
        else:
            t1 = t2 = pa.nulls(n, pa.int64())
            fronts = pa.nulls(n, pa.list_(pa.int64()))
        yield [pa.array(keys.astype(np.int64)), pa.array(np.full(n, c, np.int64)), pa.array(np.full(n, len(s), np.int64)), pa.array(places.astype(np.int64)), pa.array(np.full(n, hot)), t1, t2, fronts]


def postings(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, frequency: int, pair_size: int) -> DataFrame:
    """The index: an entry for each key and class, without keys of one class; front stands once a class."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    names = [x.split()[0] for x in POSTING.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(parts: list[list[pa.Array]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*parts, strict=True)], names)

        for batch in batches:
            parts, held = [], 0
            for c, s in _distinct_sets(batch.column(0), k, percent):
                for rows in _posting_rows(c, s, shared.value, percent, pair_size):
                    parts.append(rows)
                    held += len(rows[0])
                if held > 50_000:
                    yield flush(parts)
                    parts, held = [], 0
            if parts:
                yield flush(parts)

    found = docs.select("text").mapInArrow(each, POSTING)
    if frequency > SALTED_FROM:
        found = found.withColumn("hot", F.lit(True))
    found = found.withColumn("salt", F.when(F.col("hot"), F.pmod("cls", F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found.repartition(parts, "key", "salt").dropDuplicates(["key", "salt", "cls"])
    lead = F.expr("min(struct(n, cls)) over (partition by key, salt)")
    found = found.withColumn("lead", lead).withColumn("many", F.expr("count(*) over (partition by key, salt)")).where("hot or many > 1")
    return found.select(*names, F.col("lead.cls").alias("lead"), F.col("lead.n").alias("lead_n"))


def _reaches(percent: int) -> Column:
    """Whether the shingles from the shared one on can give the overlap that a link needs."""
    return F.least("x_rest", "y_rest") * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) once, smaller first, of pairs (x, x_n, y, y_n) whose sizes allow a link."""
    return (
        pairs.where(F.col("x") != F.col("y")).where(F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    )


def _bloom(ids: DataFrame) -> np.ndarray:
    """A bit for each hash of an id: BLOOM_BITS bits, whatever the number of ids."""
    at = F.pmod(F.xxhash64("key"), F.lit(BLOOM_BITS))
    words = ids.select((at / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(key), {BLOOM_BITS}) % 32 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BLOOM_BITS // 32, np.uint32)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def _sets(docs: DataFrame, needed: DataFrame, k: int) -> DataFrame:
    """(cls, elements) of the classes in ``needed`` (cls, key), from whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(needed))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((shared.value[at // 32] >> (at % 32).astype(np.uint32)) & 1 == 1))
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                sets = list(document_shingles(part.column(1), k))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([class_id(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "cls", "elements"])

    keyed = docs.select("key", "text", F.pmod(F.xxhash64("key"), F.lit(BLOOM_BITS)).alias("at"))
    sets = keyed.mapInArrow(each, "key long, cls long, elements binary")
    return needed.join(sets, ["key", "cls"]).dropDuplicates(["cls"]).select("cls", "elements")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The links among candidate pairs (a, b)."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            keep = [(100 + percent) * parity_distance(x, y) <= (100 - percent) * (m + n) for x, y, m, n in zip(f["a_bits"], f["b_bits"], f["a_n"], f["b_n"], strict=True)]
            yield f.loc[keep, ["a", "b"]]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            keep = []
            for x, y in zip(f["a_set"], f["b_set"], strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield f.loc[keep, ["a", "b"]]

    side = lambda c: classes.select(F.col("cls").alias(c), F.col("bits").alias(f"{c}_bits"), F.col("n").alias(f"{c}_n"))
    close = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(near, "a long, b long"), "close")
    if close.isEmpty():
        return close
    used = close.select(F.col("a").alias("cls")).union(close.select(F.col("b").alias("cls"))).distinct()
    needed = materialize(used.join(classes, "cls").select("cls", "key"), "needed")
    sets = materialize(_sets(docs, needed, k), "sets")
    both = close.join(sets.select(F.col("cls").alias("a"), F.col("elements").alias("a_set")), "a").join(sets.select(F.col("cls").alias("b"), F.col("elements").alias("b_set")), "b")
    return materialize(both.mapInPandas(exact, "a long, b long"), "links")


def _open(index: DataFrame, found: DataFrame) -> DataFrame:
    """The index entries whose classes are in several components, with the component of each class."""
    placed = index.join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls")).drop("lead", "lead_n", "hot")
    split = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return placed.join(split, "key", "left_semi")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text); the key of a row without an id is a hash of its text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.select("doc_id", F.coalesce("doc_id", F.xxhash64("text")).alias("key"), "text")


def _components(known: DataFrame, members: DataFrame, k: int, percent: int, pair_size: int) -> DataFrame:
    """(cls, doc_id, key, component) of the classes of ``members``, whose texts are in ``known``: doc_id is the smallest
    of the class, key that of its row (of any row, where none has an id)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    classes = members.where("n > 0").groupBy("cls").agg(first.alias("m"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = materialize(classes.select("cls", "m.doc_id", "m.key", "n", "bits"), "classes")
    total = classes.agg(F.sum("n")).first()[0] or 0
    index = materialize(postings(known, k, percent, *frequent_shingles(known, k, percent, int(total)), pair_size), "index")

    # Every class with the leader of its entry; the leaders of a frequent entry's salts with their own leader.
    star = index.select(F.col("cls").alias("x"), F.col("n").alias("x_n"), F.col("lead").alias("y"), F.col("lead_n").alias("y_n"))
    salts = index.where("hot").select("key", "lead", "lead_n").distinct()
    tops = salts.groupBy("key").agg(F.min(F.struct("lead_n", "lead")).alias("top"))
    star = star.union(salts.join(tops, "key").select("lead", "lead_n", "top.lead", "top.lead_n"))
    tried = materialize(_candidates(star, percent), "pairs")
    links = _verified(known, classes, tried, k, percent)

    found = connected_components(links).select(F.col("node").alias("cls"), "component")

    # In entries that still hold several components, one class of each, drawn anew for each entry,
    # meets one of the largest there: whatever is near a large group meets many of its members.
    for turn in range(ROUNDS):
        heads = materialize(_open(index, found).groupBy("key", "component").agg(F.count("*").alias("held"), F.min(F.struct(F.xxhash64("key", "cls", F.lit(turn)).alias("r"), "cls", "n", (F.col("n") - F.col("place")).alias("rest"))).alias("m")), "heads")
        tops = heads.groupBy("key").agg(F.max(F.struct("held", "m")).getField("m").alias("t"))
        star = heads.join(tops, "key").select(F.col("m.cls").alias("x"), F.col("m.n").alias("x_n"), F.col("m.rest").alias("x_rest"), F.col("t.cls").alias("y"), F.col("t.n").alias("y_n"), F.col("t.rest").alias("y_rest"))
        new = materialize(_candidates(star.where(_reaches(percent)), percent).join(tried, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            break
        tried, more = tried.union(new), _verified(known, classes, new, k, percent)
        if more.isEmpty():
            break
        links = links.union(more)
        found = connected_components(links).select(F.col("node").alias("cls"), "component")

    # Then pairs of classes of different components, each at the first entry that they share.
    fronts = index.where("front is not null").select("cls", "front").dropDuplicates(["cls"])
    open_ = materialize(_open(index, found).drop("front").join(fronts, "cls", "left").withColumn("front", F.when(F.col("t1").isNotNull(), F.col("front"))), "open")
    # An entry of many classes is dealt in blocks: each block of one side meets all of the other.
    blocks = open_.groupBy("key").agg(F.least(F.ceil(F.count("*") / CROWD), F.lit(1024)).cast("int").alias("blocks"))
    open_ = open_.join(blocks, "key")
    names = lambda c: ["key", F.col("cls").alias(c), F.col("n").alias(f"{c}_n"), F.col("component").alias(f"{c}_in"), (F.col("n") - F.col("place")).alias(f"{c}_rest"), F.col("front").alias(f"{c}_front")]
    x = open_.select(*names("x"), "t1", "t2", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"))
    y = open_.select(*names("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    fits = (F.col("x_in") != F.col("y_in")) & (F.col("x") < F.col("y")) & _reaches(percent)
    first = F.expr("x_front is null or y_front is null or slice(array_sort(array_intersect(x_front, y_front)), 1, 2) = array(t1, t2)")
    rest = x.join(y, ["key", "block"]).where(fits & first).select("x", "x_n", "y", "y_n")
    rest = materialize(_candidates(rest, percent).join(tried, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        more = _verified(known, classes, rest, k, percent)
        if not more.isEmpty():
            found = connected_components(links.union(more)).select(F.col("node").alias("cls"), "component")

    return classes.select("cls", "doc_id", "key").join(found, "cls", "left").withColumn("component", F.coalesce("component", "cls"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, pair_size: int = PAIR_SIZE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    docs = _keyed(docs, id_col, text_col)
    members = materialize(document_classes(docs, k), "members")
    named = _components(docs.where("doc_id is not null"), members.where("doc_id is not null"), k, percent, pair_size)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "component").select("cls", "component_id")
    own = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return members.select("doc_id", "n", "cls").join(of_class, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), own.cast("long").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, pair_size: int = PAIR_SIZE) -> DataFrame:
    """``docs``, with all their columns, without all but one row of each group of near copies: the one with the smallest id
    stays (of rows without an id, any).  Rows whose text is null or blank are copies of nothing and stay."""
    rows = _keyed(docs, id_col, text_col)
    members = materialize(document_classes(rows, k), "members")
    named = _components(rows, members, k, percent, pair_size)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "cls", "key"))
    kept = named.groupBy("component").agg(best.alias("m")).select(F.col("m.cls").alias("kept_cls"), F.col("m.key").alias("kept_key"))

    where, names = docs.schema.fieldNames().index(text_col), docs.schema.fieldNames()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for batch in batches for x in pieces(batch)):
            cls = pa.array([class_id(s) for s in document_shingles(part.column(where), k)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(part.columns, names), cls], ["row", "cls"])

    blank = F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    tagged = docs.where(~blank).mapInArrow(each, StructType([StructField("row", docs.schema), StructField("cls", LongType())]))
    tagged = tagged.withColumn("key", F.coalesce(F.col("row")[id_col].cast("long"), F.xxhash64(F.col("row")[text_col].cast("string"))))
    # A class spreads over the ids of its rows, so copies do not meet in one task; rows that repeat an id and a text do at last.
    one = tagged.join(kept, (F.col("cls") == F.col("kept_cls")) & (F.col("key") == F.col("kept_key")), "left_semi").dropDuplicates(["cls", "key"])
    return one.select("row.*").unionByName(docs.where(blank))
