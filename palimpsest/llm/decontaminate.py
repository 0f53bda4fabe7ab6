"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks.

A document is contaminated by an item when some window of as many words as the item has
reaches ``similarity`` in weighted Jaccard over ``k``-word shingles (multisets; a shingle
weighs log(1 + items / items that hold it), so that what many items share counts less).
A document shorter than the item is one window.

Method.  The weights that a passage at that similarity can lack are bounded, item by item:
(1 - similarity) of the item's weight.  The cheapest way to break the item into short pieces
within that bound is a shortest path over its word borders (``kept_run``), so every such
passage, whether words were replaced, put in or left out or parts of it were moved, keeps a
run of words whose least length is known for each item.  Windows of that length are
fingerprinted with 64-bit SimHashes, at every offset of the items and at every ``stride``-th
word of the documents, where the stride is taken off the window so that one window always
falls inside the run.  Fingerprints are indexed by RADIUS + 1 blocks of 16 bits: two that
differ in at most RADIUS bits agree in one block, so every pair within the radius is found.
For each such pair all item-sized windows of the document that hold it are compared exactly.

Only a passage that repeats parts of an item in overlapping pieces, so that both sides of a
border stand twice, can escape the bound.

The benchmark goes to the tasks in blocks of at most ``block_windows`` fingerprints, whose
size is bounded; a larger benchmark takes more passes over the documents.  Documents are
read in segments of bounded length with overlap, so a text of any length takes bounded
memory.  Only verified (document, item) pairs leave a task; ``uncontaminated`` drops rows
where they stand, without a shuffle.

Defined results: null and blank texts or items match nothing; items of fewer than ``k``
words are one shingle; ``contaminated`` skips rows with a null id or item id and gives one
row per distinct (doc_id, item_id), with the best similarity, the first such window's start;
``uncontaminated`` judges each row by its own text, whatever its id; empty tables give none;
columns other than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize
from .textops import U64, _runs, document_words, pieces, shingle_hashes

RADIUS = 3
SIZE_STEP = 1.15
SEGMENT = 8192
BLOCK_WINDOWS = 500_000


def least_cost(total: np.ndarray, n: int, k: int, run: int) -> float:
    """The least weight of shingles lost when an item of n words is cut so that no ``run`` words in a row stay.

    ``total`` has the prefix sums of the weights of its shingles in order. A cut before word c loses the
    shingles across it, of which those across the cut before are lost already.
    """
    at = np.minimum(np.arange(n + 1), len(total) - 1)
    p = total[at]
    cost = np.full(n + 1, np.inf)
    cost[0] = 0.0
    for c in range(1, n + 1):
        last = np.arange(max(0, c - run + 1), c)
        if not len(last):
            continue
        cost[c] = (cost[last] + (p[c] - p[np.maximum(last, max(0, c - k + 1))] if c < n else 0.0)).min()
    return float(cost[n])


def kept_run(weights: np.ndarray, k: int, similarity: float) -> int:
    """Words in a row that every similar passage keeps of an item whose shingles have these weights, at least."""
    n = len(weights) + k - 1
    total = np.r_[0.0, np.cumsum(weights)]
    lost = (1 - similarity) * total[-1] * (1 + 1e-9)
    lo, hi = 1, n  # runs of lo words stay
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if least_cost(total, n, k, mid) > lost else (lo, mid - 1)
    return lo


def window_of(run: int) -> tuple[int, int]:
    """Fingerprint window and stride for a run of words.

    The window is what the stride leaves of the run, rounded down to one of a few sizes (SIZE_STEP apart),
    so that items of many lengths share a pass of windows.
    """
    stride = min(4, max(1, run // 4))
    size = most = run - stride + 1
    step = 8.0
    while step <= most:
        size, step = int(step), step * SIZE_STEP
    return size, stride


class Item:
    """An item's distinct shingles, in order of hash, with their multiplicities and weights."""

    def __init__(self, words: np.ndarray, k: int, weigh: Callable[[np.ndarray], np.ndarray]):
        self.n, self.k = len(words), min(k, len(words))
        h = shingle_hashes(words, k)
        self.shingles, self.times = np.unique(h, return_counts=True)
        self.weights = weigh(self.shingles)
        self.total = float((self.weights * self.times).sum())

    def best(self, text: np.ndarray, weigh: Callable[[np.ndarray], np.ndarray]) -> tuple[float, int]:
        """Similarity and start of the most similar item-sized window of some words, the first of equals."""
        h = _runs(text, self.k) if len(text) >= self.k else text[:0]
        m = min(len(h), self.n - self.k + 1)  # shingles in a window
        starts = len(h) - m + 1
        at = np.minimum(np.searchsorted(self.shingles, h), len(self.shingles) - 1)
        own = np.flatnonzero(self.shingles[at] == h) if m else np.zeros(0, np.int64)
        if not len(own):
            return 0.0, 0
        size = np.r_[0.0, np.cumsum(weigh(h))]
        # An occurrence counts in a window unless as many as the item has stand before it there.
        own = own[np.argsort(at[own], kind="stable")]
        of = at[own]
        rank = np.arange(len(own)) - np.searchsorted(of, of)
        back = np.arange(len(own)) - self.times[of]
        lo = np.maximum(np.where(rank >= self.times[of], own[np.maximum(back, 0)] + 1, 0), own - m + 1)
        hi = np.minimum(own, starts - 1)
        keep = lo <= hi
        w = self.weights[of][keep]
        both = np.cumsum(np.bincount(lo[keep], w, starts + 1) - np.bincount(hi[keep] + 1, w, starts + 1))[:starts]
        score = both / (self.total + size[m:] - size[:starts] - both)
        i = int(np.argmax(score > score.max() - 1e-12))
        return float(score[i]), i


class ItemBlock:
    """The fingerprints and shingles of some items, ready to be handed to tasks.

    ``shared`` and ``weights``: the shingles that several items hold, in order; all others weigh ``unseen``.
    """

    def __init__(self, rows: list[tuple[int, np.ndarray]], shared: np.ndarray, weights: np.ndarray, unseen: float, k: int, similarity: float):
        self.similarity, self.unseen, self.shared, self.weights = similarity, unseen, shared, weights
        self.ids = [i for i, _ in rows]
        self.items = [Item(w, k, self.weigh) for _, w in rows]
        runs: dict[tuple[int, bytes], int] = {}
        by: dict[tuple[int, int], list[int]] = {}
        for at, (_, w) in enumerate(rows):
            own = self.weigh(shingle_hashes(w, k))
            if (key := (len(w), own.tobytes())) not in runs:
                runs[key] = kept_run(own, k, similarity) if len(w) > k else len(w)
            by.setdefault(window_of(runs[key]), []).append(at)
        self.classes = []
        for (size, stride), held in sorted(by.items()):
            counts = [len(rows[at][1]) - size + 1 for at in held]
            prints = np.concatenate([fingerprints(rows[at][1], np.arange(c), size) for at, c in zip(held, counts, strict=True)])
            blocks = prints.view(np.uint16).reshape(-1, RADIUS + 1)
            tables = []
            for b in range(RADIUS + 1):
                order = np.argsort(blocks[:, b], kind="stable")
                known = np.zeros(1 << 16, bool)
                known[blocks[:, b]] = True
                tables.append((known, blocks[order, b], order.astype(np.int32)))
            self.classes.append((size, stride, np.repeat(np.array(held, np.int32), counts), prints, tables))
        self.longest = max((len(w) for _, w in rows), default=0)

    def weigh(self, h: np.ndarray) -> np.ndarray:
        if not len(self.shared):
            return np.full(len(h), self.unseen)
        at = np.minimum(np.searchsorted(self.shared, h), len(self.shared) - 1)
        return np.where(self.shared[at] == h, self.weights[at], self.unseen)


def fingerprints(w: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of w[i : i + size] for each i of ``at``."""
    bits = np.unpackbits(w.view(np.uint8)).reshape(len(w), 64).astype(np.int16) * 2 - 1
    total = np.zeros((len(w) + 1, 64), np.int16 if len(w) < 30_000 else np.int32)
    np.cumsum(bits, axis=0, out=total[1:], dtype=total.dtype)
    return _prints(total, at, size)


def _prints(total: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return np.packbits(total[at + size] > total[at], axis=1).view(np.uint64).ravel()


def _within(prints: np.ndarray, known: tuple) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of prints, row of the class) within RADIUS, through each block."""
    _, _, _, own, tables = known
    blocks = prints.view(np.uint16).reshape(-1, RADIUS + 1)
    for b, (seen, keys, order) in enumerate(tables):
        rows = np.flatnonzero(seen[blocks[:, b]])
        if not len(rows):
            continue
        lo = np.searchsorted(keys, blocks[rows, b], "left")
        n = np.searchsorted(keys, blocks[rows, b], "right") - lo
        i = np.repeat(rows, n)
        j = order[np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
        near = np.bitwise_count(prints[i] ^ own[j]) <= RADIUS
        yield i[near], j[near]


def matches(stream: np.ndarray, first: np.ndarray, block: ItemBlock, best: dict, base: int = 0) -> None:
    """Add to best[(document, item)] the similarity and place of each match in documents laid end to end;
    ``first`` has the index of each document's first word and the end."""
    n = len(stream)
    bits = np.unpackbits(stream.view(np.uint8)).reshape(n, 64).view(np.int8) * np.int8(2) - np.int8(1)
    total = np.zeros((n + 1, 64), np.int16 if n < 30_000 else np.int32)
    np.cumsum(bits, axis=0, out=total[1:], dtype=total.dtype)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    reach: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for known in block.classes:
        size, stride, held = known[:3]
        if n < size:
            continue
        # All windows of the line, as views; those that cross a document's end are dropped.
        prints = np.packbits(total[size::stride] > total[: n - size + 1 : stride], axis=1).view(np.uint64).ravel()
        at = np.arange(0, n - size + 1, stride)
        whole = doc[at] == doc[at + size - 1]
        at, prints = at[whole], prints[whole]
        if not len(at):
            continue
        for i, j in _within(prints, known):
            for p, item in set(zip(at[i].tolist(), held[j].tolist(), strict=True)):
                d, length = int(doc[p]), block.items[item].n
                lo, hi = max(p + size - length, int(first[d])), min(p + length, int(first[d + 1]))
                reach.setdefault((d, item), []).append((lo, hi))
    for (d, item), spans in reach.items():
        spans.sort()
        lo, hi = spans[0]
        for a, b in [*spans[1:], (n + 1, n + 1)]:
            if a <= hi:
                hi = max(hi, b)
                continue
            score, start = block.items[item].best(stream[lo:hi], block.weigh)
            if score >= block.similarity - 1e-9 and score > best.get((d, item), (0.0,))[0] + 1e-12:
                best[d, item] = (score, lo + start - int(first[d]) + base)
            lo, hi = a, b


def scan(texts: pa.Array, block: ItemBlock) -> Iterator[tuple[int, int, float, int]]:
    """(row, item, similarity, word) of each row and item found in it."""

    def flush(held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, float, int]]:
        best: dict = {}
        matches(np.concatenate([w for _, w in held]), np.r_[0, np.cumsum([len(w) for _, w in held])], block, best)
        return ((held[d][0], i, s, at) for (d, i), (s, at) in best.items())

    held, size = [], 0
    for row, w in enumerate(document_words(texts)):
        if len(w) > SEGMENT:  # in pieces that overlap by the longest item on both sides
            best: dict = {}
            for lo in range(0, len(w), SEGMENT):
                begin = max(0, lo - 2 * block.longest)
                matches(w[begin : lo + SEGMENT], np.array([0, min(len(w), lo + SEGMENT) - begin]), block, best, begin)
            yield from ((row, i, s, at) for (_, i), (s, at) in best.items())
            continue
        if len(w):
            held.append((row, w))
            size += len(w)
        if size > SEGMENT:
            yield from flush(held)
            held, size = [], 0
    if held:
        yield from flush(held)


def _blocks(items: DataFrame, k: int, similarity: float, block_windows: int) -> Iterator[ItemBlock]:
    """The items in blocks of bounded size, by ranges of a hash of their ids."""

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = list(document_words(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.astype(np.int64) for w in held], pa.list_(pa.int64())), pa.array([shingle_hashes(w, k).astype(np.int64) for w in held], pa.list_(pa.int64()))], ["item_id", "words", "shingles"])

    known = materialize(items.where("item_id is not null").mapInArrow(words_of, "item_id long, words array<long>, shingles array<long>").where("size(words) > 0").dropDuplicates(["item_id", "words"]), "items")
    size, count = known.agg(F.sum(F.size("words")), F.count("*")).first()
    if not count:
        return
    parts = -(-size // block_windows)
    held_by = known.select("item_id", F.explode(F.array_distinct("shingles")).alias("s")).groupBy("s").agg(F.countDistinct("item_id").alias("df"))
    held_by = materialize(held_by, "weights") if parts > 1 else held_by
    unseen = float(np.log1p(count))
    for part in range(parts):
        own = known.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        rows = [(r["item_id"], np.array(r["words"], np.int64).astype(U64)) for r in own.select("item_id", "words").orderBy("item_id").toLocalIterator()]
        shared = own.select(F.explode(F.array_distinct("shingles")).alias("s")).distinct().join(held_by, "s").where("df > 1").toPandas()
        shingles = shared["s"].to_numpy(np.int64).astype(U64)
        order = np.argsort(shingles)
        if rows:
            yield ItemBlock(rows, shingles[order], np.log1p(count / shared["df"].to_numpy(np.float64))[order], unseen, k, similarity)


def _prepared(items: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    return items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, similarity: float = 0.8, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, item_id, similarity, word) for each document and item found in it; word is the window's start."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null and text is not null")
    schema = "doc_id long, item_id long, similarity double, word long"

    def found(shared) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block: ItemBlock = shared.value
            for batch in batches:
                rows = list(scan(batch.column(1), block))
                if rows:
                    row, item, score, at = zip(*rows, strict=True)
                    ids = batch.column(0).take(pa.array(row, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([block.ids[i] for i in item], pa.int64()), pa.array(score, pa.float64()), pa.array(at, pa.int64())], ["doc_id", "item_id", "similarity", "word"])

        return docs.mapInArrow(each, schema)

    parts = [found(docs.sparkSession.sparkContext.broadcast(block)) for block in _blocks(_prepared(items, item_col, item_text_col), k, similarity, block_windows)]
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.max(F.struct("similarity", (-F.col("word")).alias("word")))
    return reduce(DataFrame.unionAll, parts).groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.word")).alias("word"))


def uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", k: int = 5, similarity: float = 0.8, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts hold no item; in one pass, through each block in turn."""
    where = docs.schema.fieldNames().index(text_col)

    def clean(rows: DataFrame, shared) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                keep[[row for row, *_ in scan(batch.column(where), shared.value)]] = False
                yield from pieces(batch.filter(pa.array(keep)))

        return rows.mapInArrow(each, docs.schema)

    for block in _blocks(_prepared(items, item_col, item_text_col), k, similarity, block_windows):
        docs = clean(docs, docs.sparkSession.sparkContext.broadcast(block))
    return docs
