"""Masked pseudo-likelihood of documents.

A window network predicts every token from SIDE tokens before and after it; a document's
score is the sum of its conditional log-probabilities, and their mean.

Vocabulary.  All words of all documents are counted.  The most frequent are classes of
their own; the others fall into RARE classes by their last two bytes, which tell language and
form, so that the words around tell something about them.  Inside a class every word has its
own share, its count by the class's: a token's probability is the network's of the class times
that share.  The counts of up to KNOWN most frequent words go to the tasks; those of all
others, however many, are joined in Spark.  Class 0 stands for what is beyond a document's
ends.

Training.  In each of ROUNDS passes every document masks one token in MASK_ONE_IN, from an
offset drawn from its text that moves on by one a pass; as many passes as MASK_ONE_IN
make every token a target.  Every task trains a copy of the network in numpy on its
documents; the copies are averaged, weighted by tokens, in a Spark aggregate over the
coordinates, so only one network's weights reach the driver, however many tasks there are.
The weights, and so the last digits of the scores, depend on how the table is dealt to tasks.
A text is held whole, its tokens in a few arrays.

Defined results: null and blank texts have no tokens, a log-likelihood of 0 and a null mean;
without any word the network is not trained and all rows are such; repeated rows and null
ids are scored as they come; an empty table gives none; columns other than id and text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize
from .textops import U64, document_words_and_endings, mix

CLASSES, RARE = 96, 72
SIDE = 2
WIDTH, HIDDEN = 12, 16
ROUNDS, MASK_ONE_IN = 2, 2  # every token is a target
KNOWN = 200_000  # words whose counts are broadcast (16 bytes each)
BATCH, RATE = 1024, 0.04
BLOCK = 1024


def rare_classes(endings: np.ndarray) -> np.ndarray:
    return (CLASSES - RARE + mix(endings.astype(U64)) % U64(RARE)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, rare): hash and count of every word of the corpus, and its class if it is a rare one; batches are counted before they are shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(w, end) for w, end in document_words_and_endings(batch.column(0)) if len(w)]
            if held:
                w, first, n = np.unique(np.concatenate([w for w, _ in held]), return_index=True, return_counts=True)
                rare = rare_classes(np.concatenate([end for _, end in held])[first])
                yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(rare.astype(np.int32))], ["word", "n", "rare"])

    return docs.select("text").mapInArrow(each, "word long, n long, rare int").groupBy("word").agg(F.sum("n").alias("n"), F.min("rare").alias("rare"))


class Vocabulary:
    def __init__(self, frequent: list[int], counts: np.ndarray, known: np.ndarray, n_known: np.ndarray, table: DataFrame | None):
        order = np.array(frequent, np.int64).astype(U64)
        self.words = np.sort(order)
        self.counts = counts
        known = known.astype(U64)
        by = np.argsort(known)
        self.known, self.log_known = known[by], np.log(n_known[by].astype(np.float64))
        self.table = table  # counts of all words, if some are not known

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def log_shares(self, w: np.ndarray, classes: np.ndarray) -> tuple[float, np.ndarray]:
        """Sum of the tokens' log-shares of their classes, in which the words returned still lack the log of their count."""
        if not len(w):
            return 0.0, w
        at = np.minimum(np.searchsorted(self.known, w), max(0, len(self.known) - 1))
        is_known = self.known[at] == w if len(self.known) else np.zeros(len(w), bool)
        return float(self.log_known[at[is_known]].sum() - np.log(np.maximum(self.counts[classes], 1)).sum()), w[~is_known]

    def classes(self, w: np.ndarray, endings: np.ndarray) -> np.ndarray:
        rare = rare_classes(endings)
        if not len(self.words):
            return rare
        at = np.minimum(np.searchsorted(self.words, w), len(self.words) - 1)
        return np.where(self.words[at] == w, at + 1, rare)


def vocabulary(docs: DataFrame) -> Vocabulary:
    counts = materialize(word_counts(docs), "words")
    # The most frequent words by powers of two of their counts, KNOWN at most: no task sends more than its part of them.
    sizes = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("e")).count().collect()
    level, held = 64, 0
    for r in sorted(sizes, key=lambda r: -r["e"]):
        if held + r["count"] > KNOWN:
            break
        level, held = r["e"], held + r["count"]
    known = counts.where(F.col("n") >= F.lit(2.0) ** level).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words, n = known["word"].to_numpy(np.int64), known["n"].to_numpy(np.int64)
    top = words[: CLASSES - RARE - 1]
    rare = counts.join(F.broadcast(docs.sparkSession.createDataFrame([(int(w),) for w in top], "word long")), "word", "left_anti")
    sums = rare.groupBy("rare").agg(F.sum("n").alias("n")).collect()
    vocab = Vocabulary(top.tolist(), np.zeros(CLASSES), words, n, counts if level else None)
    vocab.counts[np.searchsorted(vocab.words, top.astype(U64)) + 1] = n[: len(top)]
    for r in sums:
        vocab.counts[r["rare"]] = r["n"]
    return vocab


def _exp(z: np.ndarray) -> np.ndarray:
    """exp(z) in place, a row's values scaled alike where they would leave the range of float32; and the logs of the scales."""
    if z.max(initial=0.0) > 60 or z.min(initial=0.0) < -60:
        most = z.max(axis=1)
        z -= most[:, None]
        np.exp(z, out=z)
        return most
    np.exp(z, out=z)
    return np.float32(0)


class Network:
    """Embeddings of the neighbours, one hidden layer, softmax over classes. ``flat`` holds all weights."""

    SHAPES = ((CLASSES, WIDTH), (2 * SIDE * WIDTH, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))
    SIZE = sum(int(np.prod(s)) for s in SHAPES)

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        self.parts, at = [], 0
        for s in self.SHAPES:
            n = int(np.prod(s))
            self.parts.append(self.flat[at : at + n].reshape(s))
            at += n

    @classmethod
    def initial(cls, counts: np.ndarray) -> Network:
        rng = np.random.default_rng(11)
        net = cls(np.zeros(cls.SIZE, np.float32))
        emb, a, _, b, bias = net.parts
        emb[:] = rng.standard_normal(emb.shape) * 0.3
        a[:] = rng.standard_normal(a.shape) / np.sqrt(a.shape[0])
        b[:] = rng.standard_normal(b.shape) * 0.1
        bias[:] = np.log((counts + 1) / (counts.sum() + CLASSES))
        return net

    def train(self, around: np.ndarray, target: np.ndarray, held: list[np.ndarray]) -> None:
        """One step of AdaGrad on the (n, 2 * SIDE) neighbours of n masked tokens; ``held``: squared gradients."""
        emb, a, ab, b, bb = self.parts
        n = len(target)
        v = emb[around].reshape(n, -1)
        h = np.maximum(v @ a + ab, 0)
        p = h @ b
        p += bb
        _exp(p)
        p *= (1 / (n * (p @ np.ones(CLASSES, np.float32))))[:, None]
        p[np.arange(n), target] -= np.float32(1 / n)
        g = (p @ b.T) * (h > 0)
        at = (around[:, :, None] * WIDTH + np.arange(WIDTH)).ravel()
        ge = np.bincount(at, (g @ a.T).ravel(), CLASSES * WIDTH).astype(np.float32).reshape(emb.shape)
        for q, grad, s in zip(self.parts, (ge, v.T @ g, g.sum(0), h.T @ p, p.sum(0)), held, strict=True):
            s += grad * grad
            q -= RATE * grad / (np.sqrt(s) + 1e-6)

    def log_probabilities(self, line: np.ndarray) -> np.ndarray:
        """Of each class of a line from its neighbours; the line has SIDE zeros around each document."""
        emb, a, ab, b, bb = self.parts
        tables = [(emb @ a[k * WIDTH : (k + 1) * WIDTH]) for k in range(2 * SIDE)]
        shifts = [s for s in range(-SIDE, SIDE + 1) if s]
        out = np.zeros(len(line), np.float32)
        for lo in range(SIDE, len(line) - SIDE, BLOCK):
            hi = min(lo + BLOCK, len(line) - SIDE)
            h = ab + tables[0][line[lo + shifts[0] : hi + shifts[0]]]
            for t, s in zip(tables[1:], shifts[1:], strict=True):
                h += t[line[lo + s : hi + s]]
            z = np.maximum(h, 0, out=h) @ b
            z += bb
            own = z[np.arange(hi - lo), line[lo:hi]]
            scale = _exp(z)
            out[lo:hi] = own - scale - np.log(z @ np.ones(CLASSES, np.float32))
        return out


def _lines(column: pa.Array, vocab: Vocabulary, size: int = 1 << 14) -> Iterator[tuple[np.ndarray, list[tuple[int, int]], list[np.ndarray]]]:
    """Lines of documents' classes with SIDE zeros around each, where each document stands, and its words."""
    gap = np.zeros(SIDE, np.int64)
    parts, spans, held, at = [gap], [], [], SIDE
    for w, end in document_words_and_endings(column):
        c = vocab.classes(w, end)
        parts += [c, gap]
        spans.append((at, at + len(c)))
        held.append(w)
        at += len(c) + SIDE
        if at > size:
            yield np.concatenate(parts), spans, held
            parts, spans, held, at = [gap], [], [], SIDE
    if spans:
        yield np.concatenate(parts), spans, held


def masked(line: np.ndarray, spans: list[tuple[int, int]], turn: int, mask_one_in: int) -> np.ndarray:
    """Places of the tokens that are targets in a pass."""
    spots = [np.arange(a + (int(line[a : a + 64].sum()) + turn) % min(mask_one_in, b - a), b, mask_one_in) for a, b in spans if b > a]
    return np.concatenate(spots) if spots else np.zeros(0, np.int64)


def fit(docs: DataFrame, rounds: int = ROUNDS, mask_one_in: int = MASK_ONE_IN) -> tuple[Vocabulary, Network]:
    """Vocabulary and network of all rows (text)."""
    spark = docs.sparkSession
    vocab = vocabulary(docs)
    net = Network.initial(vocab.counts)
    shifts = np.array([s for s in range(-SIDE, SIDE + 1) if s])
    for turn in range(rounds if vocab.counts.sum() else 0):
        shared = spark.sparkContext.broadcast((vocab, net.flat))

        def each(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:
            own = Network(shared.value[1].copy())
            held = [np.full(s, 1e-4, np.float32) for s in Network.SHAPES]
            seen = 0
            for batch in batches:
                for line, spans, _ in _lines(batch.column(0), shared.value[0]):
                    spots = masked(line, spans, turn, mask_one_in)
                    spots = np.random.default_rng(len(line)).permutation(spots)
                    for lo in range(0, len(spots), BATCH):
                        at = spots[lo : lo + BATCH]
                        own.train(line[at[:, None] + shifts], line[at], held)
                    seen += len(spots)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(Network.SIZE, dtype=np.int32)), pa.array(own.flat.astype(np.float64) * seen), pa.array(np.full(Network.SIZE, float(seen)))], ["at", "w", "n"])

        sums = docs.select("text").mapInArrow(each, "at int, w double, n double").groupBy("at").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()
        if len(sums):
            flat = np.zeros(Network.SIZE, np.float32)
            flat[sums["at"].to_numpy()] = sums["w"].to_numpy()
            net = Network(flat)
    return vocab, net


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, mask_one_in: int = MASK_ONE_IN) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_probability) for each row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    vocab, net = fit(docs, rounds, mask_one_in)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, net.flat))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, flat = shared.value
        net = Network(flat)
        for batch in batches:
            n, total, ends, words, times = [], [], [0], [], []
            for line, spans, held in _lines(batch.column(1), vocab):
                p = net.log_probabilities(line)
                for (a, b), w in zip(spans, held, strict=True):
                    share, others = vocab.log_shares(w, line[a:b])
                    others, many = np.unique(others, return_counts=True)
                    n.append(b - a)
                    total.append(float(p[a:b].sum(dtype=np.float64)) + share)
                    ends.append(ends[-1] + len(others))
                    words.append(others.astype(np.int64))
                    times.append(many.astype(np.int64))
            flat_words = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (words, times)], ["word", "times"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat_words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(total, pa.float64()), rest], ["doc_id", "n_tokens", "log_likelihood", "rest"])

    scored = docs.mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, log_likelihood double, rest array<struct<word: long, times: long>>")
    if vocab.table is not None:
        scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        lacking = scored.select("row", F.inline("rest")).join(vocab.table, "word").groupBy("row").agg(F.sum(F.col("times") * F.log("n")).alias("lacking"))
        scored = scored.drop("rest").join(lacking, "row", "left").withColumn("log_likelihood", F.col("log_likelihood") + F.coalesce("lacking", F.lit(0.0)))
    return scored.select("doc_id", "n_tokens", "log_likelihood", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")).alias("mean_log_probability"))
