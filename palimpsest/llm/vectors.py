"""Approximate nearest neighbours over learned partitions.

Fit.  On a bounded sample of distinct vectors (``sample``, drawn by a hash) the neighbour
graph is built in blocks and partitioned in balance: the graph is smoothed from a random
projection of its nodes and split at the median, again and again, so that all parts have
equal size and few edges are cut.  There are as many parts as PART_ROWS vectors each need,
and no more than PART_SAMPLE sampled vectors each allow.  A small softmax classifier then
learns to tell a vector's part.  A query probes its most probable parts until they hold the
probability ``mass`` that, on held-out vectors of the sample, finds PROBE_RECALL of their
neighbours, and more by a margin that shrinks with their number: a query in the middle of a part probes few, one between parts more.

Index and search.  Every distinct vector goes to its most probable part, every query to those
it probes, and both meet in an equi-join on part.  A part of many vectors is cut into cells of
about ``cell``, its queries into blocks of about QUERIES, and each cell meets each block in a
group of its own, so no task holds more of either side; each cell returns its best ``k`` + 1
for a query.  Candidates are reranked by the inner product in double precision.

Copies.  Equal vectors are one, and carry their ``k`` + 1 smallest ids: with ties going to
the smaller id, no answer needs more of them, so this loses nothing.  Equal queries are
searched once.

Defined results: vectors that are null, zero, or of another length than most, or hold null or
non-finite components take no part as queries or candidates; nor do null ids; a query
with fewer candidates gets all of them; repeated rows of one id and vector count once; an
empty table gives none; columns other than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import materialize

SAMPLE = 10_000
PART_ROWS = 250  # vectors in a part, about, as long as the sample tells so many parts apart
PART_SAMPLE = 125
HELD_OUT = 1000
PROBE_RECALL = 0.92
MARGIN = 0.4  # by the root of the number of held-out vectors: two standard errors, where a query's recall varies by 0.2
CELL = 4000
QUERIES = 4000
NEIGHBOURS = 20


def neighbours(x: np.ndarray, k: int, block: int = 1000) -> np.ndarray:
    """For each row the k others with the largest inner product, in blocks of rows."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), block):
        s = x[lo : lo + block] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        out[lo : lo + block] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Equal parts (up to one) with few cut edges: recursive bisection along a smoothed direction of the graph."""
    label = np.zeros(len(x), np.int64)
    todo, done = [(np.arange(len(x)), parts)], 0
    while todo:
        rows, n = todo.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = done
            done += 1
            continue
        inside = np.full(len(x), -1)
        inside[rows] = np.arange(len(rows))
        to = inside[graph[rows]]
        has = to >= 0
        f = x[rows] @ rng.standard_normal((x.shape[1], 4)).astype(x.dtype)
        for _ in range(30):  # power steps of the lazy walk, kept apart from the constant direction
            f = 0.5 * f + 0.5 * (np.where(has[..., None], f[np.maximum(to, 0)], 0).sum(1) / np.maximum(has.sum(1), 1)[:, None])
            f, _ = np.linalg.qr(f - f.mean(0))
        cut = [abs(np.where(has, (f[:, c] > np.median(f[:, c]))[np.maximum(to, 0)] != (f[:, c] > np.median(f[:, c]))[:, None], False).sum()) for c in range(f.shape[1])]
        order = np.argsort(f[:, int(np.argmin(cut))], kind="stable")
        half = len(rows) * (n // 2) // n
        todo += [(rows[order[:half]], n // 2), (rows[order[half:]], n - n // 2)]
    return label


class Router:
    """Softmax over one hidden layer: a vector's most probable parts."""

    def __init__(self, x: np.ndarray, label: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 30):
        n, d = x.shape
        self.parts = int(label.max()) + 1 if n else 1
        self.scale = np.float32(np.sqrt(d) / max(1e-12, np.sqrt((x**2).sum(1).mean()))) if n else np.float32(1)
        self.a = (rng.standard_normal((d, hidden)) / np.sqrt(d)).astype(np.float32)
        self.b = np.zeros(hidden, np.float32)
        self.c = (rng.standard_normal((hidden, self.parts)) / np.sqrt(hidden)).astype(np.float32)
        self.e = np.zeros(self.parts, np.float32)
        held = [np.zeros_like(p) for p in (self.a, self.b, self.c, self.e)]
        square = [np.zeros_like(p) for p in (self.a, self.b, self.c, self.e)]
        t = 0
        for _ in range(epochs if self.parts > 1 else 0):
            order = rng.permutation(n)
            for lo in range(0, n, 256):
                rows = order[lo : lo + 256]
                v = x[rows] * self.scale
                h = np.maximum(v @ self.a + self.b, 0)
                p = self._soft(h @ self.c + self.e)
                p[np.arange(len(rows)), label[rows]] -= 1
                p /= len(rows)
                g = (p @ self.c.T) * (h > 0)
                t += 1
                for q, grad, m, s in zip((self.a, self.b, self.c, self.e), (v.T @ g, g.sum(0), h.T @ p, p.sum(0)), held, square, strict=True):
                    m += 0.1 * (grad - m)
                    s += 0.01 * (grad * grad - s)
                    q -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._soft(np.maximum((x * self.scale) @ self.a + self.b, 0) @ self.c + self.e)

    def before(self, x: np.ndarray) -> np.ndarray:
        """For each vector and part the probability of the parts that are more probable (of equals, come first)."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        held = np.take_along_axis(p, order, 1)
        out = np.empty_like(p)
        np.put_along_axis(out, order, np.cumsum(held, axis=1) - held, 1)
        return out

    def best(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(axis=1)


def fit(x: np.ndarray, k: int, n: int, seed: int = 7) -> tuple[Router, float]:
    """A router over the sample of n vectors, and the mass to probe."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    parts = max(1, min(n // PART_ROWS, len(x) // PART_SAMPLE))
    if parts == 1:
        return Router(x, np.zeros(len(x), np.int64), rng), 1.0
    order = rng.permutation(len(x))
    held, x = x[order[: min(HELD_OUT, len(x) // 8)]], x[order[min(HELD_OUT, len(x) // 8) :]]
    router = Router(x, balanced_parts(x, neighbours(x, NEIGHBOURS), parts, rng), rng)
    # The sample is thinner than the whole: its nearest few are as near as the whole's k nearest.
    few = max(1, min(len(x), round(k * len(x) / n)))
    near = np.argpartition(-(held @ x.T), few - 1, axis=1)[:, :few]
    needed = np.take_along_axis(router.before(held), router.best(x)[near], 1)
    return router, float(np.quantile(needed, min(1.0, PROBE_RECALL + MARGIN / np.sqrt(len(held))), method="higher"))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each query: the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.expr("vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim = sizes[0]["d"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each batch's distinct vectors with their smallest ids, and their query ids: copies are pre-aggregated."""
        for batch in batches:
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False)) if len(batch) else np.zeros((0, dim))
            ids = batch.column(0).to_numpy()
            seen: dict[bytes, list[int]] = {}
            for i in np.argsort(ids, kind="stable").tolist():
                held = seen.setdefault((x[i] + 0.0).tobytes(), [])
                if not held or held[-1] != ids[i]:
                    held.append(int(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([h[: k + 1] for h in seen.values()], pa.list_(pa.int64())), pa.array([[i for i in h if i % every == 0] for h in seen.values()], pa.list_(pa.int64()))], ["v", "ids", "queries"])

    parts = rows.where(F.size("v") == dim).mapInArrow(packed, "v binary, ids array<long>, queries array<long>")
    # The ids of a vector: a bounded list, merged in two steps so that copies never meet in one large group.
    few = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    salted = parts.select("v", "ids", F.pmod(F.xxhash64("ids"), F.lit(64)).alias("salt")).groupBy("v", "salt").agg(few)
    distinct = materialize(salted.groupBy("v").agg(few).withColumn("vid", F.xxhash64("v")), "vectors")
    asked = materialize(parts.where("size(queries) > 0").select(F.xxhash64("v").alias("vid"), "v", F.explode("queries").alias("query_id")).distinct(), "queries")

    n = distinct.count()
    bound = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    drawn = distinct.where(F.pmod(F.xxhash64("v", F.lit("sample")), F.lit(1 << 30)) < bound).select("v").toPandas()["v"]
    x = np.stack([np.frombuffer(v, np.float64) for v in sorted(drawn)]) if len(drawn) else np.zeros((0, dim))
    router, mass = fit(x, k, n)
    shared = spark.sparkContext.broadcast(router)

    def routed(probe: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, len(whole), 2048):
                    batch = whole.slice(lo, 2048)
                    v = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(len(batch), dim).astype(np.float32)
                    if probe:
                        row, part = np.nonzero(shared.value.before(v) <= mass)
                    else:
                        row, part = np.arange(len(batch)), shared.value.best(v)
                    batch = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(part.astype(np.int32))], ["vid", "v", "part"])

        return each

    place = "vid long, v binary, part int"
    index = distinct.select("vid", "v").mapInArrow(routed(False), place)
    query = asked.select("vid", "v").distinct().mapInArrow(routed(True), place)
    # A row a part: how many cells and query blocks it is cut into.
    held = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}
    come = {r["part"]: r["count"] for r in query.groupBy("part").count().collect()}
    shape = F.broadcast(spark.createDataFrame([(p, -(-c // cell), -(-come[p] // QUERIES)) for p, c in held.items() if p in come], "part int, cells int, blocks int"))
    cut = lambda col, name: F.pmod(F.xxhash64("vid", F.lit(name)), F.col(col)).cast("int").alias(name)
    every_one = lambda col, name: F.explode(F.sequence(F.lit(0), F.col(col) - 1)).alias(name)
    index = index.join(shape, "part").select("vid", "v", "part", cut("cells", "cell"), every_one("blocks", "block"))
    query = query.join(shape, "part").select("vid", "v", "part", every_one("cells", "cell"), cut("blocks", "block"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "vid": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        b = np.frombuffer(b"".join(left["v"]), np.float64).reshape(len(left), dim)
        own = left["vid"].to_numpy()
        out = []
        for lo in range(0, len(right), 256):
            part = right.iloc[lo : lo + 256]
            s = np.frombuffer(b"".join(part["v"]), np.float64).reshape(len(part), dim) @ b.T
            m = min(k + 1, s.shape[1])
            # Everything from the m-th best score on (less rounding): equal scores may go to smaller ids.
            least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m][:, None]
            i, j = np.nonzero(s >= least - 1e-12 * np.maximum(1.0, np.abs(least)))
            out.append(pd.DataFrame({"q": part["vid"].to_numpy()[i], "vid": own[j], "score": s[i, j]}))
        return pd.concat(out)

    near = index.groupBy("part", "cell", "block").cogroup(query.groupBy("part", "cell", "block")).applyInPandas(search, "q long, vid long, score double")
    best = F.expr("row_number() over (partition by q order by score desc, vid)")
    # Each query's best vectors, with the exact measure, then their ids; equal scores at the end are kept until ids decide.
    cut = F.expr(f"nth_value(score, {k + 1}) over (partition by q order by score desc, vid rows between unbounded preceding and unbounded following)")
    kept = near.withColumn("cut", cut).where("cut is null or score >= cut - 1e-9 * greatest(1, abs(cut))").drop("cut")
    kept = kept.join(distinct.select("vid", "v", "ids"), "vid").join(asked.select(F.col("vid").alias("q"), F.col("v").alias("qv")).distinct(), "q")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column("qv").to_pylist()), np.float64).reshape(len(batch), dim)
            b = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(len(batch), dim)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("ids"), pa.array(np.einsum("ij,ij->i", a, b))], ["q", "ids", "score"])

    scored = kept.select("q", "qv", "v", "ids").mapInArrow(exact, "q long, ids array<long>, score double").select("q", "score", F.explode("ids").alias("vec_id"))
    best = F.expr("row_number() over (partition by q order by score desc, vec_id)")
    top = materialize(scored.withColumn("r", best).where(F.col("r") <= k + 1).drop("r"), "nearest")
    answers = asked.select(F.col("vid").alias("q"), "query_id").join(top, "q").where("query_id <> vec_id")
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return answers.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
