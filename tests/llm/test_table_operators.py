"""Vectors, URLs, archives and the pipeline against brute force."""

import math
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import fixity, queries, url_filter, vectors

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[20].tolist()) for i in range(60)]  # copies of a query
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [math.nan] + [1.0] * 7), (2060, [1.0] * 7), (2080, [None] + [1.0] * 7), (None, x[0].tolist()), (2100, [math.inf] * 8), (40, x[40].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"label": F.lit(1), "v": F.lit("x"), "part": F.lit(0)})
    found = vectors.nearest(frame, sample=300).toPandas()
    good = {i: np.array(v) for i, v in rows if i is not None and i < 2000}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(found["query_id"].unique()) == asked
    hits = 0
    for q in asked:
        own = found[found["query_id"] == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21)) and q not in own["vec_id"].tolist()
        exact = np.array([good[q] @ good[v] for v in own["vec_id"]])
        assert np.allclose(own["score"], exact, atol=1e-12)
        assert [(-s, v) for s, v in zip(own["score"], own["vec_id"], strict=True)] == sorted((-s, v) for s, v in zip(own["score"], own["vec_id"], strict=True))
        s = m @ good[q]
        order = [ids[j] for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        hits += len(set(order) & set(own["vec_id"]))
    assert hits / (20 * len(asked)) >= 0.9
    assert vectors.nearest(frame.limit(0)).count() == 0
    few = vectors.nearest(frame.where("vec_id in (20, 21, 22)")).orderBy("rank").collect()
    assert [r["rank"] for r in few] == [1, 2]


@pytest.mark.parametrize(("cell", "queries"), [(vectors.CELL, vectors.QUERIES), (40, 7)])
def test_routing_prunes_clusters(spark, monkeypatch, cell, queries):
    """Many parts: at most half of the vectors are scored where there are clusters, and the recall holds; parts in cells and blocks."""
    monkeypatch.setattr(vectors, "QUERIES", queries)
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16)) * 3
    x = centres[rng.integers(0, 40, 5000)] + rng.standard_normal((5000, 16))
    x[:1600] = x[0] + 0.01 * rng.standard_normal((1600, 16))  # a third in one place
    router, mass = vectors.fit(x[rng.permutation(5000)[:3000]], 20, 5000)
    own = router.best(x.astype(np.float32))
    sizes = np.bincount(own, minlength=router.parts)
    asked = np.arange(0, 5000, 20)
    scored = ((router.before(x[asked].astype(np.float32)) <= mass) * sizes).sum(axis=1).mean() / 5000
    assert router.parts == 20 and scored <= 0.5
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vectors.nearest(frame, sample=3000, cell=cell).toPandas()
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -np.inf
    hits = [len(set(np.argsort(-s[i], kind="stable")[:20]) & set(found.loc[found["query_id"] == q, "vec_id"])) for i, q in enumerate(asked)]
    assert sum(hits) / (20 * len(asked)) >= 0.9 and found.groupby("query_id").size().eq(20).all()


def test_router_ties():
    """Vectors that the router cannot tell apart go to one part and probe the same ones."""
    router = vectors.Router(np.zeros((0, 3), np.float32), np.zeros(0, np.int64), np.random.default_rng(0))
    router.parts, router.c, router.e = 4, np.zeros((128, 4), np.float32), np.zeros(4, np.float32)
    x = np.ones((5, 3), np.float32)
    assert router.best(x).tolist() == [0] * 5 and np.allclose(router.before(x), [[0, 0.25, 0.5, 0.75]] * 5)


def test_balanced_parts():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((100, 5)) + 6 * np.eye(5)[k] for k in range(4)]).astype(np.float32)
    label = vectors.balanced_parts(x, vectors.neighbours(x, 10), 4, rng)
    assert np.bincount(label).tolist() == [100] * 4
    assert np.mean([np.bincount(label[k * 100 : k * 100 + 100], minlength=4).max() for k in range(4)]) > 80


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), v, h + p) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, "allow", None))
    return host, path, best[2], best[1]


@pytest.mark.parametrize("bound", [url_filter.BROADCAST_RULES, 0])
def test_urls(spark, bound):
    rng = random.Random(2)
    rules = [*url_filter.RULES, ("example.org", "/a/b", "block"), ("x.net", "", "allow"), ("net", "/x", "allow"), ("dup.com", "/", "allow"), ("dup.com", "/", "block")]
    hosts = ["a.example.net", "example.net", "EXAMPLE.com", "notexample.com", "org", "b.org", "x.net", "", ".net", "a..net", "example.org", "dup.com", "net:80", "u@x.net"]
    paths = ["", "/", "/en/", "/en", "/english/", "/de/x", "/fr//", "/a/bc", "/a/", "/x/y?q=/de/", "?a", "#b", "/en/\nx"]
    urls = [f"{s}{h}{p}" for s in ("http://", "HTTPS://", "") for h in hosts for p in paths] + [None, "", "://", "a://b://c.net/", "http://" + ".".join("abc" * 100) + ".net/" + "d/" * 2000]
    rng.shuffle(urls)
    urls += urls[:20]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(1), "key": F.lit(2), "rule": F.lit("r")})
    frame = spark.createDataFrame([*rules, (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, frame, broadcast_rules=bound).collect()}
    assert found == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), frame).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, frame.limit(0)).collect()} == {"allow"}


def test_fixity(spark):
    rng = random.Random(5)
    left, at = [], [0, 0, 0]
    for i in range(300):
        a = 0 if i % 3 else rng.randrange(3)
        n = rng.randrange(1, 500)
        left.append((a, at[a], n, f"h{i}"))
        at[a] += n
    right = list(left)
    want = set()
    for i in rng.sample(range(300), 12):
        a, off, n, h = left[i]
        right.remove(left[i])
        if i % 2:
            right.append((a, off, n, h + "x"))
            want.add((a, off, n, "changed"))
        else:
            want.add((a, off, n, "missing"))
    right += [left[5]] if left[5] in right else []
    if left[5] in right:
        want.add((*left[5][:3], "extra"))
    right.append((7, 0, 3, "new"))
    want.add((7, 0, 3, "extra"))
    kind = "archive long, offset long, length long, hash string"
    a, b = spark.createDataFrame([*left, (None, 1, 2, "u")], kind), spark.createDataFrame(right, kind)
    for size, fanout in ((64, 2), (1000, 4), (1 << 16, 16)):
        found = fixity.audit(a, b, size, fanout).collect()
        assert {(r.archive, r.offset, r.length, r.finding) for r in found} == want | {(None, 1, 2, "unplaced")}
    assert fixity.audit(a, a).where("finding <> 'unplaced'").count() == 0
    assert fixity.audit(a.limit(0), b.limit(0)).count() == 0
    roots = [fixity.tree(x, 3, 1000, 4)[-1] for x in (a, b)]
    assert roots[0].count() == 3 and roots[0].join(roots[1], ["archive", "hash"]).count() < 3


def test_null_payloads(spark):
    rows = spark.createDataFrame([(0, 0, 1, None), (0, 1, 1, bytearray())], "archive long, offset long, length long, payload binary")
    assert rows.transform(fixity.leaves).select("hash").distinct().count() == 2


def test_warc_index_of_odd_rows(spark):
    """Rows that tie on id, URL and length stand in the order of their hashes, however they are dealt; null ids have no place."""
    rows = [(1, "u", "aa"), (1, "u", "bb"), (1, "u", "cc"), (2, None, None), (3, "v", "x" * 200_000), (None, "u", "a"), (None, None, None), (250, "w", "")]
    kind = "page_id long, url string, html string"
    seen = set()
    for order in (rows, rows[::-1]):
        pages = spark.createDataFrame(order, kind).repartition(5).withColumns({"archive": F.lit("x"), "hash": F.lit("y"), "id": F.lit(1), "offset": F.lit(2)})
        found = fixity.warc_index(pages.select("page_id", "url", "html", "archive", "hash", "id", "offset"), also={"more": lambda payload: F.concat(payload, payload)})
        seen.add(tuple(sorted(map(str, found.collect()))))
        placed = found.where("archive = 0").orderBy("offset").collect()
        assert [r.id for r in placed] == [1, 1, 1, 2, 3] and all(x.offset + x.length == y.offset for x, y in zip(placed, placed[1:], strict=False))
        assert [r.hash for r in placed[:3]] == sorted(r.hash for r in placed[:3])
        assert found.where("id is null and offset is null and archive is null").count() == 2
        assert fixity.audit(found, found).where("finding <> 'unplaced'").count() == 0
    assert len(seen) == 1
    assert fixity.warc_index(spark.createDataFrame([], kind)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = con.execute(queries.ORACLE_SQL[name]).df()[list(got.columns)]
    plain = lambda f: sorted(map(repr, f.astype(object).where(f.notna(), None).itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
