"""Numbering, chains, durability, pages: small logs with results worked out by hand, and a plain replay model."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import durability as D
from palimpsest.operators import log as L
from palimpsest.operators import order
from palimpsest.operators import pages as P
from palimpsest.operators.order import range_of, with_position, with_running, with_running_sum
from palimpsest.schema import Corruption

COLUMNS = "lsn bigint, page_id bigint, offset int, data binary, is_mtr_end boolean, batch_id bigint"


def make(spark, rows):
    """(lsn, page, end) or (lsn, page, offset, hex, end, batch)."""
    full = [(r[0], r[1], 0, bytearray(b"x"), bool(r[2]), r[0]) if len(r) == 3 else (r[0], r[1], r[2], bytearray.fromhex(r[3]), bool(r[4]), r[5]) for r in rows]
    return spark.createDataFrame(full, COLUMNS)


@pytest.mark.parametrize(
    ("rows", "vcl", "vdl", "kept"),
    [
        ([(1, 1, 0), (2, 2, 0), (3, 1, 1)], 3, 3, 3),
        ([(1, 1, 0), (2, 2, 0), (3, 1, 1), (4, 3, 0), (5, 1, 0)], 5, 3, 3),
        ([(1, 1, 1), (2, 2, 1), (4, 4, 1)], 2, 2, 2),
        ([(4, 1, 0), (5, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)], 5, 5, 5),
        ([(2, 1, 1)], 0, 0, 0),
        ([(1, 1, 1), (1, 1, 1), (2, 0, 1)], 2, 2, 3),
        ([], 0, 0, 0),
    ],
)
def test_recovery(spark, rows, vcl, vdl, kept):
    found = D.recover(make(spark, rows))
    assert (found.vcl, found.vdl, found.log.count()) == (vcl, vdl, kept)
    again = D.recover(found.log)
    assert (again.vdl, again.log.count(), again.truncated_rows) == (vdl, kept, 0)
    want = {}
    for lsn, page, *_ in rows:
        if lsn <= vdl:
            want[page] = max(lsn, want.get(page, 0))
    assert {r.page_id: r.latest_lsn for r in found.index.collect()} == want


def test_live_and_recovered_state_differ_with_a_gap(spark):
    log = make(spark, [(1, 1, 1), (3, 1, 1)])
    assert tuple(D.live_state(log).first()) == (3, 3)
    assert tuple(D.durability(log).first()) == (1, 1)


def test_numbering_and_groups(spark):
    writes = spark.createDataFrame([(b, p, 1) for b in range(1, 40) for p in range(3)], "batch_id long, pos int, page_id long")
    rows = L.mark_ends(L.assign_lsns(writes, 7)).orderBy("lsn").collect()
    assert [r.lsn for r in rows] == list(range(7, 7 + 117))
    assert [r.is_mtr_end for r in rows] == [r.pos == 2 for r in rows]
    groups = L.mtr_groups(spark.createDataFrame(rows)).orderBy("lsn").collect()
    assert [r.group_no for r in groups] == [r.batch_id for r in rows]


def test_running_sums_with_ties(spark):
    df = spark.createDataFrame([(i // 5, i, 2) for i in range(50)], "a long, b long, v long")
    assert [r.s for r in with_running_sum(df, ["a", "b"], "v", "s").orderBy("a", "b").collect()] == [2 * (i + 1) for i in range(50)]
    assert with_position(df.limit(0), ["a"], "n").count() == 0


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_running_values_of_keys(spark, monkeypatch, parts):
    """A hot key, one large batch, nulls: sums, maxima and last values against a plain loop."""
    rng = random.Random(parts)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), 7 if i < 120 else i // 9, i, rng.randrange(100), rng.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(rng.sample(rows, 300), "k string, a long, b long, v long, w long")
    made = {"s": ("sum", "v"), "m": ("max", "v"), "l": ("last", "w")}
    for before in (False, True):
        want, seen = {}, {}
        for k, a, b, v, w in sorted(rows, key=lambda r: r[1:3]):
            own = seen.setdefault(k, [0, None, None])
            if before:
                want[b] = tuple(own)
            own[:] = own[0] + v, v if own[1] is None else max(own[1], v), own[2] if w is None else w
            if not before:
                want[b] = tuple(own)
        want_before = want if before else None
        found = with_running(df, ["a", "b"], made, ["k"], parts, before).collect()
        assert {r.b: (r.s, r.m, r.l) for r in found} == want
    monkeypatch.setattr(order, "RANGE_ROWS", 100)
    both = with_running(df, ["a", "b"], made, ["k"], before=True).collect()  # the hot key in ranges, the others as they are
    assert {r.b: (r.s, r.m, r.l) for r in both} == want_before
    spread = df.groupBy(range_of(df, ["a", "b"], 8).alias("r")).count().collect()
    assert max(r["count"] for r in spread) < 100


def test_links_and_lost_writes(spark):
    log = make(spark, [(1, 1, 0, "aa", 0, 1), (2, 1, 4, "bb", 1, 1), (3, 2, 0, "cc", 1, 2), (4, 1, 0, "dd", 1, 3)])
    assert {r.lsn: r.prev_lsn for r in L.link_previous(log).collect()} == {1: 0, 2: 1, 3: 0, 4: 2}
    compat = L.link_previous(log, compat=True)
    assert {r.lsn: r.prev_lsn for r in compat.collect()} == {1: 0, 2: 0, 3: 0, 4: 2}
    assert [r.lsn for r in L.lost_writes(log).collect()] == [1]
    assert sorted(r.lsn for r in L.reachable(log).collect()) == [2, 3, 4]
    assert {r.lsn: (r.depth, r.first_lsn) for r in L.chain_walk(compat).collect()} == {1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (2, 2)}
    strict = L.link_previous(log)
    assert {r.lsn: (r.depth, r.first_lsn) for r in L.chain_walk(strict).collect()} == {1: (1, 1), 2: (2, 1), 3: (1, 3), 4: (3, 1)}
    assert sorted(r.lsn for r in L.chain(strict, 1, 2).collect()) == [1, 2]
    with pytest.raises(Corruption):
        L.chain_walk(strict.where("lsn <> 1"))
    assert L.broken_links(strict.where("lsn <> 1")).first()["lsn"] == 2


@pytest.mark.parametrize("most", [40, 1 << 20])
def test_compat_links_against_a_plain_loop(spark, monkeypatch, most):
    """Batches of several records of a page, LSNs not in batch order, one crowded page."""
    monkeypatch.setattr(order, "RANGE_ROWS", most)
    rng = random.Random(6)
    rows = [(i + 1, rng.choice([0, 0, 0, 1, 2]), 0, "aa", 1, rng.randrange(60)) for i in range(240)]
    want = {lsn: max((r[0] for r in rows if r[1] == page and r[5] < batch), default=0) for lsn, page, *_, batch in rows}
    linked = L.link_previous(make(spark, rng.sample(rows, len(rows))), compat=True)
    assert {r.lsn: r.prev_lsn for r in linked.collect()} == want and set(linked.columns) == {*make(spark, rows).columns, "prev_lsn"}


def test_compat_links_shuffle_once(spark):
    """Pages that are not crowded are dealt and sorted once, and joined with nothing."""
    log = make(spark, [(i + 1, i % 3, 0, "01", 1, i // 2) for i in range(30)])
    plan = L.link_previous(log, compat=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_ranges_by_halving(spark):
    """The range of a value is the number of bounds below it, for values, ties and nulls, in log n steps a row."""
    bounds = [float(x) for x in range(0, 1998, 2)]
    values = spark.createDataFrame([(float(x),) for x in [-5, 0, 1, 2, 3, 997, 1996, 1997, 5000]] + [(None,)], "v double")
    found = values.select("v", order._below(F.array(*[F.lit(b) for b in bounds]), len(bounds), F.col("v")).alias("r")).collect()
    assert {r.v: r.r for r in found} == {v: sum(b < v for b in bounds) if v is not None else 0 for v in [-5.0, 0.0, 1.0, 2.0, 3.0, 997.0, 1996.0, 1997.0, 5000.0, None]}


def image(spark, log, rp=1 << 62, page=1):
    row = P.snapshot(log, rp).where(F.col("page_id") == page).first()
    return bytes(row["page"]) if row else None


def test_pages(spark):
    log = make(spark, [(1, 1, 0, "1122", 1, 1), (2, 1, 4, "3344", 1, 2), (3, 1, 0, "FF", 1, 3), (4, 2, 8190, "EEFF", 1, 4), (5, 3, 8192, "", 1, 5), (6, 0, 100, "68690a", 1, 6)])
    assert image(spark, log)[:6].hex() == "ff2200003344"
    assert image(spark, log, 2)[:6].hex() == "112200003344"
    assert image(spark, log, 0) is None
    assert image(spark, log, page=2)[-2:].hex() == "eeff"
    assert image(spark, log, page=3) == bytes(8192)
    assert image(spark, log, page=0)[99:104].hex() == "0068690a00"
    fold = {r.page_id: bytes(r.page) for r in P.fold_snapshot(log, 1 << 62).collect()}
    assert fold == {r.page_id: bytes(r.page) for r in P.snapshot(log, 1 << 62).collect()}
    base = P.snapshot(log, 2)
    mixed = {r.page_id: (bytes(r.page), r.chain_len, r.last_lsn) for r in P.snapshot(log, 6, base, 2).collect()}
    assert mixed == {r.page_id: (bytes(r.page), r.chain_len, r.last_lsn) for r in P.snapshot(log, 6).collect()}
    diff = {(r.page_id, r.place): (r.old_byte, r.new_byte) for r in P.page_diff(log, 2, 3).collect()}
    assert diff == {(1, 0): ("11", "FF")}


def test_overflow(spark):
    good, bad = make(spark, [(1, 1, 8191, "AA", 1, 1)]), make(spark, [(1, 1, 8191, "AABB", 1, 1), (2, 1, 0, "AA", 1, 1), (3, 1, 0, "AA", 1, 2)])
    assert image(spark, good)[-1:] == b"\xaa"
    with pytest.raises(Exception, match="exceeds the page"):
        image(spark, bad)
    assert [r.lsn for r in L.rejected_writes(bad).collect()] == [1]
    assert [r.lsn for r in L.accepted_writes(bad).collect()] == [3]


def test_reads(spark):
    log = make(spark, [(1, 1, 0, "01", 1, 1), (2, 1, 0, "02", 1, 2), (3, 1, 0, "03", 1, 3)])
    asked = spark.createDataFrame([(i, 1, rp) for i, rp in enumerate([1, 2, 3, 0, 100])] + [(9, 5, 3)], "req_id long, page_id long, read_point long")
    assert {r.req_id: r.status for r in P.read_status(asked, log, 3).collect()} == {0: "ok", 1: "ok", 2: "ok", 3: "not_found", 4: "beyond_durable", 9: "not_found"}
    assert {r.req_id: r.page[0] for r in P.asof_reads(asked, log, 3).collect()} == {0: 1, 1: 2, 2: 3}
    blank = make(spark, [(1, 4, 0, "", 1, 1), (2, 4, 8190, "0a0b", 1, 2), (3, 5, 0, "01", 1, 3)])
    asked = spark.createDataFrame([(1, 4, 1), (2, 4, 2), (3, 4, 3), (4, 5, 2)], "req_id long, page_id long, read_point long")
    assert {r.req_id: bytes(r.page)[-2:].hex() for r in P.asof_reads(asked, blank, 3).collect()} == {1: "0000", 2: "0a0b", 3: "0a0b"}
    assert [(r.version, r.lsn, r.valid_until) for r in P.version_history(log).orderBy("lsn").collect()] == [(1, 1, 2), (2, 2, 3), (3, 3, None)]


def test_random_logs_against_a_replay(spark):
    rng = random.Random(5)
    rows = [(i + 1, rng.randrange(4), rng.randrange(60), rng.randbytes(rng.randrange(12)).hex(), rng.random() < 0.4, i) for i in range(120)]
    log = make(spark, rows)
    for rp in (17, 80, 120):
        want = {}
        for lsn, page, off, data, *_ in rows:
            if lsn <= rp:
                own = want.setdefault(page, bytearray(8192))
                own[off : off + len(data) // 2] = bytes.fromhex(data)
        assert {r.page_id: bytes(r.page) for r in P.snapshot(log, rp).collect()} == {k: bytes(v) for k, v in want.items()}
        asked = spark.createDataFrame([(p, p, rp) for p in range(5)], "req_id long, page_id long, read_point long")
        assert {r.page_id: bytes(r.page) for r in P.asof_reads(asked, log, 120).collect()} == {k: bytes(v) for k, v in want.items()}


def replayed(rows, asked):
    """The images that requests see, by a plain replay for each."""
    want = {}
    for req, page, rp in asked:
        for lsn, p, off, data, *_ in rows:
            if p == page and lsn <= rp:
                own = want.setdefault(req, bytearray(8192))
                own[off : off + len(data) // 2] = bytes.fromhex(data)
    return {k: bytes(v) for k, v in want.items()}


@pytest.mark.parametrize("most", [30, 1 << 20])
def test_as_of_reads_of_a_crowded_page(spark, monkeypatch, most):
    """Page 0 has most records and requests, many of these for one read point; page 3 has blank records only."""
    monkeypatch.setattr(order, "RANGE_ROWS", most)
    rng = random.Random(9)
    rows = [(i + 1, rng.choice([0, 0, 0, 1, 2]), rng.randrange(8180), rng.randbytes(rng.randrange(12)).hex(), 1, i) for i in range(150)] + [(i, 3, 5, "", 1, i) for i in range(200, 290)]
    asked = [(i, rng.choice([0, 0, 1, 2, 4]), rng.randrange(160)) for i in range(150)] + [(i, 0, 70) for i in range(150, 220)] + [(i, 3, i) for i in range(220, 300)]
    found = P.asof_reads(spark.createDataFrame(rng.sample(asked, len(asked)), "req_id long, page_id long, read_point long"), make(spark, rows), 280).collect()
    want = replayed(rows, [a for a in asked if a[2] <= 280])
    assert len(found) == len(want) and {r.req_id: bytes(r.page) for r in found} == want
    assert {r.req_id: (r.req_id, r.page_id, r.read_point) for r in found} == {a[0]: a for a in asked if a[0] in want}


def test_as_of_reads_shuffle_no_image(spark):
    """Rows that are shuffled are as narrow as records; the images are made after the last exchange."""
    log = make(spark, [(i + 1, i % 3, 0, "01", 1, i) for i in range(30)])
    asked = spark.createDataFrame([(i, i % 3, i) for i in range(30)], "req_id long, page_id long, read_point long")
    plan = P.asof_reads(asked, log, 30)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and plan.index("MapInArrow") < plan.index("Exchange" if "Exchange" in plan else "Repartition")
