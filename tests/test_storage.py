"""Segments, the binary log, the log folder, reads, traces, streams."""

import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import columns as C
from palimpsest.operators import segments as S
from palimpsest.operators.durability import recover, truncation_point
from palimpsest.operators.reads import repeated_reads, staleness
from palimpsest.operators.session import PageLog
from palimpsest.operators.trace import indexed_pages, metrics, node_state, read_trace, shared_state, write_trace
from palimpsest.schema import Corruption, LsnBeyondDurable, PageNotFound, PageOverflow
from palimpsest.sources import wal
from palimpsest.streaming.incremental import Vcl


def sized(spark, payloads, start=1):
    return spark.createDataFrame([(start + i, 1, 0, bytearray(n), i == len(payloads) - 1) for i, n in enumerate(payloads)], "lsn long, page_id long, offset int, data binary, is_mtr_end boolean")


@pytest.mark.parametrize(("most", "payloads", "want"), [(4096, [10, 10], [1, 1]), (100, [10, 10, 10], [1, 2, 3]), (60, [200, 1, 1, 300], [1, 2, 3, 4]), (512, [4] * 20, [1] * 11 + [2] * 9)])
def test_segments(spark, most, payloads, want):
    rows = S.assign_segments(sized(spark, payloads), most).orderBy("lsn").collect()
    assert [r.segment_id for r in rows] == want


def test_segments_of_random_sizes(spark):
    rng = random.Random(3)
    for most in (64, 300, 1000, 10**6):
        sizes = [rng.randrange(0, 400) for _ in range(200)]
        rows = S.assign_segments(sized(spark, sizes, 11), most, parts=7).orderBy("lsn").collect()
        assert [r.segment_id - 1 for r in rows] == list(S.iterate_sizes((s + 41 for s in sizes), most))


def test_ranges_of_records_one_at_a_time(spark):
    """A task holds one range of records and the batch in which it ends, however many ranges it is dealt."""
    sent = []

    def batches():
        for k in range(40):
            sent.append(k)
            yield S._batch(range=S.np.arange(k * 10, k * 10 + 10) // 25, lsn=S.np.arange(k * 10, k * 10 + 10), size=S.np.full(10, k))

    found = []
    for key, lsn, sizes in S._ranges(batches()):
        found.append((key, lsn.tolist(), sizes.tolist()))
        assert len(sent) <= (key + 1) * 2.5 + 1
    assert found == [(k, list(range(k * 25, k * 25 + 25)), [i // 10 for i in range(k * 25, k * 25 + 25)]) for k in range(16)]
    assert list(S._ranges(iter([S._batch(range=S.np.arange(0), lsn=S.np.arange(0), size=S.np.arange(0))]))) == []
    assert S.RANGE_RECORDS <= 100_000
    plan = S.assign_segments(sized(spark, [10] * 10), 60)._jdf.queryExecution().optimizedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan


def test_cooling_over_many_ranges(spark, monkeypatch):
    """Segments and their tiers do not depend on how many ranges the records are dealt into."""
    rng = random.Random(4)
    log = sized(spark, [rng.randrange(0, 90) for _ in range(300)], 5)
    want = sorted(S.cool(S.segment_table(S.assign_segments(log, 400)), 3).collect())
    monkeypatch.setattr(S, "RANGE_RECORDS", 7)
    assert sorted(S.cool(S.segment_table(S.assign_segments(log, 400)), 3).collect()) == want
    assert [r.tier for r in want] == ["Cold"] * (len(want) - 4) + ["Hot"] * 4


def test_cooling_with_gaps_in_the_lsns(spark, monkeypatch):
    """A range with most records comes in pieces, and records far from the others do not put the rest into one range."""
    n = 3 * S.RANGE_RECORDS + 5
    batches = [S._batch(range=S.np.zeros(b - a), lsn=S.np.arange(a, b), size=S.np.arange(a, b)) for a, b in ((0, 7), (7, n - 9), (n - 9, n))]
    pieces = list(S._ranges(iter(batches)))
    assert [len(lsn) for _, lsn, _ in pieces] == [S.RANGE_RECORDS] * 3 + [5]
    assert [int(lsn[0]) for _, lsn, _ in pieces] == [i * S.RANGE_RECORDS for i in range(4)] and all((lsn == size).all() for _, lsn, size in pieces)

    rng = random.Random(6)
    lsns = [*range(5, 300), 10**6, *range(10**12, 10**12 + 50)]
    sizes = [rng.randrange(0, 90) for _ in lsns]
    log = spark.createDataFrame([(lsn, 1, 0, bytearray(n), True) for lsn, n in zip(lsns, sizes, strict=True)], "lsn long, page_id long, offset int, data binary, is_mtr_end boolean")
    monkeypatch.setattr(S, "RANGE_RECORDS", 20)
    rows = S.assign_segments(log, 400).orderBy("lsn").collect()
    assert [r.segment_id - 1 for r in rows] == list(S.iterate_sizes((s + 41 for s in sizes), 400))
    tiers = [r.tier for r in S.cool(S.segment_table(S.assign_segments(log, 400)), 3).orderBy("id").collect()]
    assert tiers == ["Cold"] * (rows[-1].segment_id - 4) + ["Hot"] * 4
    by = S._range(log, lsns[0], lsns[-1], len(lsns), 18)
    assert log.groupBy(by.alias("range")).count().agg(F.max("count")).first()[0] <= 30


def test_cooling(spark):
    placed = S.assign_segments(sized(spark, [10] * 10), 60)
    table = S.segment_table(placed)
    assert [(r.id, r.filename, r.first_lsn, r.sealed) for r in table.orderBy("id").collect()][:2] == [(1, "wal_000001.seg", 1, True), (2, "wal_000002.seg", 2, True)]
    cold = S.cool(table, 1)
    assert cold.where("tier = 'Cold'").count() == 8 and not cold.orderBy(F.desc("id")).first()["sealed"]
    assert S.cold_read_cost(placed, cold, 100).first()["charges"] == 8
    assert S.cold_read_cost(placed, table, 100).first()["charges"] == 0
    assert S.assign_segments(sized(spark, []), 60).count() == 0


def entries(n, size=4):
    return [wal.encode_entry(i + 1, i % 2, 0, bytes([i] * size), 0, 1, i == n - 1) for i in range(n)]


def test_codec():
    assert len(wal.encode_entry(1, 42, 100, b"\xab\xcd", 0, 1, True)) == 43
    raw = b"".join(entries(5))
    assert len(raw) == 225
    assert [e[0] for e in wal.decode_entries(raw)] == [1, 2, 3, 4, 5]
    assert [e[0] for e in wal.decode_entries(raw[:-1])] == [1, 2, 3, 4]
    assert list(wal.decode_entries(raw[:60] + b"\x00" + raw[61:]))[0][0] == 1
    damaged = bytearray(raw)
    damaged[50 + 41] ^= 1
    assert [e[0] for e in wal.decode_entries(bytes(damaged))] == [1, 2]
    with pytest.raises(ValueError):
        wal.encode_entry(1, 1, 0, bytes(70_000), 0, 1, True)


def test_decoding_hands_over_few_entries_at_a_time():
    """A file of many entries is not held as rows, and many small files do not make a batch each."""
    one = wal.pa.RecordBatch.from_pydict({"path": ["wal_000001.seg"], "content": [b"".join(wal.encode_entry(i + 1, 1, 0, b"x", i, 1, True) for i in range(9_000))]})
    many = wal.pa.RecordBatch.from_pydict({"path": [f"wal_{i:06d}.seg" for i in range(1, 301)], "content": [b"".join(entries(10))] * 300})
    for given, n, files in ((one, 9_000, 1), (many, 3_000, 300)):
        made = list(wal._decoded(iter([given])))
        assert max(b.num_rows for b in made) <= wal.DECODED and len(made) == -(-n // wal.DECODED)
        assert sum(b.num_rows for b in made) == n and len({s for b in made for s in b.column("segment_id").to_pylist()}) == files


def test_torn_log_recovers_and_appends_survive(spark, tmp_path):
    raw = b"".join(wal.encode_entry(i, i, 0, b"data", 0, i, True) for i in (1, 2))
    path = tmp_path / "wal_000001.seg"
    path.write_bytes(raw + b"\xff" * 20)
    log = wal.read_wal(spark, str(path))
    assert recover(log).vdl == 2
    cut = truncation_point(log, 2).first()["file_offset"]
    assert cut == len(raw)
    path.write_bytes(path.read_bytes()[:cut] + wal.encode_entry(3, 3, 0, b"late", 0, 3, True))
    assert recover(wal.read_wal(spark, str(path))).vdl == 3


def test_appending_and_overwriting_a_binary_log(spark, tmp_path):
    spark.dataSource.register(wal.WalSource)
    path = str(tmp_path / "log")
    part = lambda lsns, segment: spark.createDataFrame([(i, i % 3, 0, bytearray([i]), 0, 1, True, segment) for i in lsns], "lsn long, page_id long, offset int, data binary, prev_lsn long, mtr_id long, is_mtr_end boolean, segment_id long")
    lsns = lambda: sorted((r.lsn, r.segment_id) for r in wal.read_wal(spark, path).collect())
    wal.write_wal(part([1, 2, 3], 1), path)
    wal.write_wal(part([4, 5], 1).union(part([6], 2)), path)
    assert lsns() == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 2)]
    with open(f"{path}/wal_000002.seg", "ab") as f:
        f.write(b"\xff" * 20)  # torn: goes with the next append
    wal.write_wal(part([7], 2), path)
    assert lsns()[-2:] == [(6, 2), (7, 2)]
    with pytest.raises(Exception, match="cannot follow"):
        wal.write_wal(part([7], 2), path)
    assert lsns()[-1] == (7, 2) and not [n for n in os.listdir(path) if "tmp" in n]
    wal.write_wal(part([1, 2], 3), path, mode="overwrite")
    assert lsns() == [(1, 3), (2, 3)] and os.listdir(path) == ["wal_000003.seg"]
    raw = bytearray(open(f"{path}/wal_000003.seg", "rb").read())
    raw[41] ^= 1
    open(f"{path}/wal_000003.seg", "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        wal.write_wal(part([9], 3), path)


def test_ends_of_files(spark, tmp_path):
    raw = b"".join(entries(5))
    damaged = bytearray(raw)
    damaged[50 + 41] ^= 1
    files = {1: raw, 2: raw[:-1], 3: bytes(damaged), 5: raw + b"\0" * 10}
    for i, content in files.items():
        (tmp_path / f"wal_{i:06d}.seg").write_bytes(content)
    found = wal.log_ends(spark.read.format("binaryFile").load(str(tmp_path)).select("path", "content"))
    assert {r.segment_id: (r.entries, r.offset, r.status) for r in found.collect()} == {1: (5, 225, "end"), 2: (4, 180, "torn"), 3: (2, 90, "damaged"), 5: (5, 225, "torn")}
    with pytest.raises(Corruption, match="entry at 90"):
        wal.read_wal(spark, str(tmp_path), strict=True)
    assert wal.read_wal(spark, str(tmp_path / "wal_000002.seg"), strict=True).count() == 4
    spark.dataSource.register(wal.WalSource)
    some = spark.read.format("redo_wal").option("start", 45).option("end", 135).load(str(tmp_path / "wal_000001.seg"))
    assert [(r.lsn, r.file_offset) for r in some.orderBy("lsn").collect()] == [(2, 45), (3, 90)]


def test_segments_by_id(spark, tmp_path):
    hot, cold = tmp_path / "hot", tmp_path / "cold"
    for folder, i in ((cold, 1), (hot, 2), (hot, 4)):
        folder.mkdir(exist_ok=True)
        (folder / f"wal_{i:06d}.seg").write_bytes(wal.encode_entry(i, 1, 0, b"x", 0, 1, True))
    manifest = {"segments": [{"id": 1, "tier": "Cold"}, {"id": 2, "tier": "Hot"}, {"id": 3, "tier": "Hot"}], "active_segment_id": 4}
    folders = [str(hot), str(cold)]
    assert sorted(r.lsn for r in wal.read_segments(spark, folders).collect()) == [1, 2, 4]
    assert sorted(r.lsn for r in wal.read_segments(spark, folders, [1, 3, 4]).collect()) == [1, 4]
    assert [r.segment_id for r in wal.missing_segments(spark, folders, manifest).collect()] == [3]
    assert [wal.open_segment(spark, *folders, manifest, i).first()["lsn"] for i in (1, 2, 4)] == [1, 2, 4]
    with pytest.raises(FileNotFoundError):
        wal.open_segment(spark, *folders, manifest, 9)


def test_source_and_sink(spark, tmp_path):
    spark.dataSource.register(wal.WalSource)
    log = sized(spark, [5, 0, 7, 30]).withColumns({"prev_lsn": F.lit(0).cast("long"), "mtr_id": F.lit(9).cast("long")})
    placed = S.assign_segments(log, 100)
    wal.write_wal(placed, str(tmp_path / "log"))
    assert sorted(os.listdir(tmp_path / "log")) == ["wal_000001.seg", "wal_000002.seg", "wal_000003.seg"]
    back = spark.read.format("redo_wal").load(str(tmp_path / "log"))
    assert sorted((r.lsn, r.segment_id, len(r.data), r.is_mtr_end) for r in back.collect()) == [(1, 1, 5, False), (2, 1, 0, False), (3, 2, 7, False), (4, 3, 30, True)]
    same = wal.decode_segments(wal.encode_segments(placed))
    assert sorted(same.select("lsn", "crc32").collect()) == sorted(back.select("lsn", "crc32").collect())
    wal.save_manifest(str(tmp_path / "m.json"), [{"id": 1}], 2)
    assert wal.load_manifest(str(tmp_path / "m.json"))["active_segment_id"] == 2
    assert wal.load_manifest(str(tmp_path / "none")) == {"segments": [], "active_segment_id": 1}


def test_text_of_pages(spark):
    rows = [(bytearray(b"hi\0there" + bytes(4)),), (bytearray(8),), (bytearray(b"a\xffb\0"),)]
    shown = spark.createDataFrame(rows, "d binary").select(C.page_text(F.col("d")).alias("t"), C.data_preview(F.col("d"), 3).alias("p")).collect()
    assert [r.t for r in shown] == ["hi", "(empty page)", "a�b"]
    assert [r.p for r in shown] == ["hi\0...", "\0\0\0...", "0x61FF62..."]


def batch(spark, *writes, number=1):
    """One batch of (page, offset, bytes)."""
    rows = [(number, i, "A", p, o, bytearray(d)) for i, (p, o, d) in enumerate(writes)]
    return spark.createDataFrame(rows, "batch_id long, pos int, node string, page_id long, offset int, data binary")


def test_log_folder(spark, tmp_path):
    """Three readers of a ledger at three read points; appends, an overflow, cooling, and a log opened again."""
    log = PageLog.open(spark, str(tmp_path), preset="tiered", segment_bytes=70)
    assert log.append_frame(batch(spark, (12, 30, b"opening"))) == 1
    assert log.append_frame(batch(spark, (12, 30, b"OPEN"), (40, 0, b"debit"), (12, 37, b"!"))) == 4
    early, late = log.get_page(12, 1), log.get_page(12, 4)
    assert early[30:38] == b"opening\0" and late[30:38] == b"OPENing!" and late[:30] == bytes(30)
    with pytest.raises(PageNotFound):
        log.get_page(40, 1)
    with pytest.raises(LsnBeyondDurable):
        log.snapshot(5)
    with pytest.raises(PageOverflow):
        log.append_frame(batch(spark, (7, 0, b"fits"), (7, 8190, b"does not")))
    assert log.durability() == (4, 4) and log.log_bytes() == 4 * 41 + 17
    assert log.cool(1) == 3 and [r.tier for r in log.segments().orderBy("id").collect()] == ["Cold", "Cold", "Hot", "Hot"]
    again = PageLog.open(spark, str(tmp_path), preset="tiered", segment_bytes=70)
    assert again.durability() == (4, 4) and again.state["next_lsn"] == 5 and again.state["first_hot"] == 3
    assert again.append_frame(batch(spark, (40, 2, b"BIT"), number=9)) == 5
    assert again.get_page(40, 5)[:6] == b"deBIT\0" and again.frame().where("lsn = 5").first()["prev_lsn"] == 3


def test_reads_behind(spark):
    steps = [("A", 1, "put", 1), ("B", 2, "get", 1), ("A", 3, "get", 1), ("B", 4, "refresh", 1), ("A", 5, "put", 2), ("B", 6, "get", 2), ("A", 7, "get", 2)]
    found = staleness(spark.createDataFrame(steps, "node string, step long, op string, vdl long"))
    assert {r.step: (r.read_point, r.behind) for r in found.collect()} == {2: (0, 1), 3: (1, 0), 6: (1, 1), 7: (2, 0)}
    reads = spark.createDataFrame([(1, 3, 5), (2, 3, 5), (3, 3, 6), (4, 9, 5), (5, 3, 6)], "step long, page_id long, read_point long")
    assert {r.step: r.hit for r in repeated_reads(reads).collect()} == {1: False, 2: True, 3: False, 4: False, 5: True}


def test_trace_round_trip(spark, tmp_path):
    rows = [(0, 5, "WalAppend", {"bytes": "2048"}), (1, 6, "WalSync", None), (2, 7, "AdvanceVdl", {"new": "9"}), (3, 8, "BufferPoolLookup", {"hit": "false", "node": "A"}), (4, 9, "PageCacheLookup", {"hit": "true"}), (5, 9, "PageCacheLookup", {"hit": "false"}), (6, 9, "PageCacheLookup", {"hit": "false"}), (7, 10, "BufferPoolInsert", {"node": "A", "page_id": "3"})]
    write_trace(spark.createDataFrame(rows, "seq long, timestamp_us long, kind string, fields map<string,string>"), str(tmp_path / "t"))
    back = read_trace(spark, str(tmp_path / "t"))
    m = metrics(back).first()
    assert (m.writes, m.kb_written, m.reads, m.vdl, m.cache_hit_percent) == (1, 2, 1, 9, 33)
    assert metrics(back, 100).first()["cache_hit_percent"] == 0
    assert tuple(node_state(back).first()) == ("A", 0, 1, 1)
    more = spark.createDataFrame([(i, 0, "UpdatePageIndex", {"page_id": str(p), "lsn": str(10 + i)}) for i, p in enumerate([4, 2, 4])], "seq long, timestamp_us long, kind string, fields map<string,string>")
    assert tuple(shared_state(back.union(more)).first()) == (0, 9, 2048, 2)
    assert [tuple(r) for r in indexed_pages(more).collect()] == [(2, 11), (4, 12)]


def test_vcl_over_batches(spark):
    state = Vcl()
    for i, (lsns, want) in enumerate([([1, 2], 2), ([4, 6], 2), ([3], 4), ([5, 7], 7), ([], 7)]):
        state(spark.createDataFrame([(x,) for x in lsns], "lsn long"), i)
        assert state.vcl == want


def test_bulk_appends_and_bases(spark, tmp_path):
    log = PageLog.open(spark, str(tmp_path))
    log.append_frame(batch(spark, (1, 0, b"zero")))
    writes = [(b, p, "A", (b + p) % 3, p, bytearray([b])) for b in range(5, 9) for p in range(3)]
    frame = spark.createDataFrame(writes, "batch_id long, pos int, node string, page_id long, offset int, data binary")
    assert log.append_frame(frame) == 13 and log.durability() == (13, 13)
    full = {r.page_id: (bytes(r.page), r.chain_len, r.last_lsn) for r in log.snapshot(13).collect()}
    want = {1: bytearray(b"zero".ljust(8192, b"\0"))}
    for _, _, _, page, offset, data in writes:
        want.setdefault(page, bytearray(8192))[offset : offset + 1] = data
    assert {p: v[0] for p, v in full.items()} == {p: bytes(v) for p, v in want.items()}
    rows = log.frame().orderBy("lsn").collect()
    last = {}
    for r in rows:
        assert r.prev_lsn == last.get(r.page_id, 0)
        last[r.page_id] = r.lsn
    assert log.make_base() == 13
    log.append_frame(batch(spark, (2, 100, b"after")))
    assert log.get_page(2, 14)[100:105] == b"after" and log.get_page(2, 14)[:100] == full[2][0][:100]
    assert {r.page_id: bytes(r.page) for r in PageLog.open(spark, str(tmp_path)).snapshot(13).collect()} == {p: v[0] for p, v in full.items()}
    assert log.append_frame(frame.limit(0)) == 14
    with pytest.raises(PageOverflow):
        log.append_frame(frame.withColumn("offset", F.lit(8192)))
