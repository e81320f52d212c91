"""The store: life cycle, recovery, merges, damage to its logs, and streams into it."""

import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidelog.model import LOG, Options, Status, StoreError
from tidelog.operators import lww
from tidelog.sources import wal
from tidelog.sources.store import Recent, Store
from tidelog.streaming import upsert


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "db")


def test_put_get_delete(spark, path):
    db = Store.create(spark, path)
    for i in range(200):
        db.put(f"key{i}", f"value{i}")
    assert db.get("key7") == (Status.OK, "value7")
    for i in range(200):
        db.delete(f"key{i}")
    assert db.get("key7") == (Status.NOT_FOUND, None)
    assert db.live().count() == 0


def test_reopen(spark, path):
    db = Store.create(spark, path)
    for i in range(300):
        db.put(f"key{i}", f"value{i}")
    db.close()
    with pytest.raises(StoreError):
        db.put("a", "b")
    db = Store.open(spark, path)
    assert {(r.k, r.v) for r in db.live().collect()} == {(f"key{i}", f"value{i}") for i in range(300)}
    assert db.next_seq == 300
    db.put("key0", "new")
    db.close()
    assert Store.open(spark, path).get("key0") == (Status.OK, "new")


def test_open_conditions(spark, path, tmp_path):
    with pytest.raises(StoreError):
        Store.open(spark, path, Options(create_if_missing=False))
    Store.open(spark, path)
    with pytest.raises(StoreError):
        Store.create(spark, path)
    (tmp_path / "file").write_text("x")
    with pytest.raises(StoreError):
        Store.open(spark, str(tmp_path / "file"))
    Store.destroy(spark, path)
    with pytest.raises(StoreError):
        Store.open(spark, path, Options(create_if_missing=False))


def test_delete_masks_older_runs(spark, path):
    db = Store.create(spark, path)
    db.put("a", "1")
    db.put("b", "1")
    db.flush()
    db.delete("a")
    db.flush()
    assert db.get("a") == (Status.NOT_FOUND, None)
    assert db.get_at("a", 1) == (Status.OK, "1")
    for i in range(4):
        db.put(f"c{i}", "1")
        db.flush()
    assert [r.level for r in db.runs].count(1) == 1
    assert db.get("a") == (Status.NOT_FOUND, None)
    db.put("a", "2")
    assert db.get("a") == (Status.OK, "2")


def test_merges_keep_the_newest(spark, path):
    db = Store.create(spark, path, Options(memtable_bytes=300))
    want = {}
    rng = random.Random(1)
    for i in range(200):
        k = f"key{rng.randrange(20)}"
        if rng.random() < 0.3:
            db.delete(k)
            want.pop(k, None)
        else:
            db.put(k, f"value{i}")
            want[k] = f"value{i}"
    assert {r.k: r.v for r in db.live().collect()} == want
    assert max(sum(r.level == n for r in db.runs) for n in range(5)) <= 4
    assert any(r.level > 0 for r in db.runs)
    db.vacuum()
    db.close()
    assert {r.k: r.v for r in Store.open(spark, path).live().collect()} == want


def test_runs_are_sorted_and_named_by_content(spark, path):
    db = Store.create(spark, path)
    ops = spark.createDataFrame([(f"key{i % 50}", i, i % 3 == 0, f"v{i}") for i in range(500)], "k string, seq long, d boolean, v string")
    db.load(lww.log_of(ops, "k", "seq", F.col("d"), "v"))
    run = db.runs[0]
    assert (run.num_keys, run.min_key, run.max_key) == (500, "key0", "key9")
    found = [(r.k, -r.seq) for r in db.run(run.sst).collect()]
    assert found == sorted(found)
    assert db.manifest().first().sst == run.sst
    assert {r.k for r in db.range("key10", "key19").collect()} <= {f"key{i}" for i in range(10, 20)}
    assert [r.status for r in db.multi_get(spark.createDataFrame([("nope",)], "k string")).collect()] == ["not found"]
    db.load(lww.log_of(ops, "k", "seq", F.col("d"), "v"), "t", 3)
    n = len(db.runs)
    db = Store.open(spark, path)
    for batch in (2, 3):
        db.load(lww.log_of(ops, "k", "seq", F.col("d"), "v"), "t", batch)
    assert len(db.runs) == n
    db.load(lww.log_of(ops, "k", "seq", F.col("d"), "v"), "other", 3)
    assert len(db.runs) == n + 1 and db.streams == {"t": 3, "other": 3}


def test_seek_and_scan(spark, path):
    db = Store.create(spark, path)
    for i, k in enumerate(["b", "d", "b", "f"]):
        db.put(k, f"v{i}")
        if i == 1:
            db.flush()
    db.delete("d")
    assert [(r.k, r.seq) for r in db.scan().collect()] == [("b", 2), ("b", 0), ("d", 4), ("d", 1), ("f", 3)]
    assert [(r.k, r.seq, r.op) for r in db.seek("c").collect()] == [("d", 4, 1)]
    assert db.seek("g").count() == 0


def test_runs_have_bloom_filters_and_statistics(spark, path):
    import glob

    import pyarrow.parquet as pq

    db = Store.create(spark, path)
    db.load(spark.range(20000).selectExpr("concat('key', id) as k", "id as seq", "0 as op", "'v' as v"))
    column = pq.ParquetFile(glob.glob(f"{path}/sst/*/*.parquet")[0]).metadata.row_group(0).column(0)
    assert column.statistics.has_min_max and "PLAIN_DICTIONARY" not in column.encodings and "RLE_DICTIONARY" not in column.encodings
    assert db.get("key19999")[0] == Status.OK and db.get("key20000")[0] == Status.NOT_FOUND


def test_crash_keeps_what_was_synced(spark, path):
    db = Store.create(spark, path, Options(sync=True))
    db.put("a", "1")
    db.put("b", "2")
    # No close: the memtable is gone, the log isn't.
    again = Store.open(spark, path)
    assert (again.get("a"), again.get("b"), again.next_seq) == ((Status.OK, "1"), (Status.OK, "2"), 2)
    assert {(r.k, r.v) for r in Store.open(spark, path).live().collect()} == {("a", "1"), ("b", "2")}


def frames(n):
    return [wal.framed(wal.encode(f"key{i}", i, 0, f"value{i}")) for i in range(n)]


def test_log_round_trip(spark, tmp_path):
    (tmp_path / "3-0.wal").write_bytes(b"".join(frames(3)))
    found = wal.read(spark, str(tmp_path)).orderBy("pos").collect()
    assert [r.status for r in found] == ["ok", "ok", "ok", "file eof"]
    assert wal.replay(spark, str(tmp_path)) == [(f"key{i}", i, 0, f"value{i}") for i in range(3)]


@pytest.mark.parametrize(
    "damage, status, valid",
    [
        (lambda d, at: d[: at + 14] + bytes([d[at + 14] ^ 1]) + d[at + 15 :], Status.CHECKSUM, 50),
        (lambda d, at: d[: at + 4] + bytes([1]) + d[at + 5 :], Status.BAD_RECORD, 50),
        (lambda d, at: d[: at + 8] + bytes([d[at + 8] + 2]) + d[at + 9 :], Status.CHECKSUM, 50),
        (lambda d, at: d[:-10], Status.EOF, 99),
    ],
)
def test_log_damage(damage, status, valid):
    every = frames(100)
    found = list(wal.records(damage(b"".join(every), sum(map(len, every[:50])))))
    assert (len(found) - 1, found[-1][5]) == (valid, status)


def test_damaged_log_stops_opening(spark, path):
    db = Store.create(spark, path, Options(sync=True))
    db.put("a", "1")
    name = f"{path}/wal/0-0.wal"
    with open(name, "rb") as f:
        data = bytearray(f.read())
    data[-1] ^= 1
    db.files.write(name, bytes(data))
    with pytest.raises(StoreError):
        Store.open(spark, path)


def test_streams(spark, path, tmp_path):
    source = tmp_path / "in"
    want = {}
    for part in range(3):
        rows = []
        for i in range(part * 40, part * 40 + 40):
            k, op = f"key{i * 7 % 11}", int(i % 5 == 0)
            rows.append((k, i, op, "" if op else f"v{i}"))
            want.pop(k, None) if op else want.update({k: f"v{i}"})
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = upsert.live_stream(stream).writeStream.outputMode("complete").format("memory").queryName("live_now").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.k: r.v for r in upsert.live_of(spark.table("live_now")).collect()} == want
    db = Store.create(spark, path)
    upsert.flush_stream(stream, db, str(tmp_path / "check")).awaitTermination()
    assert {r.k: r.v for r in db.live().collect()} == want
    assert len(db.runs) == 3


def test_streams_do_not_take_each_other_for_done(spark, path, tmp_path):
    db = Store.create(spark, path)
    for name, check in (("a", "1"), ("b", "2"), ("b", "3")):
        source = str(tmp_path / name)
        spark.range(5).selectExpr(f"concat('{name}', id) as k", "id as seq", "0 as op", "'v' as v").write.mode("overwrite").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        for _ in range(2):  # the second time has nothing new
            upsert.flush_stream(stream, db, str(tmp_path / f"check{check}")).awaitTermination()
    assert {r.k for r in db.live().collect()} == {f"{n}{i}" for n in "ab" for i in range(5)}
    # A batch that comes again: the store has it, the checkpoint hasn't.
    (tmp_path / "check1" / "commits" / "0").unlink()
    (tmp_path / "check1" / "commits" / ".0.crc").unlink(missing_ok=True)
    n, stream = len(db.runs), spark.readStream.schema(LOG).parquet(str(tmp_path / "a"))
    upsert.flush_stream(stream, db, str(tmp_path / "check1")).awaitTermination()
    assert len(db.runs) == n
    assert Store.open(spark, path).streams == db.streams and len(db.streams) == 3


def test_pointer_is_replaced_in_one_step(spark, path, monkeypatch):
    from tidelog.sources.store import Files

    db = Store.create(spark, path)
    db.put("a", "1")
    db.flush()
    before = db.files.read(f"{path}/CURRENT")
    db.put("a", "2")
    with monkeypatch.context() as refusing:

        def refuse(self, old, new):
            if new.endswith("CURRENT"):
                raise StoreError("no")

        refusing.setattr(Files, "replace", refuse)
        with pytest.raises(StoreError):
            db.flush()
    assert db.files.read(f"{path}/CURRENT") == before
    assert Store.open(spark, path).get("a") == (Status.OK, "1")
    # Where the pointer is lost, nothing is made over what is there.
    db.files.delete(f"{path}/CURRENT")
    with pytest.raises(StoreError):
        Store.open(spark, path)
    assert db.files.names(f"{path}/sst")


def test_pointer_on_other_file_systems(spark, tmp_path):
    """By Hadoop's own rename with overwriting, as on file systems that aren't local."""
    from tidelog.sources.store import Files

    files = Files(spark, str(tmp_path))
    files.local = False
    for data in (b"one", b"two"):
        files.write(f"{tmp_path}/x", data)
        assert files.read(f"{tmp_path}/x") == data
    with pytest.raises(StoreError):
        files.replace(f"{tmp_path}/none", f"{tmp_path}/x")
    assert files.read(f"{tmp_path}/x") == b"two"


def test_bytes(spark, path):
    options = Options(binary=True, sync=True)
    db = Store.create(spark, path, options)
    keys = [b"", b"\x00", b"\x00\xff", b"\x80a", b"a\x00b", b"\xff" * 3, "é".encode()]
    for i, k in enumerate(keys):
        db.put(k, bytes([i, 0, 255]))
        if i == 3:
            db.flush()
    db.delete(b"\x00")
    with pytest.raises(StoreError):
        db.put("text", "text")
    for again in (db, Store.open(spark, path, options)):
        assert [again.get(k) for k in (b"\x80a", b"\xff" * 3, b"\x00", b"none")] == [(Status.OK, b"\x03\x00\xff"), (Status.OK, b"\x05\x00\xff"), (Status.NOT_FOUND, None), (Status.NOT_FOUND, None)]
        assert [bytes(r.k) for r in again.scan().collect()] == sorted([*keys, b"\x00"])
        assert bytes(again.seek(b"\x60").first().k) == b"a\x00b"
        assert {bytes(r.k) for r in again.range(b"\x00\x00", b"b").collect()} == {k for k in keys if b"\x00\x00" <= k <= b"b"}
        assert again.get_at(b"\x00", 1) == (Status.OK, b"\x01\x00\xff")
    with pytest.raises(StoreError):
        Store.open(spark, path)
    with pytest.raises(StoreError):
        Store.create(spark, path + "2").put(b"a", b"b")


def test_answers_are_kept(spark, path):
    db = Store.create(spark, path, Options(level_files=3, cached_answers=8))
    for n in range(3):
        db.load(spark.range(100).selectExpr("concat('key', id) as k", "id as seq", f"cast(id % 7 = {n} as int) as op", f"case when id % 7 = {n} then '' else 'v{n}' end as v"))
    def newest(i):
        return (Status.NOT_FOUND, None) if i % 7 == 2 else (Status.OK, "v2")

    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    assert [db.get(f"key{i}") for i in (1, 2, 9, 30)] == [newest(i) for i in (1, 2, 9, 30)]
    before = jobs()
    assert db.get("key30") == newest(30) and jobs() == before
    assert len(db.answers.held) <= 8
    db.put("key30", "new")
    assert db.get("key30") == (Status.OK, "new")
    db.flush()  # four runs: they are merged
    assert db.get("key30") == (Status.OK, "new") and db.get("key1") == newest(1)
    assert len(db.readers.held) <= db.options.open_runs


def test_caches_are_shared_by_threads():
    recent = Recent(3)

    def use(seed):
        rng = random.Random(seed)
        for _ in range(20_000):
            k = rng.randrange(6)
            assert recent.get(k) in (None, -k)
            recent.put(k, -k)

    with ThreadPoolExecutor(4) as threads:
        list(threads.map(use, range(4)))
    assert len(recent.held) == 3


def test_merges_in_the_background(spark, path):
    db = Store.create(spark, path, Options(memtable_bytes=200, level_files=2, background=True))
    for i in range(120):
        db.put(f"key{i % 13}", f"v{i}")
    db.close()
    assert max(sum(r.level == n for r in db.runs) for n in range(4)) <= 2
    assert {r.k: r.v for r in Store.open(spark, path).live().collect()} == {f"key{i % 13}": f"v{i}" for i in range(120)}


def test_files_are_cut_by_bytes(spark, path):
    import glob

    db = Store.create(spark, path, Options(file_bytes=20_000))
    db.load(spark.range(3000).selectExpr("case when id % 2 = 0 then 'hot' else concat('key', id) end as k", "id as seq", "0 as op", "repeat('x', 20) as v"))
    files = [spark.read.parquet(f).collect() for f in glob.glob(f"{path}/sst/*/*.parquet")]
    assert len(files) >= 4 and max(map(len, files)) < 1500
    ranges = sorted(((f[0].k, -f[0].seq), (f[-1].k, -f[-1].seq)) for f in files)
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert db.get("hot") == (Status.OK, "x" * 20)
