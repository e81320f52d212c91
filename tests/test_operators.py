"""Reads, runs and the cache model on small logs, against plain Python."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions.hashing import content_id, crc32c
from tidelog.functions.keys import packed, shared_prefix, shown, unpacked
from tidelog.model import LOG
from tidelog.operators import cache, cutter, lww, runs
from tidelog.operators.running import running_sum


def log_of(spark, ops):
    """ops: (key, op, value), numbered as they come."""
    return spark.createDataFrame([(k, i, op, v) for i, (k, op, v) in enumerate(ops)], LOG)


def alternating(n):
    return [(f"key{i // 2}", i % 2, "" if i % 2 else f"value{i}") for i in range(n)]


def test_version_order(spark):
    log = log_of(spark, [("key0", 0, "x"), ("key1", 0, "value1"), ("key2", 0, "value2"), ("key2", 0, "value3"), ("key3", 0, "value4"), ("key3", 1, "")])
    assert lww.get(log, "key1").first().v == "value1"
    assert lww.get(log, "key2").first().v == "value3"
    assert lww.get(log, "key3").first() is None
    assert lww.get(lww.at_seq(log, 4), "key3").first().v == "value4"


def test_put_again_after_delete(spark):
    log = log_of(spark, [("k", 0, "a"), ("k", 0, "b"), ("k", 1, ""), ("k", 0, "c")])
    assert lww.live(log).first().v == "c"
    assert [r.seq for r in lww.versions(log).orderBy("pos").collect()] == [3, 2, 1, 0]


def test_empty_value_is_a_value(spark):
    assert lww.live(log_of(spark, [("k", 0, "")])).first().v == ""


def test_alternating_run_has_no_live_key(spark):
    assert lww.live(log_of(spark, alternating(2000))).count() == 0
    again = alternating(2000) + [(f"key{i // 2}", 0, f"value{i}") for i in range(2000)]
    assert {(r.k, r.v) for r in lww.live(log_of(spark, again)).collect()} == {(f"key{i}", f"value{2 * i + 1}") for i in range(1000)}


def test_deep_history_of_one_key(spark):
    ops = [("key", i % 2, "" if i % 2 else f"value{i // 2}") for i in range(10001)]
    log = log_of(spark, ops)
    assert lww.live(log).first().v == "value5000"
    assert [r.seq for r in lww.versions(log).orderBy("pos").limit(3).collect()] == [10000, 9999, 9998]


def test_positions_across_ranges(spark):
    ops = [("hot" if i % 3 else f"k{i % 5}", 0, "v") for i in range(600)] + [("zz", 0, "v")]
    want = {}
    for i, (k, _, _) in enumerate(ops):
        want.setdefault(k, []).append(i)
    found = {(r.k, r.seq): r.pos for r in lww.versions(log_of(spark, ops)).collect()}
    assert found == {(k, seq): pos for k, seqs in want.items() for pos, seq in enumerate(sorted(seqs, reverse=True), 1)}


def test_delete_at_an_equal_number_wins(spark):
    log = spark.createDataFrame([("k", 1, 0, "a"), ("k", 1, 1, "")], LOG)
    assert lww.live(log).count() == 0


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    for found in (lww.heads(log), lww.live(log), lww.seek(log, "a"), runs.stored(log, 5), runs.tier_get(log, 5), runs.candidate_files(log, 5), lww.multi_get(log, log)):
        assert found.count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(ops=st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from([0, 0, 1])), min_size=1, max_size=60), per_run=st.integers(1, 9), seed=st.integers(0, 99))
def test_live_keys_do_not_depend_on_the_layout(spark, ops, per_run, seed):
    entries = [(k, i, op, "" if op else f"v{i}") for i, (k, op) in enumerate(ops)]
    want = {}
    for k, _, op, v in entries:
        want.pop(k, None) if op else want.update({k: v})
    random.Random(seed).shuffle(entries)
    log = spark.createDataFrame(entries, LOG)
    assert {r.k: r.v for r in lww.live(log).collect()} == want
    assert {r.k: r.v for r in runs.tier_get(log, per_run).collect()} == want
    assert {r.k: r.v for r in lww.live(runs.stored(log, per_run).select("k", "seq", "op", "v")).collect()} == want
    assert set(want) <= {r.k for r in runs.tier_get_fallthrough(log, per_run).collect()}


def levels_by_hand(flushes):
    """Files by level, a step at a time."""
    levels = [0] * 5
    for _ in range(flushes):
        levels[0] += 1
        for n in range(4):
            if levels[n] > 4:
                levels[n], levels[n + 1] = 0, levels[n + 1] + 1
    return levels


@pytest.mark.parametrize("flushes", [0, 4, 5, 24, 25, 26, 133, 700])
def test_layout_follows_from_the_number_of_runs(spark, flushes):
    log = spark.range(flushes * 2 + 1).select(F.concat(F.lit("k"), F.col("id")).alias("k"), F.col("id").alias("seq"), F.lit(0).alias("op"), F.lit("v").alias("v"))
    found = {r.lvl: r.files for r in runs.layout(log, 2).collect()}
    assert [found.get(n, 0) for n in range(5)] == levels_by_hand(flushes)


def test_merge_keeps_deletes_unless_told(spark):
    a, b = log_of(spark, [("a", 0, "1"), ("b", 0, "2")]), spark.createDataFrame([("a", 9, 1, "")], LOG)
    assert {(r.k, r.op) for r in runs.merge(a, b).collect()} == {("a", 1), ("b", 0)}
    assert {r.k for r in runs.merge(a, b, drop_deleted=True).collect()} == {"b"}


def lru_by_hand(keys, capacity):
    cached, out = OrderedDict(), []
    for k in keys:
        out.append(int(k in cached))
        cached[k] = 1
        cached.move_to_end(k)
        if len(cached) > capacity:
            cached.popitem(last=False)
    return out


@pytest.mark.parametrize("chunk", [7, 50, 10000])
@pytest.mark.parametrize("keys", [3, 12, 80])
def test_cache_in_chunks(spark, chunk, keys):
    trace = [random.Random(chunk * keys).choice(range(keys)) for _ in range(1)] + [random.Random(i).randrange(keys) for i in range(399)]
    found = cache.lru_hits(spark.createDataFrame(list(enumerate(trace)), "i long, k long"), 10, chunk).orderBy("i").collect()
    assert [r.hit for r in found] == lru_by_hand(trace, 10)


def test_cache_of_64(spark):
    trace = [f"key{i}" for i in range(65)] + [f"key{i}" for i in [*range(1, 65), 0]]
    hits = [r.hit for r in cache.lru_hits(spark.createDataFrame(list(enumerate(trace)), "i long, k string")).orderBy("i").collect()]
    assert hits == [0] * 65 + [1] * 64 + [0]


@pytest.mark.parametrize("chunk_bytes, fanout, long", [(100, 32, 0), (300, 3, 0), (90, 3, 1000), (1 << 28, 32, 0)])
def test_runs_by_bytes(spark, monkeypatch, chunk_bytes, fanout, long):
    monkeypatch.setattr(cutter, "FANOUT", fanout)
    # Some values may be longer than a run and than chunks.
    ops = [(f"key{i % 7}", 0, "x" * (i * 37 % 50 + (long if i % 23 == 0 else 0))) for i in range(200)]
    want, size, run = [], 0, 0
    for k, _, v in ops:
        if size > 150:
            size, run = 0, run + 1
        size += len(k) + 9 + len(v)
        want.append(run)
    assert [r.run for r in cutter.byte_runs(log_of(spark, ops), 150, chunk_bytes).orderBy("seq").collect()] == want
    assert cutter.byte_runs(log_of(spark, []), 150).count() == 0


def test_runs_by_bytes_are_spread(spark):
    log = spark.range(8000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("seq"), F.lit(0).alias("op"), F.lit("value").alias("v"))
    tasks = cutter.byte_runs(log, 150).withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 8000
    # Of 8 tasks none has more than about its share.
    assert max(r["count"] for r in tasks) <= 2000


@pytest.mark.parametrize("parts, batch, fanout", [(1, 3, 2), (8, 1, 2), (8, 3, 3), (5, 10000, 2)])
def test_runs_by_bytes_go_on_over_batches_and_ranges(spark, monkeypatch, parts, batch, fanout):
    monkeypatch.setattr(cutter, "FANOUT", fanout)
    # One value has no size and so no run.
    ops = [(f"key{i % 7}", 0, None if i == 60 else "x" * (i * 37 % 50 + (700 if i % 41 == 0 else 0))) for i in range(300)]
    begin = np.cumsum([0] + [len(k) + 9 + len(v) for k, _, v in ops if v is not None])[:-1]
    log = spark.createDataFrame([(k, i, op, v) for i, (k, op, v) in enumerate(ops)], "k string, seq long, op int, v string")
    names = {"spark.sql.shuffle.partitions": parts, "spark.sql.execution.arrow.maxRecordsPerBatch": batch}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, value)
        found = cutter.byte_runs(log.repartition(3), 150, 1).orderBy("seq").collect()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert [r.seq for r in found] == [i for i in range(300) if i != 60]
    assert [r.run for r in found] == list(cutter.run_numbers(begin, 150, -1, 0))


@pytest.mark.parametrize("seed", range(20))
def test_steps_compose(seed):
    rng = np.random.default_rng(seed)
    begin = np.cumsum(np.concatenate([[0], rng.choice([9, 20, 300], 400, p=[0.5, 0.45, 0.05])]))
    limit = int(rng.choice([8, 50, 400, 20_000]))
    numbers = cutter.run_numbers(begin, limit, -1, 0)
    stretches = np.split(begin, np.sort(rng.choice(np.arange(1, 400), 6, replace=False)))
    steps = [cutter.Steps.of(s, limit) for s in stretches]
    whole = steps[0]
    for upto, one in enumerate(steps[1:], 2):
        whole = whole.then(one, limit)
        _, begun = whole.after(np.array([-1]), np.array([0]))
        assert begun[0] - 1 == numbers[sum(map(len, stretches[:upto])) - 1]
    # Any two ways of composing stretches do the same to any run that may be open.
    left, right = steps[1].then(steps[2], limit).then(steps[3], limit), steps[1].then(steps[2].then(steps[3], limit), limit)
    ends = np.arange(0, stretches[1][0] + limit)
    for a, b in zip(left.after(ends, 0 * ends), right.after(ends, 0 * ends), strict=True):
        assert (a == b).all()


def test_running_sum(spark):
    rows = [(i * 7919 % 1000, i) for i in range(1000)]
    found = running_sum(spark.createDataFrame(rows, "k long, v long"), ["k"], "v", "s").orderBy("k").collect()
    total = 0
    for r, (_, v) in zip(found, sorted(rows), strict=True):
        total += v
        assert r.s == total


def test_functions(spark):
    assert crc32c(b"123456789") == 0xE3069283
    keys = spark.sql("select * from values ('ab', 258L, 1), ('', 0L, 0) as t(k, seq, op)")
    assert [r[0] for r in keys.select(shown(F.col("k"), F.col("seq"), F.col("op"))).collect()] == ["ab @258 delete", " @0 put"]
    row = spark.sql("select 'ab' as k, 258L as seq, 1 as op").select(packed(F.col("k"), F.col("seq"), F.col("op")).alias("p")).first()
    assert bytes(row.p) == b"ab" + (258).to_bytes(8, "little") + b"\x01"
    back = spark.sql("select * from values ('ab', 258L, 1), ('', -2L, 0), ('é', 9223372036854775807L, 1) t(k, seq, op)").select("*", unpacked(packed(F.col("k"), F.col("seq"), F.col("op"))).alias("u")).collect()
    assert all((r.u.k.decode(), r.u.seq, r.u.op) == (r.k, r.seq, r.op) for r in back)
    assert spark.sql("select 'éa' as a, 'éb' as b, 'è' as c").select(shared_prefix(F.col("a"), F.col("b")), shared_prefix(F.col("a"), F.col("c"))).first()[:] == (2, 1)
    pairs = spark.createDataFrame([("key10", "key12"), ("key", "key1"), ("", "a"), ("a", None), ("x", "y")], "a string, b string")
    assert [r[0] for r in pairs.select(shared_prefix(F.col("a"), F.col("b"))).collect()] == [4, 3, 0, 0, 0]
    a = spark.range(100).select(F.col("id").cast("string").alias("k"))
    assert content_id(a, "k") == content_id(a.repartition(7), "k") != content_id(a.limit(99), "k")


def test_point_reads_reach_the_scan(spark, tmp_path):
    log_of(spark, alternating(100)).write.parquet(str(tmp_path / "log"))
    plan = lww.get(spark.read.parquet(str(tmp_path / "log")), "key7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,key7)" in plan
