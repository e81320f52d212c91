"""The queries over the fixture tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.hashing import chained_id, content_id
from tidelog.functions.keys import shared_prefix
from tidelog.model import Options
from tidelog.operators import cache, cutter, lww, runs
from tidelog.sources import wal
from tidelog.sources.staging import shared_dir
from tidelog.sources.store import Store
from tidelog.streaming import upsert

#: Entries of a run.
RUN = 75
#: Bytes that a memtable holds before it is frozen, where runs are cut by bytes.
MEMTABLE_BYTES = 16 << 10
#: The snapshot, the key, the seek key and the range that queries ask for.
SNAPSHOT, KEY, SEEK, LOW, HIGH = 5000, 7, 50, 20, 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of users: an error deletes the user's value."""
    return lww.log_of(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "error", "props")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of customers: an order that is finished deletes the customer's value."""
    return lww.log_of(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", "o_orderpriority")


def text_keys(log: DataFrame) -> DataFrame:
    """The log with keys as strings, as a store holds them."""
    return log.withColumn("k", F.col("k").cast("string"))


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store returns that was loaded in two parts, closed and opened again."""
    path = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    log = text_keys(events(spark, sf_dir))
    middle = log.agg(F.floor(F.max("seq") / 2)).first()[0] or 0
    store = Store.create(spark, path, Options())
    store.load(log.where(F.col("seq") <= middle))
    store.load(log.where(F.col("seq") > middle))
    store.close()
    return Store.open(spark, path).live().select("k", "v")


def byte_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cutter.byte_runs(text_keys(events(spark, sf_dir)), MEMTABLE_BYTES)
    return cut.groupBy("run").agg(F.count("*").alias("entries"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def prefix_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the keys of a run: bytes that they share with the key before, where blocks restart every 12, and all their bytes."""
    order = W.partitionBy("run").orderBy("k", F.desc("seq"), F.desc("op"))
    rows = runs.with_run(text_keys(events(spark, sf_dir)), RUN).withColumn("i", F.row_number().over(order).cast("long") - 1).withColumn("before", F.lag("k").over(order))
    shared = F.when(F.col("i") % 12 == 0, 0).otherwise(shared_prefix(F.col("k"), F.col("before"))).cast("long")
    return rows.withColumn("shared", shared).groupBy("run").agg(F.sum("shared").alias("shared_bytes"), F.sum(F.octet_length("k")).alias("key_bytes"))


def oid_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all entries by level, and the revision that they make."""
    kept = runs.stored(text_keys(events(spark, sf_dir)), RUN).where("lvl >= 0")
    ids = [(n, content_id(kept.where(F.col("lvl") == n), "sid", "k", "seq", "op", "v")) for n in range(5)]
    return spark.createDataFrame([(n, oid, chained_id([f"{n} {oid}" for n, oid in ids])) for n, oid in ids], "level int, oid string, revision string")


def stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live keys by way of a stream of the same log."""
    source = table(spark, sf_dir, "events")
    streamed = spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    log = lww.log_of(streamed, "user_id", "event_id", F.col("event_type") == "error", "props")
    # The state goes to a table, batch by batch, not to the driver.
    where = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    query = upsert.live_stream(log).writeStream.outputMode("complete").foreachBatch(lambda state, _: state.write.mode("overwrite").parquet(f"{where}/state"))
    query.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return upsert.live_of(spark.read.parquet(f"{where}/state"))


def on_events(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(events(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "kv_log": events,
    "kv_heads": on_events(lww.heads),
    "kv_live": on_events(lww.live),
    "kv_tombstoned": on_events(lww.tombstoned),
    "kv_get": on_events(lambda log: lww.get(log, KEY)),
    "kv_multi_get": lambda spark, sf_dir: lww.multi_get(events(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))),
    "kv_get_at_seq": on_events(lambda log: lww.live(lww.at_seq(log, SNAPSHOT))),
    "kv_versions": on_events(lww.versions),
    "mem_get": on_events(lambda log: lww.live(runs.memtable(log, RUN)).select("k", "v")),
    "mem_size": on_events(lambda log: runs.memtable_bytes(log, RUN)),
    "flush_meta": on_events(lambda log: runs.flush_meta(log, RUN)),
    "merge_runs": on_events(lambda log: runs.merged(log, RUN)),
    "merge_meta": on_events(lambda log: runs.file_meta(runs.merged(log, RUN), "lvl", "sid")),
    "level_layout": on_events(lambda log: runs.layout(log, RUN)),
    "tier_get": on_events(lambda log: runs.tier_get(log, RUN)),
    "tier_get_fallthrough": on_events(lambda log: runs.tier_get_fallthrough(log, RUN)),
    "zone_prune": on_events(lambda log: runs.candidate_files(log, RUN)),
    "filter_probe": lambda spark, sf_dir: runs.probe_files(events(spark, sf_dir), RUN, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))),
    "seek_ge": on_events(lambda log: lww.seek(log, SEEK)),
    "iter_scan": on_events(lambda log: runs.scan(log, RUN)),
    "key_range": on_events(lambda log: lww.key_range(log, LOW, HIGH)),
    "top_k_keys": on_events(lambda log: lww.first_keys(log, 10)),
    "block_index": on_events(lambda log: runs.blocks(log, RUN)),
    "seq_recover": on_events(lambda log: runs.recovered(log, RUN)),
    "wal_replay": on_events(lambda log: wal.valid_prefix(log, (F.col("seq") >= 9000) & F.col("v").contains("42"))),
    "lru_sim": lambda spark, sf_dir: cache.lru_hits(table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("k"))),
    "space_amp": on_events(lambda log: runs.amplification(log, RUN)),
    "upsert_merge": lambda spark, sf_dir: lww.live(orders(spark, sf_dir)),
    "store_round_trip": store_round_trip,
    "byte_runs": byte_runs,
    "prefix_lengths": prefix_lengths,
    "oid_chain": oid_chain,
    "stream_live": stream_live,
}

# The SQL. Each text names the common tables it needs, in order.
_COMMON = {
    "ops": "ops as (select user_id as k, event_id as seq, case when event_type = 'error' then 1 else 0 end as op, case when event_type = 'error' then '' else props end as v from events)",
    "runs": f"runs as (select *, cast(floor(seq / {RUN}) as bigint) as run from ops), nr as (select cast(floor((max(seq) + 1) / {RUN}) as bigint) as r from ops)",
    "lay": """lay as (select runs.*, case when run < 625 * floor(r / 625) then 4 when run < 125 * floor(r / 125) then 3 when run < 25 * floor(r / 25) then 2
 when run < 5 * floor(r / 5) then 1 when run < r then 0 else -1 end as lvl from runs cross join nr),
sst as (select *, cast(floor(run / case lvl when 4 then 625 when 3 then 125 when 2 then 25 when 1 then 5 else 1 end) as bigint) as sid from lay)""",
    "sheads": "sheads as (select lvl, sid, k, seq, op, v from sst qualify row_number() over (partition by lvl, sid, k order by seq desc, op desc) = 1)",
    "stored": "stored as (select lvl, sid, k, seq, op, v from sst where lvl <= 0 union all select lvl, sid, k, seq, op, v from sheads where lvl > 0)",
    "heads": "heads as (select k, seq, op, v from ops qualify row_number() over (partition by k order by seq desc, op desc) = 1)",
}


def _sql(common: str, select: str) -> str:
    return "with " + ",\n".join(_COMMON[c] for c in common.split()) + "\n" + select


_FILES = "ops runs lay sheads stored"
ORACLES: dict[str, str] = {
    "kv_log": _sql("ops", "select k, seq, op, v from ops"),
    "kv_heads": _sql("ops heads", "select k, seq, op, v from heads"),
    "kv_live": _sql("ops heads", "select k, v, seq from heads where op = 0"),
    "kv_tombstoned": _sql("ops heads", "select k, seq from heads where op = 1"),
    "kv_get": _sql("ops heads", f"select k, v from heads where op = 0 and k = {KEY}"),
    "kv_multi_get": _sql("ops heads", "select q.k, case when h.k is null then 'not found' else 'ok' end as status, h.v from (select distinct cast(c_custkey as bigint) as k from customer) q left join (select k, v from heads where op = 0) h on q.k = h.k"),
    "kv_get_at_seq": _sql("ops", f"select k, v, seq from (select * from ops where seq <= {SNAPSHOT} qualify row_number() over (partition by k order by seq desc, op desc) = 1) where op = 0"),
    "kv_versions": _sql("ops", "select k, seq, op, v, row_number() over (partition by k order by seq desc, op desc) as pos from ops"),
    "mem_get": _sql("ops runs", "select k, v from (select runs.* from runs cross join nr where run >= r qualify row_number() over (partition by k order by seq desc, op desc) = 1) where op = 0"),
    "mem_size": _sql("ops runs", "select run, cast(sum(length(cast(k as varchar)) + 9 + length(v)) as bigint) as bytes, count(*) as entries from runs group by run"),
    "flush_meta": _sql("ops runs", "select run, count(*) as num_keys, max(seq) as max_seq, min(k) as min_key, max(k) as max_key from runs cross join nr where run < r group by run"),
    "merge_runs": _sql("ops runs lay sheads", "select lvl, sid, k, seq, op, v from sheads where lvl > 0"),
    "merge_meta": _sql("ops runs lay sheads", "select lvl, sid, count(*) as num_keys, max(seq) as max_seq, min(k) as min_key, max(k) as max_key from sheads where lvl > 0 group by lvl, sid"),
    "level_layout": _sql(_FILES, "select lvl, count(distinct sid) as files, count(*) as entries from stored group by lvl"),
    "tier_get": _sql("ops runs lay sheads", "select k, v, lvl from (select * from sheads qualify row_number() over (partition by k order by lvl, seq desc, op desc) = 1) where op = 0"),
    "tier_get_fallthrough": _sql("ops runs lay sheads", "select k, v, lvl from sheads where op = 0 qualify row_number() over (partition by k order by lvl, seq desc) = 1"),
    "zone_prune": _sql(_FILES, "select q.k, count(*) as candidate_files from (select distinct k from ops) q join (select lvl, sid, min(k) as mn, max(k) as mx from stored where lvl >= 0 group by lvl, sid) z on q.k between z.mn and z.mx group by q.k"),
    "filter_probe": _sql(_FILES, "select lvl, sid, count(*) as present from (select distinct lvl, sid, k from stored where lvl >= 0) f semi join (select distinct o_custkey as k from orders) p on f.k = p.k group by lvl, sid"),
    "seek_ge": _sql("ops", f"select k, seq, op, v from ops where k >= {SEEK} order by k, seq desc, op desc limit 1"),
    "iter_scan": _sql("ops runs", "select run, k, seq, op, row_number() over (partition by run order by k, seq desc, op desc) as pos from runs"),
    "key_range": _sql("ops heads", f"select k, v from heads where op = 0 and k between {LOW} and {HIGH}"),
    "top_k_keys": _sql("ops heads", "select k, v from heads where op = 0 order by k limit 10"),
    "block_index": _sql("ops runs", "select run, cast(floor(i / 12) as bigint) as blk, min(i) as first_pos, max(k) as max_key, count(*) as n from (select run, k, row_number() over (partition by run order by k, seq desc, op desc) - 1 as i from runs) group by run, cast(floor(i / 12) as bigint)"),
    "seq_recover": _sql("ops runs", "select max(seq) + 1 as next_seq, max(run) + 1 as next_log from runs"),
    "wal_replay": _sql("ops", "select k, seq, op, v from ops cross join (select coalesce(min(seq), 9223372036854775807) as b from ops where seq >= 9000 and v like '%42%') where seq < b"),
    "lru_sim": """with a as (select event_id as i, user_id as k, lag(event_id) over (partition by user_id order by event_id) as p from events)
select x.i, case when x.p is null then 0 when count(distinct y.k) < 64 then 1 else 0 end as hit from a x left join a y on y.i > x.p and y.i < x.i group by x.i, x.p""",
    "space_amp": _sql(_FILES + " heads", "select (select count(*) from stored) as stored_entries, (select count(*) from heads where op = 0) as live_entries"),
    "upsert_merge": """select k, v, seq from (select o_custkey as k, o_orderkey as seq, case when o_orderstatus = 'F' then 1 else 0 end as op, case when o_orderstatus = 'F' then '' else o_orderpriority end as v
from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1) where op = 0""",
    "store_round_trip": _sql("ops heads", "select cast(k as varchar) as k, v from heads where op = 0"),
    "prefix_lengths": _sql(
        "ops runs",
        """select run, cast(sum(case when i % 12 = 0 then 0 else coalesce(list_aggregate([x for x in range(1, least(strlen(k), strlen(p)) + 1) if k[1:x] = p[1:x]], 'max'), 0) end) as bigint) as shared_bytes, cast(sum(strlen(k)) as bigint) as key_bytes
from (select run, kk as k, row_number() over o - 1 as i, lag(kk) over o as p from (select run, seq, op, cast(k as varchar) as kk from runs) window o as (partition by run order by kk, seq desc, op desc)) group by run""",
    ),
    "byte_runs": _sql(
        "ops",
        f""", e as (select seq, sum(bytes) over (order by seq) - bytes as b from (select seq, strlen(cast(k as varchar)) + 9 + strlen(v) as bytes from ops)),
starts as (with recursive r as (select cast(0 as bigint) as run, cast(0 as hugeint) as first union all select run + 1, (select min(b) from e where b > first + {MEMTABLE_BYTES}) from r where exists (select 1 from e where b > first + {MEMTABLE_BYTES})) select * from r)
select run, count(*) as entries, min(seq) as first_seq, max(seq) as last_seq from e asof join starts on e.b >= starts.first group by run""",
    ),
    "oid_chain": _sql(
        "ops runs lay sheads stored",
        """, d as (select lvl, sha256(concat_ws('|', length(sid::varchar) || ':' || sid, length(k::varchar) || ':' || k, length(seq::varchar) || ':' || seq, length(op::varchar) || ':' || op, length(v) || ':' || v)) as h from stored where lvl >= 0),
s as (select lvl, concat_ws(',', count(*), sum(('0x' || h[1:15])::bigint), sum(('0x' || h[16:30])::bigint), sum(('0x' || h[31:45])::bigint), sum(('0x' || h[46:60])::bigint)) as w from d group by lvl),
i as (select l.level, sha256(coalesce(w, '0,0,0,0,0')) as oid from (select unnest(range(5))::int as level) l left join s on s.lvl = l.level)
select level, oid, sha256((select string_agg(level || ' ' || oid, e'\\n' order by level) from i)) as revision from i""",
    ),
    "stream_live": _sql("ops heads", "select k, v, seq from heads where op = 0"),
}
