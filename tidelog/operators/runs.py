"""Runs and levels: how a log lies in sorted runs, and what reads and merges of them give.

A run is ``per_run`` consecutive entries; the last, unfinished one is the memtable. With at
most ``fan`` runs a level and a merge of a whole level into one run of the next, the level
of a run follows from the number of finished runs alone: the counts of files in levels are
the digits of that number to base ``fan + 1``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.keys import entry_bytes, newest
from tidelog.model import DELETE, LEVELS, PUT
from tidelog.operators.lww import live
from tidelog.operators.running import running_sum

#: Stands for the level of the memtable.
MEMTABLE = -1


def with_run(log: DataFrame, per_run: int) -> DataFrame:
    return log.withColumn("run", F.floor(F.col("seq") / per_run))


def finished(log: DataFrame, per_run: int) -> Column:
    """How many runs are finished, as a subquery that Spark evaluates once."""
    return log.agg(F.floor((F.max("seq") + 1) / per_run).alias("r")).scalar()


def placed(log: DataFrame, per_run: int, fan: int = 4) -> DataFrame:
    """The log with run, lvl and sid, the file of its level that each entry lies in."""
    base, done = fan + 1, finished(log, per_run)
    level = F.when(F.col("run") < done, 0).otherwise(MEMTABLE)
    for depth in range(1, LEVELS):
        width = base**depth
        level = F.when(F.col("run") < width * F.floor(done / width), depth).otherwise(level)
    rows = with_run(log, per_run).withColumn("lvl", level)
    width = F.element_at(F.array(*[F.lit(base**d) for d in range(LEVELS)]), F.greatest("lvl", F.lit(0)) + 1)
    return rows.withColumn("sid", F.floor(F.col("run") / width))


def file_heads(log: DataFrame, per_run: int) -> DataFrame:
    """The newest version of each key in each file."""
    return placed(log, per_run).groupBy("lvl", "sid", "k").agg(F.max_by(F.struct("seq", "op", "v"), newest()).alias("h")).select("lvl", "sid", "k", "h.seq", "h.op", "h.v")


def merged(log: DataFrame, per_run: int) -> DataFrame:
    """What merges wrote: one version of each key in each file below level 0, deletes included."""
    return file_heads(log, per_run).where("lvl > 0")


def merge(*runs: DataFrame, drop_deleted: bool = False) -> DataFrame:
    """Merge runs into one: the newest version of each key. Deletes may go only where no older run holds the key."""
    every = runs[0]
    for run in runs[1:]:
        every = every.unionByName(run)
    out = every.groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), newest()).alias("h")).select("k", "h.seq", "h.op", "h.v")
    return out.where(F.col("op") != DELETE) if drop_deleted else out


def stored(log: DataFrame, per_run: int) -> DataFrame:
    """Every entry that is stored: all of the memtable and of level 0, merged ones below."""
    columns = ["lvl", "sid", "k", "seq", "op", "v"]
    return placed(log, per_run).where("lvl <= 0").select(*columns).unionByName(merged(log, per_run).select(*columns))


def file_meta(entries: DataFrame, *by: str) -> DataFrame:
    return entries.groupBy(*by).agg(F.count("*").alias("num_keys"), F.max("seq").alias("max_seq"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))


def flush_meta(log: DataFrame, per_run: int) -> DataFrame:
    """The metadata of each run as it was flushed."""
    return file_meta(with_run(log, per_run).where(F.col("run") < finished(log, per_run)), "run")


def layout(log: DataFrame, per_run: int) -> DataFrame:
    """Files and entries of each level. Counted by file first, so no level meets in one task."""
    return stored(log, per_run).groupBy("lvl", "sid").agg(F.count("*").alias("n")).groupBy("lvl").agg(F.count("*").alias("files"), F.sum("n").alias("entries"))


def memtable(log: DataFrame, per_run: int) -> DataFrame:
    return with_run(log, per_run).where(F.col("run") >= finished(log, per_run)).drop("run")


def memtable_bytes(log: DataFrame, per_run: int) -> DataFrame:
    """Bytes and entries of each run while it was a memtable; overwritten entries count too."""
    return with_run(log, per_run).groupBy("run").agg(F.sum(entry_bytes(F.col("k"), F.col("v"))).alias("bytes"), F.count("*").alias("entries"))


def _tier() -> Column:
    """The order in which files are asked: the memtable, then level by level."""
    return F.col("lvl") + 1


def tier_get(log: DataFrame, per_run: int) -> DataFrame:
    """Each live key with the level that answers for it. Deletes mask what lies deeper."""
    best = F.max_by(F.struct("op", "v", "lvl"), F.struct(-_tier(), F.col("seq"), F.col("op")))
    found = placed(log, per_run).groupBy("k").agg(best.alias("h"))
    return found.where(F.col("h.op") == PUT).select("k", "h.v", "h.lvl")


def tier_get_fallthrough(log: DataFrame, per_run: int) -> DataFrame:
    """As ``tier_get``, but a file whose newest version of a key is a delete passes the question on to older files."""
    best = F.max_by(F.struct("v", "lvl"), F.struct(-_tier(), F.col("seq")))
    found = file_heads(log, per_run).where(F.col("op") == PUT).groupBy("k").agg(best.alias("h"))
    return found.select("k", "h.v", "h.lvl")


def candidate_files(log: DataFrame, per_run: int) -> DataFrame:
    """For each key, how many files its value could be in by their least and greatest keys.

    Files that begin at the key or before, less those that end before it: two running
    counts along the keys instead of a join of keys and files.
    """
    files = stored(log, per_run).where("lvl >= 0").groupBy("lvl", "sid").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    # At one key beginnings come first, then the key itself, then ends.
    points = files.select(F.col("low").alias("k"), F.lit(0).alias("kind"), F.lit(1).alias("step"))
    points = points.unionByName(files.select(F.col("high").alias("k"), F.lit(2).alias("kind"), F.lit(-1).alias("step")))
    points = points.groupBy("k", "kind").agg(F.sum("step").alias("step"))
    points = points.unionByName(log.select("k").distinct().select("k", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("step")))
    counted = running_sum(points, ["k", "kind"], "step", "open")
    return counted.where((F.col("kind") == 1) & (F.col("open") > 0)).select("k", F.col("open").alias("candidate_files"))


def probe_files(log: DataFrame, per_run: int, probes: DataFrame) -> DataFrame:
    """For each file, how many of its keys are among ``probes`` (k)."""
    keys = stored(log, per_run).where("lvl >= 0").select("lvl", "sid", "k").distinct()
    return keys.join(probes.select("k").distinct(), "k", "left_semi").groupBy("lvl", "sid").agg(F.count("*").alias("present"))


def scan(log: DataFrame, per_run: int) -> DataFrame:
    """Every version in every run, in key order, newest first, with its position in the run."""
    order = W.partitionBy("run").orderBy("k", F.desc("seq"), F.desc("op"))
    return with_run(log, per_run).withColumn("pos", F.row_number().over(order).cast("long")).select("run", "k", "seq", "op", "pos")


def blocks(log: DataFrame, per_run: int, per_block: int = 12) -> DataFrame:
    """The index of each run: per block of entries its first position, greatest key and size."""
    at = scan(log, per_run).withColumn("i", F.col("pos") - 1).withColumn("blk", F.floor((F.col("pos") - 1) / per_block))
    return at.groupBy("run", "blk").agg(F.min("i").alias("first_pos"), F.max("k").alias("max_key"), F.count("*").alias("n"))


def recovered(log: DataFrame, per_run: int) -> DataFrame:
    """The sequence and log numbers that come next."""
    return log.agg((F.max("seq") + 1).alias("next_seq"), (F.floor(F.max("seq") / per_run) + 1).alias("next_log"))


def amplification(log: DataFrame, per_run: int) -> DataFrame:
    """Entries that are stored, against keys that are live."""
    kept = stored(log, per_run).agg(F.count("*").alias("stored_entries"))
    return kept.withColumn("live_entries", live(log).agg(F.count("*").alias("n")).scalar())
