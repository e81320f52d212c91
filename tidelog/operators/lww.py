"""Last writer wins: reads of a log as a map, now or at a past sequence number.

A key's newest version is the greatest (seq, op); a key whose newest version is a delete
has no value. Newest versions come from one aggregation with partial maxima, so a hot key
is one row a task in the shuffle. Conditions on ``k`` are pushed below it by Spark; those
on ``op`` or ``v`` only hold after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.functions.keys import newest, version_order
from tidelog.model import DELETE, PUT, Status
from tidelog.sources.staging import staged


def log_of(df: DataFrame, k: str, seq: str, deleted, v: str) -> DataFrame:
    """A table of changes as a log. deleted: the condition under which a row deletes its key."""
    gone = F.coalesce(deleted, F.lit(False))
    return df.select(F.col(k).alias("k"), F.col(seq).cast("long").alias("seq"), F.when(gone, DELETE).otherwise(PUT).alias("op"), F.when(gone, "").otherwise(F.col(v)).alias("v"))


def heads(log: DataFrame) -> DataFrame:
    """The newest version of each key."""
    return log.groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), newest()).alias("h")).select("k", "h.seq", "h.op", "h.v")


def live(log: DataFrame) -> DataFrame:
    """Every key that has a value."""
    return heads(log).where(F.col("op") == PUT).select("k", "v", "seq")


def tombstoned(log: DataFrame) -> DataFrame:
    """Every key whose newest version is a delete."""
    return heads(log).where(F.col("op") == DELETE).select("k", "seq")


def at_seq(log: DataFrame, seq: int) -> DataFrame:
    """The log as it was once ``seq`` was written."""
    return log.where(F.col("seq") <= seq)


def get(log: DataFrame, key) -> DataFrame:
    """The value of one key: a row (k, v), or none."""
    return live(log.where(F.col("k") == key)).select("k", "v")


def multi_get(log: DataFrame, probes: DataFrame) -> DataFrame:
    """probes: k. A row for each distinct probe: k, status, v."""
    keys = probes.select("k").distinct()
    # The log is cut to the probes first, so that only their keys are aggregated. Which side is small is Spark's to find out.
    found = live(log.join(keys, "k", "left_semi")).select("k", "v")
    status = F.when(F.col("seen").isNull(), Status.NOT_FOUND.value).otherwise(Status.OK.value)
    return keys.join(found.withColumn("seen", F.lit(True)), "k", "left").select("k", status.alias("status"), "v")


def versions(log: DataFrame) -> DataFrame:
    """All versions of all keys, each with its position, 1 the newest.

    Versions are dealt by ranges of their order, so a key with any number of them is spread;
    a range counts its own, and starts from those of its first key in the ranges before.
    """
    parts = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["k", "seq", "op", "v"]
    ranged = staged(log.select(*columns).repartitionByRange(parts, *version_order()).withColumn("part", F.spark_partition_id()))
    # A row a range, from here on: only a range's last key can go on in the next.
    ends = ranged.groupBy("part").agg(F.min("k").alias("low"), F.max("k").alias("high"))
    last = ranged.join(F.broadcast(ends), "part").where("k <=> high").groupBy("part", "k").agg(F.count("*").alias("n"))
    first = ends.select(F.col("part").alias("to"), F.col("low"))
    before = last.join(F.broadcast(first), (F.col("k").eqNullSafe(F.col("low"))) & (F.col("part") < F.col("to"))).groupBy(F.col("to").alias("part"), F.col("low").alias("own")).agg(F.sum("n").alias("before"))
    # A shuffle by range and key; a key's part of a range is at most the range.
    order = W.partitionBy("part", "k").orderBy(F.desc("seq"), F.desc("op"))
    placed = ranged.withColumn("own_pos", F.row_number().over(order)).join(F.broadcast(before), "part", "left")
    return placed.select(*columns, (F.col("own_pos") + F.when(F.col("k").eqNullSafe(F.col("own")), F.coalesce("before", F.lit(0))).otherwise(0)).cast("long").alias("pos"))


def seek(log: DataFrame, key) -> DataFrame:
    """The first entry, in version order, whose key isn't less than ``key``."""
    return log.where(F.col("k") >= key).orderBy(*version_order()).limit(1)


def key_range(log: DataFrame, low, high) -> DataFrame:
    """Live keys from ``low`` to ``high``, both included."""
    return live(log.where(F.col("k").between(low, high))).select("k", "v")


def first_keys(log: DataFrame, n: int) -> DataFrame:
    """The ``n`` least live keys."""
    return live(log).orderBy("k").limit(n).select("k", "v")
