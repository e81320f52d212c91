"""Running sums along a total order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.sources.staging import staged


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each one in ``order``.

    Rows are dealt by ranges of the order; each range adds up its own rows and starts from
    the sum of the ranges before it, a row per range. The ranges are written out, as both
    steps must see the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = staged(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__sum"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # One row a range: as many as there are shuffle partitions.
    summed = ranged.withColumn("__own", F.sum(value).over(within)).join(F.broadcast(starts), "__part")
    return summed.withColumn(name, F.col("__start") + F.col("__own")).drop("__part", "__own", "__start")
