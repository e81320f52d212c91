"""What an LRU cache of a given size would hit along a trace of accesses.

The state of such a cache is the latest distinct keys, newest first. The trace is cut into
chunks; each chunk's own latest keys are found at once, and by doubling distances every
chunk gets the latest keys of all chunks before it, which stops as soon as each chunk has
a full cache or all of the past. Then all chunks are played through side by side.
"""

from __future__ import annotations

from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Accesses in a chunk.
CHUNK = 100_000


def latest(rows: DataFrame, capacity: int) -> DataFrame:
    """rows: chunk, k, i. The latest ``capacity`` distinct keys of each chunk."""
    last = rows.groupBy("chunk", "k").agg(F.max("i").alias("i"))
    rank = F.row_number().over(W.partitionBy("chunk").orderBy(F.desc("i")))
    return last.withColumn("r", rank).where(F.col("r") <= capacity).drop("r")


def lru_hits(trace: DataFrame, capacity: int = 64, chunk: int = CHUNK) -> DataFrame:
    """trace: i (unique, in order of access) and k. Returns i and hit, 1 or 0."""
    rows = trace.select(F.floor(F.col("i") / chunk).alias("chunk"), F.col("i").cast("long").alias("i"), F.col("k").cast("string").alias("k"))
    bounds = trace.agg(F.min(F.floor(F.col("i") / chunk)), F.max(F.floor(F.col("i") / chunk))).first()
    start = None
    if bounds[0] is not None and bounds[0] != bounds[1]:
        known, distance = latest(rows, capacity), 1
        # known: of each chunk, the latest keys of it and of ``distance`` - 1 chunks before.
        while distance < bounds[1] - bounds[0]:
            known = latest(known.unionByName(known.withColumn("chunk", F.col("chunk") + distance)), capacity)
            distance *= 2
        start = known.withColumn("chunk", F.col("chunk") + 1).withColumn("old", F.lit(True))
    played = rows.withColumn("old", F.lit(False))
    if start is not None:
        played = played.unionByName(start.select(*played.columns))

    def play(group: pa.Table) -> pa.Table:
        found = sorted(zip(group.column("i").to_pylist(), group.column("k").to_pylist(), group.column("old").to_pylist(), strict=True))
        cache: OrderedDict = OrderedDict()
        at, hits = [], []
        for i, key, old in found:
            hit = key in cache
            cache[key] = True
            cache.move_to_end(key)
            if len(cache) > capacity:
                cache.popitem(last=False)
            if not old:
                at.append(i)
                hits.append(int(hit))
        return pa.table({"i": pa.array(at, pa.int64()), "hit": pa.array(hits, pa.int32())})

    return played.groupBy("chunk").applyInArrow(play, "i long, hit int")
