"""Connected components of links.

Each task first solves the links it holds, ``HELD`` of them at most, by union-find, and
hands on one link for each node, to the least node it reaches. Once a single task holds
all links that is the answer. Else large-star and small-star rounds bring the parts
together, and the tasks' results are taken again, until nothing changes.

Defined results: a link of a node with itself, or with null, says nothing; links may be
repeated and lead either way. Nodes without links have no row, an empty table gives an
empty result, and columns other than a and b are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import staged

#: Links that a task solves at once.
HELD = 200_000


def solved(u: list, v: list) -> dict:
    """Each node that has links, with the least node it reaches."""
    above: dict = {}

    def root(x):
        while (y := above.setdefault(x, x)) != x:
            above[x] = x = above[y]
        return x

    for a, b in zip(u, v, strict=True):
        a, b = root(a), root(b)
        if a != b:
            above[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(above)}


def _contracted(edges: DataFrame, parts: int) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, types = [], [], None
        for batch in batches:
            types = batch.schema.field(0).type
            u += batch.column(0).to_pylist()
            v += batch.column(1).to_pylist()
        if u:
            found = [(a, b) for a, b in solved(u, v).items() if a != b]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], types) for i in (0, 1)], names=["u", "v"])

    return edges.coalesce(parts).mapInArrow(run, f"u {kind}, v {kind}")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u and v. Each node hands its neighbours on to the least of them.

    large: neighbours above the node, from edges both ways; else those below, from edges
    that lead down. The least neighbour is a partial minimum, so a hub is a row a task.
    """
    if large:
        edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
    met = edges.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u != m").select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, held: int = HELD) -> DataFrame:
    """links: a and b, of any orderable type. Returns node and label, its component's least node; nodes without links have no row."""
    edges = staged(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        parts = max(1, -(-edges.count() // held))
        edges = staged(_contracted(edges, parts))
        if parts == 1:
            break
        edges = staged(_stars(staged(_stars(edges, large=True)), large=False))
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    least = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return least.unionByName(least.select(F.col("label").alias("node"), "label").distinct())
