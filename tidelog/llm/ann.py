"""Approximate nearest neighbours by inner product, on robust-pruned directed graphs.

Equal vectors are one node that keeps its ``TOP + 1`` smallest ids: further copies can't be
in any answer, as ties go to smaller ids. Nodes are dealt to shards by hash, so shards are
alike. Each shard builds a graph: points are inserted in growing batches, a beam search on
the graph so far proposes neighbours, and a point keeps a neighbour only where no kept one
is nearer to it by the factor ``ALPHA`` (relaxed pruning keeps diverse edges). Reverse
edges are added and pruned alike. One more edge a node forms a ring, so that every node can
be reached. A component that makes all norms equal turns inner products into distances; as
that separates vectors of unlike norms, each shard has a graph for every band of norms.

Graphs are written to the shared folder. The beam of each graph's searches is as wide as
its vectors ask for: the last points to be inserted are first searched for, and the beam
widens until the answers of a brute force over the graph are found at a rate of
``LEAST_RECALL``, so recall holds at other sizes and dimensions too. Of many shards each
holds few of a query's ``TOP`` answers, so its own best ``part_of(TOP)`` are asked for.

Queries go in blocks of bounded size, by a shuffle, to every shard: a group is one shard's
graphs and one block of queries. A beam search finds the shard's best nodes, whose scores
are taken again in double precision on the original vectors, and the shards' bests are
ranked together. A shard holds about ``SHARD_BYTES`` of vectors at most, whatever their
dimension; nothing passes the driver but counts.

Defined results: vectors that are null, empty, zero or hold null, NaN or infinite
components take no part, neither do rows with a null id or vectors whose length isn't the
commonest one (the shorter of two as common). Of rows that share an id the least vector
takes part. -0.0 equals 0.0. Other columns are ignored. Fewer candidates than ``TOP`` are
all returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.llm.common import staged, table

TOP, QUERY_EVERY = 20, 20
#: Out-edges of a node, beam widths when building and at least when searching, and the pruning factor on squared distances.
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 28, 64, 48, 1.35
#: Answers that a beam must find of points not yet inserted, and how many such points are tried.
LEAST_RECALL, TRIED = 0.94, 64
#: Nodes that a beam search expands at once.
EXPAND = 3
#: FEW shards as soon as each has LEAST_IN_SHARD vectors; then shards grow to FULL_SHARD, then
#: there are more of them, to SHARDS, then they grow again, to SHARD_BYTES of doubles.
FEW, LEAST_IN_SHARD, FULL_SHARD, SHARDS, SHARD_BYTES = 8, 512, 8192, 64, 64 << 20
#: Bytes of a block of queries, and cells of the table of visited nodes.
BLOCK_BYTES, VISITED = 16 << 20, 1 << 22
SEED_NODES, SEED = 256, 7
#: Norms in a band differ by this factor at most, but for the last band, which has all the rest.
BAND_RATIO, BANDS = 1.4, 16


def clean(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """The rows that take part: vec_id and vec, the components as little-endian doubles."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return rows.select("vec_id", F.lit(b"").alias("vec"))

    @F.pandas_udf("binary")
    def raw(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: (np.asarray(v, "<f8") + 0.0).tobytes())

    rows = rows.where(F.size("v") == common.d).select("vec_id", raw("v").alias("vec"))
    n, ids = rows.agg(F.count("*"), F.countDistinct("vec_id")).first()
    return rows if n == ids else rows.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def nodes(rows: DataFrame) -> DataFrame:
    """A row per distinct vector: vec, and ids, its smallest ones. Copies are cut down before they meet."""
    rank = F.row_number().over(W.partitionBy("vec").orderBy("vec_id"))
    return rows.withColumn("r", rank).where(F.col("r") <= TOP + 1).groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


class Graph:
    """x: unit-norm-like rows (float32), all of one norm. edges: DEGREE out-edges and the ring's, -1 where there is none."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, top: int = TOP):
        self.x, self.top = x, top
        n = len(x)
        self.edges, self.width = edges, SEARCH_BEAM
        if edges is None:
            self.edges = np.full((n, DEGREE + 1), -1, np.int32)
            self.build()

    def build(self) -> None:
        n = len(self.x)
        tried = max(SEED_NODES, n - min(TRIED, n // 8))
        order = np.random.default_rng(SEED).permutation(n)
        self.edges[order, DEGREE] = np.roll(order, -1)
        done = min(n, SEED_NODES)
        first = order[:done]
        near = self.x[first] @ self.x[first].T
        np.fill_diagonal(near, -np.inf)
        best = np.argsort(-near, axis=1)[:, : min(done - 1, BUILD_BEAM)]
        if best.shape[1]:
            self.edges[first, :DEGREE] = self.prune(first, first[best], np.take_along_axis(near, best, 1))
        self.entry = int(order[0])
        while done < n:
            if done == tried:
                self.width = self.asked_for(self.x[order[done:]], order[:done])
            size = min(done, 1024, (n if done >= tried else tried) - done)
            batch = order[done : done + size]
            found, sims = self.beam(self.x[batch], BUILD_BEAM)
            own = self.prune(batch, found, sims)
            self.edges[batch, :DEGREE] = own
            self.reverse(batch, own)
            done += size

    def asked_for(self, points: np.ndarray, known: np.ndarray) -> int:
        """The beam that finds the best of the ``known`` nodes for ``points``, which as queries lack the lifted component."""
        queries = points.copy()
        queries[:, -1] = 0
        top = min(self.top, len(known))
        worst = np.partition(queries @ self.x[known].T, len(known) - top, axis=1)[:, len(known) - top]
        width = SEARCH_BEAM
        while width < len(known):
            _, sims = self.beam(queries, width)
            if (sims[:, :top] >= worst[:, None] - 1e-6).mean() >= LEAST_RECALL:
                break
            width = width * 3 // 2
        return min(width, max(SEARCH_BEAM, len(known)))

    def distances(self, sims: np.ndarray) -> np.ndarray:
        return np.maximum(0, 2 * self.norm2 - 2 * sims)

    @property
    def norm2(self) -> float:
        return float(self.x[0] @ self.x[0])

    def prune(self, points: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """The neighbours that each point keeps of its candidates; -1 pads."""
        out = np.full((len(points), DEGREE), -1, np.int32)
        for at in range(0, len(points), 256):
            out[at : at + 256] = self.prune_block(points[at : at + 256], cand[at : at + 256], sims[at : at + 256])
        return out

    def prune_block(self, points: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> np.ndarray:
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        alive = (cand >= 0) & (cand != points[:, None]) & np.isfinite(sims)
        vectors = self.x[np.maximum(cand, 0)]
        far = self.distances(sims)
        kept = np.full((len(points), DEGREE), -1, np.int32)
        rows = np.arange(len(points))
        for k in range(DEGREE):
            pick = alive.argmax(axis=1)
            some = alive[rows, pick]
            if not some.any():
                break
            kept[some, k] = cand[rows, pick][some]
            between = self.distances(np.matmul(vectors, vectors[rows, pick][:, :, None])[:, :, 0])
            alive &= ALPHA * between > far
            alive[rows, pick] = False
            # A candidate listed twice has distance 0 to itself and dies with the first.
        return kept

    def reverse(self, batch: np.ndarray, own: np.ndarray) -> None:
        """Edges back to ``batch`` from the neighbours it chose."""
        source = np.repeat(batch, DEGREE)[own.ravel() >= 0].astype(np.int32)
        target = own.ravel()[own.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        width = min(int(count.max()), 2 * DEGREE) if len(heads) else 0
        new = np.full((len(heads), width), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(first, count)
        row = np.repeat(np.arange(len(heads)), count)
        fits = place < width
        new[row[fits], place[fits]] = source[fits]
        for at in range(0, len(heads), 256):
            points = heads[at : at + 256]
            cand = np.concatenate([self.edges[points, :DEGREE], new[at : at + 256]], axis=1)
            used = (cand >= 0).sum(axis=1)
            roomy = used <= DEGREE
            packed = np.take_along_axis(cand, np.argsort(cand < 0, axis=1, kind="stable"), 1)
            self.edges[points[roomy], :DEGREE] = packed[roomy, :DEGREE]
            if not roomy.all():
                tight = points[~roomy]
                own_cand = cand[~roomy]
                sims = np.matmul(self.x[np.maximum(own_cand, 0)], self.x[tight][:, :, None])[:, :, 0]
                self.edges[tight, :DEGREE] = self.prune_block(tight, own_cand, np.where(own_cand >= 0, sims, -np.inf))

    def beam(self, queries: np.ndarray, width: int, ring: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and similarities of a beam search for each query, best first; -1 and -inf pad.

        ring: follow the ring too. While building it leads to nodes that aren't in the graph yet.
        """
        size = max(1, min(512, VISITED // len(self.x)))
        parts = [self.beam_block(queries[at : at + size], width, ring) for at in range(0, len(queries), size)]
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def beam_block(self, queries: np.ndarray, width: int, ring: bool) -> tuple[np.ndarray, np.ndarray]:
        b, columns = len(queries), DEGREE + ring
        ids, sims = np.full((b, width), -1, np.int32), np.full((b, width), -np.inf, np.float32)
        opened = np.ones((b, width), bool)
        seen = np.zeros((b, len(self.x)), bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = self.entry, queries @ self.x[self.entry], False
        seen[:, self.entry] = True
        active = np.arange(b)
        while len(active):
            rows = active[:, None]
            # The best entries not opened yet; the beam is sorted, so they are the first ones.
            step = np.argsort(opened[active], axis=1, kind="stable")[:, :EXPAND]
            fresh = ~np.take_along_axis(opened[active], step, 1)
            chosen = np.where(fresh, np.take_along_axis(ids[active], step, 1), -1)
            opened[rows, step] = True
            nexts = np.where(chosen[:, :, None] >= 0, self.edges[np.maximum(chosen, 0), :columns], -1).reshape(len(active), -1)
            nexts = np.sort(nexts, axis=1)
            known = (nexts < 0) | seen[rows, np.maximum(nexts, 0)]
            known[:, 1:] |= nexts[:, 1:] == nexts[:, :-1]
            seen[np.broadcast_to(rows, nexts.shape)[~known], nexts[~known]] = True
            # Most are known already: pack the others to the left before gathering vectors.
            wide = int((~known).sum(axis=1).max())
            if wide:
                left = np.argsort(known, axis=1, kind="stable")[:, :wide]
                nexts, known = np.take_along_axis(nexts, left, 1), np.take_along_axis(known, left, 1)
                got = np.matmul(self.x[np.maximum(nexts, 0)], queries[active][:, :, None])[:, :, 0]
                got = np.where(known, -np.inf, got).astype(np.float32)
                all_sims = np.concatenate([sims[active], got], axis=1)
                best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
                ids[active] = np.take_along_axis(np.concatenate([ids[active], np.where(known, -1, nexts)], axis=1), best, 1)
                sims[active] = np.take_along_axis(all_sims, best, 1)
                opened[active] = np.take_along_axis(np.concatenate([opened[active], known], axis=1), best, 1)
            active = active[~opened[active].all(axis=1)]
        return ids, sims


def norms_of(x: np.ndarray) -> np.ndarray:
    """The rows' norms over the greatest component; squares of that can't overflow."""
    x = x / np.abs(x).max()
    return np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-300)


def lifted(x: np.ndarray) -> np.ndarray:
    """Scaled rows with one more component that makes all norms equal, in single precision."""
    x = x / np.abs(x).max()
    x = x / norms_of(x).max()
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]).astype(np.float32)


GRAPHS = "shard int, ids binary, counts binary, vectors binary, edges binary, entry int, width int"


def part_of(top: int, shards: int) -> int:
    """How many of a query's ``top`` answers one of ``shards`` shards hardly ever exceeds: its share, doubled, and two."""
    return min(top, 2 * -(-top // shards) + 2)


def build_shard(group: pa.Table, shards: int) -> pa.Table:
    """A graph for each band of norms: among vectors of like norms the largest inner products lie near."""
    vec, ids = group.column("vec").to_pylist(), group.column("ids").to_pylist()
    order = sorted(range(len(vec)), key=lambda i: vec[i])  # the same graphs whatever the order of rows
    vec, ids = [vec[i] for i in order], [ids[i] for i in order]
    x = np.frombuffer(b"".join(vec), "<f8").reshape(len(vec), -1)
    norms = norms_of(x)
    band = np.minimum(BANDS - 1, np.floor(np.log(norms.max() / norms) / np.log(BAND_RATIO))).astype(int)
    out = []
    for b in np.unique(band):
        own = np.flatnonzero(band == b)
        graph = Graph(lifted(x[own]), top=part_of(TOP, shards))
        mine = [ids[i] for i in own.tolist()]
        flat, counts = np.array([i for m in mine for i in m], "<i8"), np.array([len(m) for m in mine], "<i4")
        out.append((group.column("shard")[0].as_py(), flat.tobytes(), counts.tobytes(), x[own].tobytes(), graph.edges.tobytes(), graph.entry, graph.width))
    types = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["shard", "ids", "counts", "vectors", "edges", "entry", "width"])


def shards_of(n: int, size: int) -> int:
    """n: vectors; size: bytes of one."""
    few = min(FEW, n // LEAST_IN_SHARD)
    return max(1, few, min(SHARDS, -(-n // FULL_SHARD)), -(-n * size // SHARD_BYTES))


def graphs(distinct: DataFrame) -> DataFrame:
    """distinct: as of ``nodes``. The staged graphs, a row per shard and band of norms."""
    n, size = distinct.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    shards = shards_of(n, size or 0)
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int")).repartition(2 * shards, "shard")
    return staged(dealt.groupBy("shard").applyInArrow(lambda group: build_shard(group, shards), GRAPHS))


def search(own: dict, query_ids: np.ndarray, queries: np.ndarray, top: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The ``top`` best nodes of one graph, a row of ``GRAPHS``, for each query: query ids, ids, scores."""
    x = np.frombuffer(own["vectors"], "<f8").reshape(-1, queries.shape[1])
    graph = Graph(lifted(x), np.frombuffer(own["edges"], "<i4").reshape(-1, DEGREE + 1))
    graph.entry = own["entry"]
    counts, flat = np.frombuffer(own["counts"], "<i4"), np.frombuffer(own["ids"], "<i8")
    ends = np.cumsum(counts)
    for at in range(0, len(queries), 2048):
        part = queries[at : at + 2048]
        scaled = np.column_stack([part / np.maximum(np.abs(part).max(axis=1, keepdims=True), 1e-300), np.zeros(len(part))]).astype(np.float32)
        found, _ = graph.beam(scaled, max(own["width"], 2 * top), ring=True)
        for i, near in enumerate(found):
            near = near[near >= 0]
            scores = np.repeat((x[near] * part[i]).sum(axis=1), counts[near])
            ids = np.concatenate([flat[ends[k] - counts[k] : ends[k]] for k in near])
            other = ids != query_ids[at + i]
            ids, scores = ids[other], scores[other]
            best = np.lexsort((ids, -scores))[:top]
            yield np.full(len(best), query_ids[at + i]), ids[best], scores[best]


def nearest(rows: DataFrame, queries: DataFrame, top: int = TOP) -> DataFrame:
    """rows, queries: vec_id and vec, as of ``clean``. query_id, rank, vec_id, score."""
    found = graphs(staged(nodes(rows)))
    asked = queries.agg(F.sum(F.octet_length("vec"))).first()[0] or 0
    blocks = max(1, -(-asked // BLOCK_BYTES))
    shards = [r[0] for r in found.select("shard").distinct().orderBy("shard").collect()]

    def run(graph: pa.Table, block: pa.Table) -> pa.Table:
        out = []
        if graph.num_rows and block.num_rows:
            order = np.argsort(block.column("vec_id").to_numpy())
            ids, raw = block.column("vec_id").to_numpy()[order], block.column("vec").to_pylist()
            vectors = np.frombuffer(b"".join(raw[i] for i in order.tolist()), "<f8").reshape(len(ids), -1)
            for k in range(graph.num_rows):
                out += search(graph.slice(k, 1).to_pylist()[0], ids, vectors, top)
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    # Each block of queries goes to every shard, and each shard's graphs to every block.
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    left = found.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    right = queries.select(F.explode(F.array(*map(F.lit, shards)) if shards else F.array().cast("array<int>")).alias("shard"), block.alias("block"), "vec_id", "vec").groupBy("shard", "block")
    every = left.cogroup(right).applyInArrow(run, "query_id long, vec_id long, score double")
    ranked = every.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(clean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(QUERY_EVERY)) == 0))
