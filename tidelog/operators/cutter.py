"""Cut a log into runs by bytes: a run ends with the entry that takes it over the limit.

Where a run ends depends on where it began, so a run's number follows from all before it.
The log is dealt in ranges of its order, one a shuffle partition. What happens in a range is
a function of one number, the size at which the open run ends, and a step function at that:
only the entries of about one limit can be the first to begin a run there. All ranges'
functions are found side by side, composed ``FANOUT`` at a time up a tree, and applied down
it, which gives every range the open run that it begins with; then all are numbered side by
side. Sizes are counted from the start of each range.

Ranges are sorted by Spark, which spills, and go through Python batch by batch. A worker holds
a batch, the sizes of one stretch and its function, or the functions of ``FANOUT`` ranges, each
of at most three numbers for each entry of one limit; jobs grow with the logarithm of the ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.keys import entry_bytes
from tidelog.sources.staging import Scratch, staged

#: Nodes of the tree that are composed in one task.
FANOUT = 32


@dataclass
class Steps:
    """What a stretch of the log does to (end, begun): the size beyond which the next run begins, and how many runs have begun."""

    #: Sizes before the entries that may begin the first run; the end after that, and the runs begun.
    heads: np.ndarray
    ends: np.ndarray
    begun: np.ndarray

    @classmethod
    def of(cls, begin: np.ndarray, limit: int) -> Steps:
        """begin: the log's size before each entry, in order."""
        n = len(begin)
        after = np.searchsorted(begin, begin + limit, side="right")
        last = np.where(after < n, after, np.arange(n))
        jumps = (after < n).astype(np.int64)
        # By doubling, each entry's chain of runs up to the last that begins here.
        while (last[last] != last).any():
            jumps, last = jumps + jumps[last], last[last]
        return cls(begin, begin[last] + limit, jumps + 1).cut(limit)

    def cut(self, limit: int) -> Steps:
        """Without heads that no run open at the start can end at: it began before the first."""
        upto = int(np.searchsorted(self.heads, self.heads[0] + limit)) + 1
        return Steps(self.heads[:upto], self.ends[:upto], self.begun[:upto])

    def then(self, other: Steps, limit: int) -> Steps:
        end, begun = other.after(self.ends, self.begun)
        joined = Steps(np.concatenate([self.heads, other.heads]), np.concatenate([end, other.ends]), np.concatenate([begun, other.begun]))
        return joined.cut(limit)

    def after(self, end: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.heads, end, side="right")
        some, own = at < len(self.heads), np.minimum(at, len(self.heads) - 1)
        return np.where(some, self.ends[own], end), begun + np.where(some, self.begun[own], 0)

    def moved(self, by: int) -> Steps:
        return Steps(self.heads + by, self.ends + by, self.begun)

    def row(self, node: int, length: int) -> dict:
        """length: the stretch's bytes, from where its function counts to where the next one's does."""
        return {"node": pa.array([node], pa.int32()), "length": pa.array([length], pa.int64()), **{name: pa.array([getattr(self, name).astype("<i8").tobytes()], pa.binary()) for name in ("heads", "ends", "begun")}}


STEPS, STATE = "node int, length long, heads binary, ends binary, begun binary", "node int, end long, started long"


def steps_of(table: pa.Table) -> list[tuple[int, int, Steps]]:
    """The nodes of a table, their lengths and their functions, in order."""
    columns = [table.column(name).to_pylist() for name in ("node", "length", "heads", "ends", "begun")]
    return [(node, length, Steps(*[np.frombuffer(raw, "<i8") for raw in raws])) for node, length, *raws in sorted(zip(*columns, strict=True))]


def run_numbers(begin: np.ndarray, limit: int, end: int, begun: int) -> np.ndarray:
    """begin: the log's size before each entry of a stretch, in order; end: beyond which the open run ends; begun: runs so far. The entries' run numbers."""
    runs, at = np.empty(len(begin), np.int64), 0
    while at < len(begin):
        # The memtable is tested before each write.
        upto = int(np.searchsorted(begin, end, side="right"))
        runs[at:upto] = begun - 1
        if upto < len(begin):
            end, begun = int(begin[upto]) + limit, begun + 1
        at = max(at, upto)
    return runs


def measured(columns: list[str], limit: int, span: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a range in order, with ``__bytes``: its rows with ``__begin``, their range's size before each, and one more row with the range's function. span: bytes of entries whose sizes are held."""

    def of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, size, held, whole, kinds = TaskContext.get().partitionId(), 0, [], None, []

        def extended() -> Steps:
            steps = Steps.of(np.concatenate(held), limit)
            return whole.then(steps, limit) if whole else steps

        for batch in batches:
            n, sizes = batch.num_rows, batch.column("__bytes").to_numpy()
            if not n:
                continue
            begin = size + np.cumsum(sizes) - sizes
            size += int(sizes.sum())
            held.append(begin)
            if size - held[0][0] >= span:
                whole, held = extended(), []
            kinds = [batch.column(c).type for c in columns]
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(begin), pa.array(np.full(n, node, np.int32)), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.binary())] * 3], names)
        if held:
            whole = extended()
        if whole:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, kind) for kind in kinds], pa.nulls(1, pa.int64()), *whole.row(node, size).values()], names)

    names = [*columns, "__begin", "__node", "__length", "__heads", "__ends", "__begun"]
    return of_range


def numbered(columns: list[str], limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a range in order, with ``__begin`` and the ``__end`` and ``__started`` that it begins with: its rows with ``run``."""

    def of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = begun = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if begun is None:
                end, begun = batch.column("__end")[0].as_py(), batch.column("__started")[0].as_py()
            begin = batch.column("__begin").to_numpy()
            found = run_numbers(begin, limit, end, begun)
            if found[-1] >= begun:
                end, begun = int(begin[np.searchsorted(found, found[-1])]) + limit, int(found[-1]) + 1
            yield pa.RecordBatch.from_arrays([*map(batch.column, columns), pa.array(found)], [*columns, "run"])

    return of_range


def starts(functions: DataFrame, last: int, limit: int, scratch: Scratch) -> DataFrame:
    """functions: STEPS of nodes, ``last`` the greatest there may be. Of each node: where the run ends that is open at its start, and how many runs have begun."""

    def composed(group: pa.Table) -> pa.Table:
        (first, length, whole), *rest = steps_of(group)
        for _, more, steps in rest:
            whole, length = whole.then(steps.moved(length), limit), length + more
        return pa.table(whole.row(first // FANOUT, length))

    def handed_down(group: pa.Table) -> pa.Table:
        end, begun = np.array([group.column("end")[0].as_py()]), np.array([group.column("started")[0].as_py()])
        rows = []
        for node, length, steps in steps_of(group):
            rows.append((node, int(end[0]), int(begun[0])))
            end, begun = steps.after(end, begun)
            end = end - length
        return pa.table(dict(zip(("node", "end", "started"), map(pa.array, zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64())), strict=True)))

    levels, parent = [functions], F.floor(F.col("node") / FANOUT).cast("int")
    while last := last // FANOUT:
        levels.append(staged(levels[-1].groupBy(parent).applyInArrow(composed, STEPS), scratch))
    # No run is open before the log, so its first entry begins one.
    state = functions.sparkSession.createDataFrame([(0, -1, 0)], STATE)
    for depth in reversed(range(len(levels))):
        above = state.withColumnRenamed("node", "parent")
        state = levels[depth].withColumn("parent", parent).join(above, "parent").groupBy("parent").applyInArrow(handed_down, STATE)
        state = staged(state, scratch) if depth else state
    return state


def byte_runs(log: DataFrame, limit: int, chunk_bytes: int = 1 << 22) -> DataFrame:
    """The log with ``run``, counted from 0, for memtables that are frozen once they hold more than ``limit`` bytes. chunk_bytes: of entries whose sizes a task holds, but a limit at least."""
    parts, columns = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions")), log.columns
    kept = [T.StructField(f.name, f.dataType) for f in log.schema]
    own = [T.StructField("__begin", T.LongType()), *[T.StructField(f"__{name}", kind) for name, kind in zip(("node", "length", "heads", "ends", "begun"), (T.IntegerType(), T.LongType(), *[T.BinaryType()] * 3), strict=True)]]
    # Entries of no known size are in no run.
    sized = log.withColumn("__bytes", entry_bytes(F.col("k"), F.col("v"))).where(F.col("__bytes").isNotNull())
    ranges = sized.repartitionByRange(parts, "seq").sortWithinPartitions("seq")
    # Written out, as all that follows must see the same ranges.
    ranged, scratch = staged(ranges.mapInArrow(measured(columns, limit, max(limit, chunk_bytes)), T.StructType([*kept, *own]))), Scratch()
    functions = ranged.where(F.col("__heads").isNotNull()).select(*[F.col(f"__{name}").alias(name) for name in ("node", "length", "heads", "ends", "begun")])
    state = staged(starts(functions, parts - 1, limit, scratch).toDF("__node", "__end", "__started"))
    scratch.drop()
    # Each range goes to a task of its own; of the state there is one row a range.
    rows = ranged.where(F.col("__heads").isNull()).select(*columns, "__begin", "__node").repartitionById(parts, "__node")
    ordered = rows.join(F.broadcast(state), "__node").drop("__node").sortWithinPartitions("__begin")
    return ordered.mapInArrow(numbered(columns, limit), T.StructType([*kept, T.StructField("run", T.LongType())]))
