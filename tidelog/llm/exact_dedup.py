"""Exact deduplication: a two-pass Bloom filter, then a shuffle of possible repeats only.

Pass one folds every row's digest into a pair of bitmaps, "seen" and "seen again", of the
segments that a task's rows touch, compressed and merged segment by segment on the
executors, some tasks' first and then the rest. A digest whose slots are all
in the merged "seen again" bitmap may be repeated; any other digest is certainly unique.
Pass two sends only the possible repeats through a shuffle on the digest. A false
positive costs a shuffled row and never changes a result.

The bitmap has about ``BITS_PER_ROW`` bits a row and at most ``MAX_BITS`` (64 MB), which
bounds what is collected and broadcast. Beyond that bound the filter fills, more rows
shuffle, and results stay the same.

Defined results: null text is the empty text; only A-Z are folded. Of equal texts the
row with the largest id stays; a null id ranks below all others, and of rows that tie
(repeated rows) exactly one stays. An empty table gives an empty result. Other columns
are carried along by ``drop_copies``, whatever their names, and ignored by ``copy_groups``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, boxed, releasing, staged, table, unboxed
from tidelog.llm.words import ARRAYS, LANES, SEGMENT, added_up, compressed

#: Slots of the filter for each row, and slots that one digest sets.
BITS_PER_ROW, PROBES = 16, 4
MIN_BITS, MAX_BITS = 1 << 16, 1 << 29
#: Slots that a task holds before it folds them into bitmaps.
HELD = 4_000_000

DIGEST = "__digest"


def digest_of(text: str | None) -> bytes:
    """SHA-256 of the text with A-Z lower-cased; ``bytes.lower`` folds ASCII only."""
    return hashlib.sha256((text if isinstance(text, str) else "").encode().lower()).digest()


def with_digest(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` and a binary column with the digest of its text."""

    @F.pandas_udf("binary")
    def digest(texts: pd.Series) -> pd.Series:
        return texts.map(digest_of)

    return df.withColumn(DIGEST, digest(F.col(text_col).cast("string")))


def slots(digests: np.ndarray, bits: int) -> np.ndarray:
    """Row i has the slots of digest i. digests: 32 bytes each, as four 64-bit words."""
    return ((digests[:, :1] + np.arange(PROBES, dtype=np.uint64) * (digests[:, 1:2] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def words_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, 4)


def seen_again(digests: DataFrame, rows: int) -> tuple[int, bytes]:
    """The number of slots, and the packed bitmap of those that two or more rows set."""
    bits = MIN_BITS
    while bits < min(rows * BITS_PER_ROW, MAX_BITS):
        bits *= 2

    def flushed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """The segments that some rows touch, each as two packed bitmaps end to end: seen, and seen again."""
        lane = TaskContext.get().partitionId() % LANES
        hit, n = np.unique(np.concatenate(held), return_counts=True)
        for k in np.unique(hit // SEGMENT).tolist():
            own = slice(*np.searchsorted(hit, [k * SEGMENT, (k + 1) * SEGMENT]))
            both = np.zeros(2 * SEGMENT, bool)
            both[hit[own] - k * SEGMENT] = True
            both[hit[own][n[own] > 1] - (k - 1) * SEGMENT] = True
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "lane": pa.array([lane], pa.int32()), "array": [compressed(np.packbits(both).tobytes())]})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                # A digest may hit a slot twice with two of its probes: that is one row still.
                own = np.sort(slots(words_of(batch.column(0)), bits), axis=1)
                fresh = np.ones(own.shape, bool)
                fresh[:, 1:] = own[:, 1:] != own[:, :-1]
                held.append(own[fresh])
            if sum(map(len, held)) >= HELD:
                yield from flushed(held)
                held = []
        if held:
            yield from flushed(held)

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        once = again = np.zeros(SEGMENT // 8, np.uint8)
        for part in parts:
            a, b = part[: SEGMENT // 8], part[SEGMENT // 8 :]
            again, once = again | b | (once & a), once | a
        return np.concatenate([once, again])

    whole = bytearray(bits // 8)
    for k, part in added_up(digests.select(DIGEST).mapInArrow(releasing(build), ARRAYS), "u1", merge):
        whole[k * SEGMENT // 8 : (k + 1) * SEGMENT // 8] = part[SEGMENT // 8 :].tobytes()
    return bits, bytes(whole)


def with_maybe(df: DataFrame, bits: int, again: bytes) -> DataFrame:
    """``df`` and a boolean column ``__maybe``: whether its digest may be repeated."""
    packed = df.sparkSession.sparkContext.broadcast(again)

    @F.pandas_udf("boolean")
    def maybe(digests: pd.Series) -> pd.Series:
        own = slots(np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4), bits)
        bitmap = np.frombuffer(packed.value, np.uint8)
        return pd.Series(((bitmap[own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1).all(axis=1))

    return df.withColumn("__maybe", maybe(DIGEST))


def copy_groups(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """A row per row of ``df``: id, keep_id, group_size, kept, text_sha256."""
    digests = staged(with_digest(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", DIGEST).withColumn("__row", F.monotonically_increasing_id()))
    marked = with_maybe(digests, *seen_again(digests, digests.count()))
    alone = marked.where("not __maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), DIGEST)
    repeats = marked.where("__maybe").drop("__maybe")
    # Copies meet as one partial sum a task. Groups are staged, so that a plain shuffle stands
    # on both sides of the join back and Spark can split a large group's partition.
    groups = staged(repeats.groupBy(DIGEST).agg(F.max(F.struct("doc_id", "__row")).alias("best"), F.count("*").alias("group_size")))
    met = repeats.join(groups, DIGEST).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("__row") == F.col("best.__row")).alias("kept"), DIGEST)
    return alone.unionByName(met).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex(DIGEST)).alias("text_sha256"))


def drop_copies(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with its columns. Only possible repeats are shuffled."""
    digests = with_digest(boxed(df, text=F.col(text_col), id=F.col(id_col)), "text")
    scratch = Scratch()
    slim = staged(digests.select(DIGEST), scratch)
    marked = with_maybe(digests, *seen_again(slim, slim.count()))
    scratch.drop()
    alone = marked.where("not __maybe").select("row")
    # The largest id, ties settled by the row's hash; partial maxima keep one row a task of each group.
    best = marked.where("__maybe").groupBy(DIGEST).agg(F.max_by("row", F.struct("id", F.xxhash64("row"))).alias("row"))
    return unboxed(alone.unionByName(best.select("row")))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents"))


SQL = """
with t as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id desc nulls last) = 1 as kept, text_sha256
from t
"""
