"""What the training-text operators share: table readers, rows in a box, partition sizing."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.sources import staging
from tidelog.sources.staging import Scratch

#: Bytes of a batch that goes to a Python worker, whose task holds several at once.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables. Only Spark's readers touch the path, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``staging.staged``; while ``df`` is written, batches to Python workers are small, as rows may hold long texts or sets."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, BATCH_BYTES)
    try:
        return staging.staged(df, scratch)
    finally:
        conf.set(key, before)


def boxed(df: DataFrame, without: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """The row, but for the columns in ``without``, as one column ``row``; and ``columns``: no name of ``df`` can clash with theirs."""
    names = [c for c in df.columns if c not in without]
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(None).alias("none"))
    return df.select(row.alias("row"), *[c.alias(name) for name, c in columns.items()])


def unboxed(df: DataFrame, *added: Column | str, without: tuple[str, ...] = ()) -> DataFrame:
    """The rows out of their box, with columns ``added``; those in ``without``, in any case, are left out."""
    gone = {name.lower() for name in without}
    kept = [F.col("row").getField(name).alias(name) for name in df.schema["row"].dataType.names if name.lower() not in gone]
    return df.select(*kept, *added)


def beside(df: DataFrame, found: Column, *names: str) -> DataFrame:
    """``df`` with the fields ``names`` of the struct ``found`` in place of columns so named, in any case."""
    return unboxed(boxed(df, found=found), *[F.col("found").getField(n).alias(n) for n in names], without=names)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a staged table of narrow rows, marked for broadcast if it has at most so many; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no model learns from: crc32 of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in the text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def bounded_sample(df: DataFrame, stratum: str, bound: int, by: str = "doc_id") -> tuple[DataFrame, dict]:
    """About ``bound`` rows of each value of ``stratum`` at most, by a hash of ``by``, all where there are fewer; and the values' counts.

    Only for fitting a model. The rate of each value follows from its count, so rows meet nowhere.
    """
    counts = {r[0]: r[1] for r in df.where(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    whole = 1 << 30
    chosen = F.lit(False)
    for value, n in counts.items():
        chosen = chosen | ((F.col(stratum) == F.lit(value)) & (F.pmod(F.xxhash64(F.lit("sample"), by), F.lit(whole)) < int(whole * min(1.0, bound / n))))
    return df.where(chosen), counts


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> tuple[DataFrame, dict]:
    """doc_id, text and the label (int) of about ``bound`` documents of each label at most, outside the held-out fold; and the labels' counts.

    The sample is drawn from the labels alone, so what is broadcast has a bounded size.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias(column)).where(~held_out(F.col("doc_id")))
    drawn, counts = bounded_sample(known, column, bound)
    return staged(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")), counts


def release() -> None:
    """Give memory that a task has freed back to the system; Python workers live on after their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(task):
    """``task``, an Arrow function over batches, that gives memory back when it is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            release()

    return run


def releasing_group(task):
    """The same of a function over a group."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return task(table)
        finally:
            release()

    return run
