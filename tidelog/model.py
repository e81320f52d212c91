"""The data model: one append-only log of versioned operations, its options and its outcomes.

A log has the columns ``k`` (any orderable type, one per table), ``seq`` (bigint, the write
order), ``op`` (0 put, 1 delete) and ``v`` (the value; empty for a delete). Whether a key
is deleted is told by ``op`` alone: an empty value is a value.
"""

from __future__ import annotations

from dataclasses import dataclass
from enum import StrEnum

from pyspark.sql import types as T

PUT, DELETE = 0, 1
#: Levels of runs, 0 the newest.
LEVELS = 5



def log_schema(binary: bool = False) -> T.StructType:
    """A store's log: keys and values are text, or bytes."""
    kind = T.BinaryType() if binary else T.StringType()
    return T.StructType([T.StructField("k", kind, False), T.StructField("seq", T.LongType(), False), T.StructField("op", T.IntegerType(), False), T.StructField("v", kind, False)])


LOG = log_schema()

MANIFEST = T.StructType(
    [
        T.StructField("level", T.IntegerType(), False),
        T.StructField("sst", T.StringType(), False),
        T.StructField("num_keys", T.LongType(), False),
        T.StructField("max_seq", T.LongType(), False),
        T.StructField("min_key", T.StringType(), False),
        T.StructField("max_key", T.StringType(), False),
        T.StructField("file_size", T.LongType(), False),
    ]
)


class Status(StrEnum):
    """Outcomes of reading data."""

    OK = "ok"
    NOT_FOUND = "not found"
    EOF = "file eof"
    BAD_RECORD = "bad record"
    CHECKSUM = "check sum error"


class StoreError(Exception):
    """A store can't do what it is asked to; the message says why."""


@dataclass(frozen=True)
class Options:
    create_if_missing: bool = True
    #: Bits that a run's bloom filter has for each key.
    bits_per_key: int = 10
    #: Bytes of operations that a memtable may hold before the next write freezes it.
    memtable_bytes: int = 4 << 20
    #: Runs that a level may have; one more and the level is merged into the next.
    level_files: int = 4
    #: Write the log out with each operation.
    sync: bool = False
    #: Bytes of log that may wait in memory.
    log_buffer: int = 64 << 10
    #: Bytes of operations in a Parquet file of a run, about; a run of more has several, in key order.
    file_bytes: int = 256 << 20
    #: Keys and values are bytes, not text. A store keeps the kind it was made with.
    binary: bool = False
    #: Sets of runs that stay open for reading, and answers of runs for single keys that are kept.
    open_runs: int = 64
    cached_answers: int = 2048
    #: Merge levels in a thread of its own, so that writes don't wait for it.
    background: bool = False
