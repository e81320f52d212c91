"""The write-ahead log: framed records, their checksums, and what of a log is valid.

A record is 4 bytes of CRC-32C over the payload, 4 of type, 4 of length, all little-endian,
then the payload. Reading ends well at the end of the file, also within a record; a record
of another type is bad, and one whose checksum differs is damaged. Everything before the
first record that isn't ok is valid.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import crc32c
from tidelog.model import Status, StoreError

HEAD = struct.Struct("<III")
#: The one type of record.
RECORD = 0

RECORDS = "log long, pos long, crc long, type int, len int, payload binary, status string"


def framed(payload: bytes) -> bytes:
    return HEAD.pack(crc32c(payload), RECORD, len(payload)) + payload


def records(data: bytes) -> Iterator[tuple[int, int, int, int, bytes, Status]]:
    """pos, crc, type, length, payload and status of each record, up to and including the first that isn't ok."""
    at = 0
    while True:
        if at + HEAD.size > len(data):
            yield at, 0, 0, 0, b"", Status.EOF
            return
        crc, kind, n = HEAD.unpack_from(data, at)
        payload = data[at + HEAD.size : at + HEAD.size + n]
        if kind != RECORD:
            status = Status.BAD_RECORD
        elif len(payload) < n:
            status = Status.EOF
        else:
            status = Status.OK if crc32c(payload) == crc else Status.CHECKSUM
        yield at, crc, kind, n, payload, status
        if status != Status.OK:
            return
        at += HEAD.size + n


def as_bytes(x: str | bytes) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


def encode(k: str | bytes, seq: int, op: int, v: str | bytes) -> bytes:
    """An operation as a payload: key, sequence number, operation, value; key and value behind their lengths."""
    key, value = as_bytes(k), as_bytes(v)
    inner = key + struct.pack("<qB", seq, op)
    return struct.pack("<I", len(inner)) + inner + struct.pack("<I", len(value)) + value


def decode(payload: bytes, binary: bool = False) -> tuple[str | bytes, int, int, str | bytes]:
    (n,) = struct.unpack_from("<I", payload)
    inner = payload[4 : 4 + n]
    seq, op = struct.unpack("<qB", inner[-9:])
    k, v = inner[:-9], payload[8 + n :]
    return (k, seq, op, v) if binary else (k.decode(), seq, op, v.decode())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all log files under ``path``, a task per file. A file's number is its name."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"(\d+)[^/]*$", 1).cast("long").alias("log"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for log, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [(log, *r[:5], r[5].value) for r in records(data)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["log", "pos", "crc", "type", "len", "payload", "status"])

    wide = files.mapInArrow(run, "log long, pos long, crc long, type long, len long, payload binary, status string")
    return wide.withColumn("type", F.col("type").cast("int")).withColumn("len", F.col("len").cast("int"))


def replay(spark: SparkSession, path: str | list[str], binary: bool = False) -> list[tuple[str | bytes, int, int, str | bytes]]:
    """The operations of the logs under ``path``, each once, in order of sequence number. Damage is an error; an end or a bad record isn't."""
    found = read(spark, path).where(F.col("status").isin(Status.OK.value, Status.CHECKSUM.value)).orderBy("log", "pos").collect()
    if any(r.status == Status.CHECKSUM.value for r in found):
        raise StoreError(f"{path}: {Status.CHECKSUM.value}")
    return sorted({decode(bytes(r.payload), binary) for r in found}, key=lambda o: (o[1], o[2]))


def valid_prefix(log: DataFrame, bad) -> DataFrame:
    """The entries before the first bad one. bad: the condition that marks bad entries; without any, all are valid."""
    first = log.where(bad).agg(F.coalesce(F.min("seq"), F.lit((1 << 63) - 1)).alias("first")).scalar()
    return log.where(F.col("seq") < first)
