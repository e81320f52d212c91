"""Content ids and checksums."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _crc32c_table() -> list[int]:
    # Fixed value: the reflected Castagnoli polynomial.
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_TABLE = _crc32c_table()


def crc32c(data: bytes) -> int:
    """CRC-32C; Spark's own ``crc32`` has another polynomial."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc = _TABLE[(crc ^ byte) & 0xFF] ^ crc >> 8
    return crc ^ 0xFFFFFFFF


def row_digest(df: DataFrame, *columns: str) -> Column:
    """SHA-256 of a row's values; lengths keep neighbours apart. Bytes count by their hex digits."""
    hexed = {f.name for f in df.schema if f.dataType.typeName() == "binary"}
    texts = [F.hex(c) if c in hexed else F.col(c).cast("string") for c in columns]
    return F.sha2(F.concat_ws("|", *[F.concat_ws(":", F.length(t).cast("string"), t) for t in texts]), 256)


def content_sums(df: DataFrame, *columns: str) -> list[Column]:
    """Aggregates from which ``content_of`` makes an id: they merge task by task."""
    digest = row_digest(df, *columns)
    return [F.count("*").alias("n"), *[F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(4)]]


def content_of(sums) -> str:
    return hashlib.sha256(",".join(str(x or 0) for x in sums).encode()).hexdigest()


def content_id(df: DataFrame, *columns: str) -> str:
    """An id of the rows as a multiset, whatever their order and partitioning."""
    return content_of(df.agg(*content_sums(df, *columns)).first())


def chained_id(lines: list[str]) -> str:
    """The id of an object that is made of others: SHA-256 of its lines."""
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()
