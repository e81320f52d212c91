"""Keys: sizes, the order of versions, the packed form, shared prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a packed key has besides the user's: 8 of sequence number, 1 of operation.
KEY_OVERHEAD = 9


def entry_bytes(k: Column, v: Column) -> Column:
    """What an entry counts for in a memtable."""
    return (F.octet_length(k.cast("string")) + F.lit(KEY_OVERHEAD) + F.octet_length(v)).cast("long")


def newest() -> Column:
    """Of several versions of a key the greatest of this is the newest; a delete beats a put of the same number."""
    return F.struct("seq", "op")


def version_order() -> list[Column]:
    return [F.col("k").asc(), F.col("seq").desc(), F.col("op").desc()]


def packed(k: Column, seq: Column, op: Column) -> Column:
    """User key, sequence number as 8 little-endian bytes, operation as one."""
    big = F.unhex(F.lpad(F.hex(seq), 16, "0"))
    little = F.reduce(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), F.unhex(F.lit("")), lambda acc, i: F.concat(acc, F.substring(big, i, F.lit(1))))
    return F.concat(k.cast("string").cast("binary"), little, F.unhex(F.lpad(F.hex(op), 2, "0")))


def unpacked(key: Column) -> Column:
    """A packed key as a struct of k (bytes), seq and op."""
    n = F.octet_length(key) - KEY_OVERHEAD
    big = F.reduce(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), F.lit(""), lambda acc, i: F.concat(acc, F.hex(F.substring(key, n + i, F.lit(1)))))
    # 64 bits in two halves, as the sign is in the upper one.
    upper, lower = (F.conv(F.substring(big, at, 8), 16, 10).cast("long") for at in (1, 9))
    seq = F.shiftleft(upper, 32).bitwiseOR(lower)
    return F.struct(F.substring(key, F.lit(1), n).alias("k"), seq.alias("seq"), F.conv(F.hex(F.substring(key, n + KEY_OVERHEAD, F.lit(1))), 16, 10).cast("int").alias("op"))


def shown(k: Column, seq: Column, op: Column) -> Column:
    """A version's key as text for people: user key, number and operation."""
    return F.format_string("%s @%d %s", k.cast("string"), seq.cast("long"), F.when(op == 0, "put").otherwise("delete"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the common start of two texts or byte strings, in bytes; 0 where one is null."""
    a, b = a.cast("binary"), b.cast("binary")
    n = F.when(a.isNotNull() & b.isNotNull(), F.least(F.octet_length(a), F.octet_length(b)))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when((n > 0) & n.isNotNull(), F.coalesce(F.element_at(F.when(F.size(differs) > 0, differs), 1) - 1, n)).otherwise(0)
