r"""Words of whole texts by Arrow's kernels, hashes of words and of runs of words, and arrays that tasks add up.

Words are ``[^\x20\x09-\x0D]+``: Arrow's split on ASCII whitespace cuts at these six
characters and no others. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

#: Bytes of text cut into words at a time; a longer text is cut alone.
CHUNK_BYTES = 2 << 20
#: How many tasks' arrays are added up together first, and cells of a segment of an array.
LANES, SEGMENT = 64, 1 << 16


def compressed(raw: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expanded(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words: runs of powers of two, joined as the binary digits of the length ask."""
    n = max(0, len(words) - length + 1)
    out, covered, power, size = np.zeros(n, np.uint64), 0, mixed(words), 1
    while covered < length:
        if length & size:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + power[covered : covered + n])
            covered += size
        power, size = mixed(power[: max(0, len(power) - size)] * np.uint64(0xD6E8FEB86659FD93) + power[size:]), 2 * size
    return out


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in order, some at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + CHUNK_BYTES, side="right")))
        yield texts.slice(at, end - at)
        at = end


class Words:
    """The words of some texts, end to end: numbers of words by text, the words, and each one's place in ``distinct``."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pc.fill_null(texts, "")
        split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        every, edges = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        full = pc.binary_length(every).to_numpy(zero_copy_only=False) > 0
        # White space at the ends of a text leaves empty words.
        upto = np.append(0, np.cumsum(full))
        edges = upto[edges - edges[0]]
        self.counts = np.diff(edges)
        self.words = every if full.all() else every.filter(pa.array(full))
        coded = self.words.dictionary_encode()
        self.codes, self.distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary

    def hashes(self) -> np.ndarray:
        """The 64-bit hash of each word, the same in all tasks."""
        own = np.fromiter(map(xxhash.xxh3_64_intdigest, self.distinct.to_pylist()), np.uint64, len(self.distinct))
        return own[self.codes]


def values(column: pa.Array | pa.ChunkedArray, some: int = 64) -> Iterator:
    """The column's values, a few at a time in Python's memory."""
    for at in range(0, len(column), some):
        yield from column.slice(at, some).to_pylist()


ARRAYS = "segment int, lane int, array binary"


def segments(whole: np.ndarray, put: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's array, as rows of ``ARRAYS``; segments of zeros have none."""
    lane = TaskContext.get().partitionId() % LANES
    for k in range(len(whole) // SEGMENT):
        part = whole[k * SEGMENT : (k + 1) * SEGMENT]
        if part.any():
            yield pa.RecordBatch.from_pydict({"segment": pa.array([k], pa.int32()), "lane": pa.array([lane], pa.int32()), "array": [compressed(put(part).tobytes())]})


def added_up(parts: DataFrame, dtype: str, merge: Callable[[list[np.ndarray]], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """parts: rows of ``ARRAYS``. Segments with their arrays merged, those of some tasks first and then the rest."""

    def run(group: pa.Table) -> pa.Table:
        whole = merge([np.frombuffer(expanded(b), dtype) for b in values(group.column("array"))])
        return pa.table({"segment": group.column("segment").slice(0, 1), "lane": group.column("lane").slice(0, 1), "array": [compressed(whole.astype(dtype).tobytes())]})

    first = parts.groupBy("segment", "lane").applyInArrow(run, ARRAYS)
    for row in first.groupBy("segment").applyInArrow(run, ARRAYS).toLocalIterator():
        yield row.segment, np.frombuffer(expanded(row.array), dtype)


def total(arrays: list[np.ndarray]) -> np.ndarray:
    return np.sum(arrays, axis=0)
