"""Byte-level BPE: encode texts to token ids and back, from a public vocabulary file.

Each piece that the split pattern yields becomes a doubly linked list of byte symbols. A
heap holds the mergeable neighbours by merge rank, then by position; an entry whose
symbols have changed since it was pushed is stale and skipped. Decoding concatenates the
vocabulary's strings.

Ids travel as binary, little-endian unsigned 32-bit integers. Pieces repeat, so their ids
are kept in a cache of bounded size. Work is row by row without a shuffle: a very long
text takes O(n log n) even where it is a single piece.

Defined results: null encodes as the empty text, that is to no ids; null or empty ids
decode to the empty text. The special token's string in a text is that token. Repeated
rows give equal rows; other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

import array
import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import boxed, release, table, unboxed

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: Pieces in a generation of a worker's cache, of which there are two, and the longest piece kept.
CACHED, CACHED_LENGTH = 150_000, 48
#: Rows that a worker holds at a time.
SOME = 256


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte, as byte-level vocabularies spell it."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


#: A pair of symbols is one number, left << ID_BITS | right; a heap entry is rank << AT_BITS | position.
ID_BITS, AT_BITS = 20, 40


def merged(symbols: list[int], ranks: dict[int, int], results: list[int]) -> list[int]:
    """``symbols`` after all merges. ranks: the rank of each pair; results: the symbol that each rank makes."""
    n = len(symbols)
    if n < 2:
        return symbols
    rank_of, place = ranks.get, (1 << AT_BITS) - 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [rank << AT_BITS | i for i in range(n - 1) if (rank := rank_of(symbols[i] << ID_BITS | symbols[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        entry = heapq.heappop(heap)
        at, rank = entry & place, entry >> AT_BITS
        right = after[at]
        if right == n or rank_of(symbols[at] << ID_BITS | symbols[right]) != rank:
            continue  # stale: one side was merged away or changed
        symbols[at] = made = results[rank]
        symbols[right] = -1  # no pair with -1 has a rank
        after[at] = far = after[right]
        if far < n:
            before[far] = at
            if (rank := rank_of(made << ID_BITS | symbols[far])) is not None:
                heapq.heappush(heap, rank << AT_BITS | at)
        if (near := before[at]) >= 0 and (rank := rank_of(symbols[near] << ID_BITS | made)) is not None:
            heapq.heappush(heap, rank << AT_BITS | near)
    return [s for s in symbols if s >= 0]


class Pieces(dict):
    """A piece of text to its ids as bytes, filled on demand. When full it becomes the old generation, whose pieces come back as they are asked for."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = array.array("I", merged([*map(self.codec.byte_ids.__getitem__, piece.encode())], self.codec.ranks, self.codec.results)).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.old = {}
        self.clear()


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, vocabulary = byte_alphabet(), spec["model"]["vocab"]
        self.byte_ids = [0] * 256
        for char, byte in alphabet.items():
            self.byte_ids[byte] = vocabulary[char]
        self.ranks: dict[int, int] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.ranks.setdefault(vocabulary[a] << ID_BITS | vocabulary[b], rank)
        self.results = [vocabulary[a + b] for a, b in spec["model"]["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocabulary.values(), *special.values()]))
        for token, i in vocabulary.items():
            self.strings[i] = bytes(alphabet[c] for c in token)
        for token, i in special.items():
            self.strings[i] = token.encode()
        self.special = {token: np.array([i], "<u4").tobytes() for token, i in special.items()}
        self.split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces = Pieces(self)

    def rest(self) -> None:
        """At a task's end: the worker may serve others next."""
        self.pieces.forget()
        release()

    def encode(self, text: str) -> bytes:
        if self.split and any(t in text for t in self.special):
            return b"".join(self.special[part] if part in self.special else self.ordinary(part) for part in self.split.split(text))
        return self.ordinary(text)

    def ordinary(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode(errors="replace")


@functools.lru_cache(maxsize=2)
def codec_of(path: str) -> Codec:
    """One codec for each Python worker."""
    return Codec(path)


def encoded(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """The ids of a text column, as binary."""

    @F.pandas_udf("binary")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(vocabulary)
        for texts in parts:
            yield pd.Series([codec.encode(t) if isinstance(t, str) else b"" for t in texts], dtype=object)
        codec.rest()

    return encode(text.cast("string"))


def decoded(ids: Column, vocabulary: str = VOCABULARY) -> Column:
    """The text of a column of ids."""

    @F.pandas_udf("string")
    def decode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = codec_of(vocabulary)
        for rows in parts:
            yield pd.Series([codec.decode(x) if x else "" for x in rows], dtype=object)

    return decode(ids)


def encode_documents(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``df`` with ``n_tokens`` and ``ids``, in place of columns so named."""
    whole = df.drop("ids", "n_tokens").withColumn("ids", encoded(F.col(text_col), vocabulary))
    return whole.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def round_trip(df: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, ids: bool = False) -> DataFrame:
    """The row's other columns with n_tokens, the SHA-256 of its ids and of what they decode to, and the ids if asked for.

    One worker encodes and decodes, some rows at a time, so decoded texts needn't travel.
    """
    added = T.StructType().add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if ids:
        added = added.add("ids", "binary")
    rows = boxed(df, (text_col,), text=F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, SOME):
                part = batch.slice(at, SOME)
                found = [codec.encode(t) if isinstance(t, str) else b"" for t in part.column(1).to_pylist()]
                own = [
                    pa.array([len(x) // 4 for x in found], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()),
                    pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in found], pa.string()),
                    *([pa.array(found, pa.binary())] if ids else []),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), *own], names=["row", *names])
        codec.rest()

    names = added.names
    return unboxed(rows.mapInArrow(run, T.StructType([rows.schema["row"], *added.fields])), *names, without=tuple(names))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
