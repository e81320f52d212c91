r"""Substring dedup: drop words covered by a window of words that starts earlier elsewhere.

Words are ``[^\x20\x09-\x0D]+``. A window is ``WINDOW`` consecutive words of a document. Its
minimiser is the least hash among its runs of ``MINIMISER`` words, so windows with the same
words have the same minimiser. Consecutive windows that share a minimiser form a
super-k-mer, which travels as one packed string to the bucket of its minimiser: some 9
windows for the words of 28, instead of 20 words for each. A batch of strings for a bucket
is compressed into one value.

A task first folds equal super-k-mers of its own: the first stays, and all windows of the
later ones are repeats already, since each starts later than its twin. So a passage that
a third of all documents share is one string a task in its bucket. In a bucket the windows
of all strings are sorted by a hash of their words, equal hashes are compared word by
word, and each window that isn't the first in (document, start) order is a repeat.

Repeats come back as intervals (document, first start, number of starts), which are
merged for each document and cut from the words of its text.

Runs of words that are very common, in many different contexts, would be the minimisers of
very many windows. The super-k-mers of all texts are counted by their runs first, in an
array of fixed size, and common runs come last in the order of minimisers, the commonest
at the very end: windows that hold one go to the buckets of the runs beside it.

Buckets hold ``BUCKET_CHARS`` of text or more, ``FULL_BUCKET_CHARS`` at most; their number
follows the input.

Defined results: null and empty text have no words; a document with fewer than ``WINDOW``
words keeps all. Documents are in the order of doc_id, null first; rows that share a
doc_id are told apart by an arbitrary but fixed number. Texts of any length are cut into
words whole, and words that stay are joined by single spaces. Other columns, whatever their names, are kept
by ``drop_repeats`` and not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, boxed, releasing, releasing_group, shuffle_width, staged, table
from tidelog.llm.words import ARRAYS, SEGMENT, Words, added_up, chunks, compressed, expanded, run_hashes, segments, total

WINDOW, MINIMISER = 20, 4
#: Text that a bucket stands for, at least and at most, and words that a task packs at a time.
BUCKET_CHARS, FULL_BUCKET_CHARS, PACK_WORDS = 4_000_000, 32_000_000, 2_000_000
#: Cells in which runs of words are counted; the part of a bucket from which on a run is common.
CELLS, SHARE = 1 << 20, 16


def words_of(text: str | None) -> list[bytes]:
    """The text's words: of bytes, ``split`` cuts at these six characters and no others."""
    return text.encode().split() if isinstance(text, str) else []


def order_of(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The order in which runs of words with these hashes are minimisers: common ones last."""
    hashes = hashes >> np.uint64(6)
    return (levels[(hashes & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | hashes


def super_kmers(hashes: np.ndarray, ends: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hashes: of the words of documents laid end to end; ends: where each ends; levels: as of ``common_runs``. Each super-k-mer's first window, number of windows, minimiser."""
    if len(hashes) < WINDOW:
        return (np.empty(0, np.int64),) * 3
    least, width, want = order_of(run_hashes(hashes, MINIMISER), levels), 1, WINDOW - MINIMISER + 1
    while width < want:  # the least of two overlapping spans
        step = min(width, want - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    # A window is one document's if no document ends within it.
    inside = np.ones(len(least), bool)
    for end in ends[:-1]:
        inside[max(0, end - WINDOW + 1) : end] = False
    at = np.flatnonzero(inside)
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]])
    first = np.flatnonzero(fresh)
    return at[first], np.diff(np.append(first, len(at))), least[at[first]]


def common_runs(rows: DataFrame, buckets: int) -> np.ndarray:
    """Of cells of hashes of runs, a level: 0, or by how many powers of two the super-k-mers of the cell's runs exceed the ``SHARE``-th part of a bucket.

    Counted over all texts in an array of fixed size. A run that very many windows would
    have as their minimiser would fill one bucket; with its level it comes after others in
    the order, so that its windows go to the buckets of the runs beside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, flat = np.zeros(CELLS, np.uint32), np.zeros(CELLS, np.uint8)
        for batch in batches:
            for texts in chunks(batch.column(0)):
                words = Words(texts)
                _, _, minimiser = super_kmers(words.hashes(), np.cumsum(words.counts), flat)
                if len(minimiser):
                    own += np.bincount((minimiser & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype(np.uint32)
        yield from segments(own, lambda part: part.astype("<u8"))

    counts = np.zeros(CELLS, np.uint64)
    for k, part in added_up(rows.select("text").mapInArrow(releasing(run), ARRAYS), "<u8", total):
        counts[k * SEGMENT : (k + 1) * SEGMENT] = part
    fair = max(1, int(counts.sum()) // buckets // SHARE)
    return np.where(counts > fair, np.minimum(63, 1 + np.floor(np.log2(np.maximum(counts, 1) / fair))), 0).astype(np.uint8)


def pack(strings: list[bytes], lengths: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> bytes:
    """Strings with their numbers of words, and the document and first start of each."""
    head = np.array([len(strings)], "<i8"), lengths.astype("<i4"), np.diff(rows, prepend=0).astype("<i8"), starts.astype("<i8")
    return compressed(b"".join(x.tobytes() for x in head) + b" ".join(strings), level=3)


def unpack(blob: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """As ``pack`` takes them, but for the strings, which are one."""
    raw = expanded(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    lengths = np.frombuffer(raw, "<i4", n, 8)
    rows = np.cumsum(np.frombuffer(raw, "<i8", n, 8 + 4 * n))
    return raw[8 + 20 * n :], lengths, rows, np.frombuffer(raw, "<i8", n, 8 + 12 * n)


class Packer:
    """A map task: documents' words in, packed super-k-mers by bucket out, with the task's own repeats in buckets under 0."""

    def __init__(self, buckets: int, levels: np.ndarray):
        self.buckets, self.levels = buckets, levels
        self.clear()

    def clear(self) -> None:
        self.kept, self.seen, self.repeats, self.words = {}, {}, [], 0

    def add(self, rows: np.ndarray, texts: pa.Array) -> None:
        own = Words(texts)
        ends = np.cumsum(own.counts)
        first, count, minimiser = super_kmers(own.hashes(), ends, self.levels)
        if not len(first):
            return
        document = np.searchsorted(ends, first, side="right")
        start = first - (ends - own.counts)[document]
        raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own.words)], pa.int32()), own.words), " ")[0].as_buffer().to_pybytes()
        stop = np.cumsum(pc.binary_length(own.words).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        begin = np.append(0, stop[:-1])[first]
        end = stop[first + count + WINDOW - 2] - 1
        for a, b, r, at, n, bucket in zip(begin.tolist(), end.tolist(), rows[document].tolist(), start.tolist(), count.tolist(), (minimiser % np.uint64(self.buckets)).tolist(), strict=True):
            string = raw[a:b]
            place = self.seen.get(string)
            if place is None:
                self.seen[string] = place = [r, at]
                self.kept.setdefault(bucket, []).append((string, n + WINDOW - 1, place))
                self.words += n + WINDOW - 1
            elif (r, at) < (place[0], place[1]):  # the earlier of the two stands for both
                self.repeats.append((*place, n))
                place[:] = r, at
            else:
                self.repeats.append((r, at, n))

    def flush(self) -> pa.RecordBatch:
        out: list[tuple[int, bytes]] = []
        for bucket, strings in self.kept.items():
            places = np.array([p for _, _, p in strings], np.int64)
            out.append((bucket, pack([s for s, _, _ in strings], np.array([n for _, n, _ in strings]), places[:, 0], places[:, 1])))
        if self.repeats:
            out.append((-1 - self.repeats[0][0] % 1_000_003, compressed(np.array(self.repeats, "<i8").tobytes())))
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], names=["bucket", "blob"])


def packer(buckets: int, levels):
    """levels: a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Packer(buckets, levels.value)
        for batch in batches:
            rows, at = batch.column(0).to_numpy(zero_copy_only=False), 0
            for texts in chunks(batch.column(1)):
                task.add(rows[at : at + len(texts)], texts)
                at += len(texts)
                if task.words >= PACK_WORDS:
                    yield task.flush()
        if task.kept:
            yield task.flush()

    return run


def repeats_in_bucket(flat: np.ndarray, lengths: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (document, start) of the windows that aren't the first of their words. flat: word numbers of the strings, end to end."""
    ends, windows = np.cumsum(lengths), lengths - WINDOW + 1
    # at: where each window begins in flat
    string = np.repeat(np.arange(len(lengths), dtype=np.int32), windows)
    step = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = (ends - lengths)[string] + step
    key = run_hashes(flat.astype(np.uint64), WINDOW)[at]
    order = np.argsort(key)
    ranked = key[order]
    twin = np.zeros(len(key), bool)
    twin[1:] = ranked[1:] == ranked[:-1]
    twin[:-1] |= twin[1:]
    some = order[twin]  # only windows whose hash occurs again go on
    if not len(some):
        return np.empty((0, 2), np.int64)
    row, start, key, at = rows[string[some]], starts[string[some]] + step[some], key[some], at[some]
    # Equal hashes stand for equal words once compared word by word; windows of other words with the same hash sort apart.
    words = np.column_stack([flat[at + i] for i in range(WINDOW)])
    fresh = np.ones(len(some), bool)
    order = np.lexsort((start, row, key))
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    differs = ~fresh[1:] & (words[order[1:]] != words[order[:-1]]).any(axis=1)
    if differs.any():
        order = np.lexsort((start, row, *words.T[::-1], key))
        fresh[1:] = (key[order[1:]] != key[order[:-1]]) | (words[order[1:]] != words[order[:-1]]).any(axis=1)
    picked = order[~fresh]
    return np.column_stack([row[picked], start[picked]])


def intervals(found: np.ndarray) -> np.ndarray:
    """(document, start) rows as (document, first start, number of starts)."""
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1] + 1)
    first = np.flatnonzero(fresh)
    return np.column_stack([found[first], np.diff(np.append(first, len(found)))])


def open_bucket(group: pa.Table) -> pa.Table:
    """What a bucket's packed strings, or tasks' own repeats, come to."""
    blobs = group.column("blob").to_pylist()
    if group.column("bucket")[0].as_py() < 0:
        found = np.concatenate([np.frombuffer(expanded(b), "<i8").reshape(-1, 3) for b in blobs])
    else:
        strings, *parts = zip(*(unpack(b) for b in blobs), strict=True)
        lengths, rows, starts = (np.concatenate(x) for x in parts)
        # Equal words have equal numbers in the whole bucket.
        words = pa.concat_arrays([pc.ascii_split_whitespace(pa.array([s.decode()])).flatten() for s in strings]).dictionary_encode()
        found = intervals(repeats_in_bucket(words.indices.to_numpy(zero_copy_only=False), lengths, rows, starts))
    return pa.table({"row": found[:, 0], "start": found[:, 1], "n": found[:, 2]})


def numbered(df: DataFrame, id_col: str, without: tuple[str, ...] = (), scratch: Scratch | None = None, **columns: Column) -> DataFrame:
    """``df`` in a box, as of ``boxed``, with ``at``: doc_id itself where it names each row, else the rank in its order."""
    ids = df.select(F.col(id_col).cast("long").alias("id"))
    rows, known, distinct = ids.agg(F.count("*"), F.count("id"), F.countDistinct("id")).first()
    if rows == known == distinct:
        return boxed(df, without, at=F.col(id_col).cast("long"), **columns)
    # Global positions without a single task: offsets of range partitions, kept in the shared folder.
    first = Scratch()
    fixed = staged(boxed(df, without, **columns, id_=F.col(id_col).cast("long"), tie=F.monotonically_increasing_id()), first)
    order = [F.col("id_").asc_nulls_first(), F.col("tie")]
    ordered = staged(fixed.repartitionByRange(shuffle_width(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()).drop("id_", "tie"), scratch)
    first.drop()
    return ordered


def repeat_intervals(rows: DataFrame) -> DataFrame:
    """rows: row (long, unique, in corpus order) and text. Returns row, start, n."""
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    # Buckets follow the width of shuffles, so that a task's strings are not too few for each.
    buckets = max(1, -(-chars // FULL_BUCKET_CHARS), min(chars // BUCKET_CHARS, 4 * shuffle_width(rows.sparkSession)))
    levels = rows.sparkSession.sparkContext.broadcast(common_runs(rows, buckets))
    packed = rows.mapInArrow(releasing(packer(buckets, levels)), "bucket long, blob binary")
    return packed.groupBy("bucket").applyInArrow(releasing_group(open_bucket), "row long, start long, n long")


def cut(words: list[bytes], spans: list[tuple[int, int]] | None) -> list[bytes]:
    """The words that no window of the spans (first start, number of starts) covers."""
    kept, at = [], 0
    for start, n in sorted(spans or ()):
        if start > at:
            kept += words[at:start]
        at = max(at, start + n + WINDOW - 1)
    return kept + words[at:]


def with_kept(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with repeats cut from its text, and n_words and n_removed in place of columns so named."""
    rows = numbered(df, id_col, (text_col,), text=F.col(text_col).cast("string"))
    spans = repeat_intervals(rows.select(F.col("at").alias("row"), "text"))
    # A document's spans are at most one for each of its words, like its text.
    spans = spans.groupBy(F.col("row").alias("at")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: compressed(t.encode() if isinstance(t, str) else b""))

    @F.pandas_udf("n_words long, n_removed long, text string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, found in zip(texts, spans, strict=True):
            words = expanded(text).split()
            left = words if found is None else cut(words, [(x["start"], x["n"]) for x in found])
            out.append((len(words), len(words) - len(left), b" ".join(left).decode()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "text"])

    # Texts meet their spans compressed.
    joined = rows.withColumn("text", squeeze("text")).join(spans, "at", "left").withColumn("kept", kept("text", "spans"))
    columns = [F.col("kept.text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in ("n_words", "n_removed")]
    return joined.select(*columns, "kept.n_words", "kept.n_removed")


def drop_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``df`` with repeats cut from its text."""
    kept = with_kept(boxed(df, (text_col,), text=F.col(text_col), id=F.col(id_col)), id_col="id")
    return kept.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = with_kept(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with w as (select doc_id, case when trim(coalesce(text, ''), e' \t\n\x0b\x0c\r') = '' then [] else regexp_split_to_array(trim(text, e' \t\n\x0b\x0c\r'), '[ \t\n\x0b\x0c\r]+') end as l from documents),
s as (select doc_id, unnest(range(1, greatest(len(l) - 18, 1))) as i, l from w where len(l) >= 20),
k as (select doc_id, i, sha256(array_to_string(l[i:i + 19], ' ')) as h from s),
r as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) as n from k) where n > 1),
c as (select distinct doc_id, i + j as p from r, (select unnest(range(0, 20)) as j)),
g as (select doc_id, list(p) as ps from c group by doc_id),
o as (select w.doc_id, len(l) as n_words, len(coalesce(ps, [])) as n_removed, [l[x] for x in range(1, len(l) + 1) if ps is null or not list_contains(ps, x)] as kept from w left join g using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) as kept_sha256 from o
"""
