r"""Exact n-gram Jaccard join by set relations: documents, their shingle sets, their components.

A document's set holds the 64-bit hashes of its distinct word shingles, after A-Z are
lower-cased. Documents with equal sets are one class; classes link when their sets'
Jaccard similarity is at least ``percent`` hundredths; the result is each document's
component under these links. No threshold below is a heuristic: every step is either exact
or only decides the order of work.

1. *Lists worth keeping.* Prefixes of all sets, in hash order, make index lists. Linked
   sets share much of their prefixes, so a set whose tokens mostly stand alone on their
   lists has no answers; nothing but the counts of its shared tokens is kept of its lists.
   Then the same with whole sets, for those that are left.
2. *Index lists.* The tokens of each remaining set's prefix, rarest first by a counting
   sketch, are entries of lists, with the set's size and how many tokens can follow the
   entry's position. Linked sets meet on some list.
3. *A highly similar set.* Each list names one set, the same for most lists of similar
   sets; the set named most often by a set's lists is its most similar one, and the two
   are compared. Sets that link are one component. Others stay with the set that they
   chose: both make groups of similar sets, cut in blocks of bounded size.
4. *Skipping.* Lists now hold blocks: sizes, and the most that can follow their positions.
   They are sorted by size and walked block by block; what sizes or positions rule out is
   skipped whole, and so are blocks that one component covers.
5. *Answers from answers.* Where two blocks meet, a set's answers (how much it shares with
   each set of the other block) follow from the answers of the most similar set before it.
   The tokens in which the two differ bound every answer at once; if a bound decides, that
   is all; else only the lists of these tokens are read, added and taken off. A set with no
   similar one before it is counted from its whole index lists.
6. Components of the links of 3 and 5, by large-star and small-star rounds.

Lists of many blocks are cut into slices that meet in pairs, a task each. A task holds one
block, some answers and a bounded part of a list. Copies are folded into their class before
anything meets. Intermediate tables are deleted once they have been read.

Defined results: null, empty and blank texts have the empty set, link with nothing and are
their own component. Texts with fewer words than a shingle have one token, the whole
sequence. A null id counts as greater than any other; a component of null ids only has a
null id. Rows that share an id are separate documents. Extra columns, whatever their
names, are kept by ``keep_one`` and not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import Scratch, broadcast_up_to, releasing, releasing_group, shuffle_width, staged, table, unboxed
from tidelog.llm.components import components
from tidelog.llm.substring_dedup import numbered
from tidelog.llm.words import ARRAYS, SEGMENT, Words, added_up, chunks, compressed, expanded, mixed, run_hashes, segments, total, values

#: Share, in hundredths, of a set's tokens that its prefix must have in common with others:
#: first of short prefixes of all sets, then of long ones of the sets that are left.
COMMON, MORE_COMMON = 10, 80
#: Postings that a task holds before it sends them; postings of a bucket, at least and at most.
HELD, BUCKET, FULL_BUCKET = 1_000_000, 800_000, 16_000_000
#: Cells of the counting sketch, and slots of the filter of sets that can link.
SKETCH, FILTER = 1 << 22, 1 << 26
#: Sets of a block and their tokens; sets that meet it in a task; rows broadcast at most.
MEMBERS, MEMBER_TOKENS, PARTNERS, NARROW = 128, 1_000_000, 128, 200_000
#: Blocks on a list that a task walks; entries walked at a time, and rows read ahead.
SLICE, STRIDE, AHEAD = 2048, 64, 100_000
#: Ids of dropped rows that are broadcast at most, 8 bytes each.
DROPPED = 1_000_000
#: Answers kept to derive others from, and tokens by which the most similar is chosen.
KEPT, SAMPLE = 8, 32

CLASS = 16  # bytes of a class's key
SHORT = 6  # bytes of a token in step 1, where a clash costs work and no answer


class Rule:
    """Similarity of at least ``percent`` hundredths between sets of ``words``-word shingles."""

    def __init__(self, words: int, percent: int):
        self.words, self.percent = words, percent

    def least_overlap(self, n):
        """Tokens that a set of ``n`` shares with any set that it links to."""
        return -(-self.percent * n // 100)

    def overlap(self, n, m):
        """Tokens that linked sets of ``n`` and ``m`` have in common at least."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def spare(self, n):
        return n - self.least_overlap(n)

    def asked(self, n, common):
        """Common tokens asked of a prefix of a set of ``n`` or more."""
        return np.maximum(1, -(-common * n // 100))

    def prefix(self, n: int, common: int) -> int:
        return self.spare(n) + int(self.asked(n, common))


def sets_in(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sets of texts: sorted arrays of distinct 64-bit tokens."""
    for some in chunks(texts):
        own = Words(some, lower=True)
        hashes, at = own.hashes(), 0
        runs = run_hashes(hashes, words)
        for n in own.counts.tolist():
            if n >= words:
                yield np.unique(runs[at : at + n - words + 1])
            else:
                yield run_hashes(hashes[at : at + n], n) if n else np.empty(0, np.uint64)
            at += n


def class_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=CLASS).digest()


def short(tokens: np.ndarray) -> bytes:
    """The high bits of tokens; order is kept."""
    return (tokens >> np.uint64(64 - 8 * SHORT)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()


def unshort(raw: bytes | np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(raw, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").ravel()


def described(rows: DataFrame, rule: Rule) -> DataFrame:
    """rows: at, doc_id, text. Returns at, doc_id, n, and cls and prefix (short tokens), null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(len(s), class_of(s), short(s[: rule.prefix(len(s), COMMON)])) if len(s) else (0, None, None) for s in sets_in(batch.column(2), rule.words)]
            own = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], names=["at", "doc_id", "n", "cls", "prefix"])

    return rows.select("at", "doc_id", "text").mapInArrow(releasing(run), "at long, doc_id long, n long, cls binary, prefix binary")


# Step 1.


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths, compressed."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    return compressed(len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = expanded(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in (x.split(",") for x in raw[4:at].decode().split(";")):
        out.append(np.frombuffer(raw, kind, int(n), at))
        at += out[-1].nbytes
    return out


class Postings:
    """A task's prefix tokens, by set, until they are sent. Sets are numbered in a batch, and named once, in its own row."""

    def __init__(self, buckets: int, batch: int):
        self.buckets, self.batch = buckets, batch
        self.clear()

    def clear(self) -> None:
        self.tokens, self.ids, self.sizes, self.held = [], [], [], 0

    def add(self, id_: int, n: int, prefix: np.ndarray) -> None:
        self.tokens.append(prefix)
        self.ids.append(id_)
        self.sizes.append(n)
        self.held += len(prefix)

    def flush(self) -> pa.RecordBatch:
        """Tokens that meet here count at once and go on as one posting for others to see; the rest go by bucket."""
        tokens, owner = np.concatenate(self.tokens), np.repeat(np.arange(len(self.ids), dtype="<u4"), [len(t) for t in self.tokens])
        order = np.argsort(tokens)
        tokens, owner = tokens[order], owner[order]
        first = np.append(True, tokens[1:] != tokens[:-1])
        count = np.diff(np.append(np.flatnonzero(first), len(tokens)))
        own = np.bincount(owner[np.repeat(count > 1, count)], minlength=len(self.ids))
        rows = [(-1 - self.batch, _pack(np.array(self.ids, "<i8"), np.array(self.sizes, "<u4"), own.astype("<u4")))]
        tokens, owner, met = tokens[first], owner[first], count > 1
        bucket = tokens % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1, dtype=np.uint64))
        small = "<u2" if len(self.ids) <= 1 << 16 else "<u4"
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = order[edges[b] : edges[b + 1]]
            alone = part[~met[part]]
            low = 64 - 8 * SHORT  # ``short`` again, of tokens that are short already
            raw = [np.frombuffer(short(tokens[x] << np.uint64(low)), np.uint8) for x in (alone, part[met[part]])]
            rows.append((b, _pack(np.array([self.batch], "<i8"), raw[0], owner[alone].astype(small), raw[1])))
        self.clear()
        self.batch += 1
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


REPLY = "batch long, blob binary"


def _replies(rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"batch": pa.array([r[0] for r in rows], pa.int64()), "blob": pa.array([r[1] for r in rows], pa.binary())})


def _count_shared(group: pa.Table) -> pa.Table:
    """Of a bucket: to each batch, how many tokens of each of its sets occur in another set. A set is in one batch only."""
    bucket = group.column("bucket")[0].as_py()
    if bucket < 0:
        return _replies([(-1 - bucket, b) for b in values(group.column("blob"))])
    batches, alone, owner, met = zip(*(_unpack(b) for b in values(group.column("blob"))), strict=True)
    sizes = [len(o) for o in owner]
    tokens = unshort(np.concatenate([*alone, *met]))
    del alone, met
    order = np.argsort(tokens)
    ranked = tokens[order]
    first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    own = sum(sizes)
    # A token counts if some task met it several times, or it comes from several.
    count = np.diff(np.append(first, len(ranked)))
    several = (count > 1) | np.logical_or.reduceat(order >= own, first)
    shared = np.zeros(len(tokens), bool)
    shared[order] = np.repeat(several, count)
    rows, at = [], 0
    for batch, who, n in zip(batches, owner, sizes, strict=True):
        counts = np.bincount(who[shared[at : at + n]])
        some = np.flatnonzero(counts)
        if len(some):
            rows.append((int(batch[0]), _pack(some.astype(who.dtype), counts[some].astype("<u4"))))
        at += n
    return _replies(rows)


def _enough(rule: Rule, common: int):
    """Of a batch: the sets whose counts from all buckets are enough."""

    def run(group: pa.Table) -> pa.Table:
        found = [_unpack(b) for b in values(group.column("blob"))]
        ids, sizes, own = next(f for f in found if len(f) == 3)
        shared, sizes = own.astype(np.int64), sizes.astype(np.int64)
        for some, counts in (f for f in found if len(f) == 2):
            shared[some] += counts
        # The other set may be smaller, and then asks for fewer.
        return pa.table({"id": pa.array(ids[shared >= rule.asked(rule.least_overlap(sizes), common)], pa.int64())})

    return run


def able(sets: DataFrame, rule: Rule, tokens: int, common: int) -> DataFrame:
    """The sets (id) with enough prefix tokens in other sets to link to any.

    sets: a staged table, whose tasks give the same rows again if they must: id, n, and
    prefix (short tokens) or whole tokens; tokens: how many tokens the sets have.
    """
    postings = int(tokens * (100 - rule.percent + common) / 100)
    # Buckets follow the width of shuffles, so that a batch has not too little for each.
    buckets = max(1, -(-postings // FULL_BUCKET), min(postings // BUCKET, 2 * shuffle_width(sets.sparkSession)))
    whole = "tokens" in sets.columns

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Postings(buckets, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for id_, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values(batch.column(2)), strict=True):
                held.add(id_, n, np.frombuffer(raw, "<u8")[: rule.prefix(n, common)] >> np.uint64(64 - 8 * SHORT) if whole else unshort(raw))
                if held.held >= HELD:
                    yield held.flush()
        if held.held:
            yield held.flush()

    sent = sets.select("id", "n", "tokens" if whole else "prefix").mapInArrow(releasing(send), "bucket long, blob binary")
    counted = sent.groupBy("bucket").applyInArrow(releasing_group(_count_shared), REPLY)
    return counted.groupBy("batch").applyInArrow(releasing_group(_enough(rule, common)), "id long")


def filtered(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """``rows`` whose ``at`` may be among the ``n`` of ``wanted`` (id): a bitmap of bounded size, with false positives only."""
    bits = 1 << 16
    while bits < min(16 * n, FILTER):
        bits *= 2

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for batch in batches:
            own[mixed(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64(bits - 1)] = True
        yield from segments(own, np.packbits)

    whole = bytearray(bits // 8)
    for k, part in added_up(wanted.select("id").mapInArrow(build, ARRAYS), "u1", np.bitwise_or.reduce):
        whole[k * SEGMENT // 8 : (k + 1) * SEGMENT // 8] = part.tobytes()
    shared = rows.sparkSession.sparkContext.broadcast(bytes(whole))

    @F.pandas_udf("boolean")
    def maybe(ids: pd.Series) -> pd.Series:
        at = (mixed(ids.to_numpy(np.int64).astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
        return pd.Series((np.frombuffer(shared.value, np.uint8)[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0)

    return rows.where(maybe("at"))


def sets_of(rows: DataFrame, rule: Rule) -> DataFrame:
    """rows: at and text. Returns id, n and tokens, sorted little-endian 64-bit words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sets_in(batch.column(1), rule.words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, found), pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["id", "n", "tokens"])

    return rows.select("at", "text").mapInArrow(releasing(run), "id long, n long, tokens binary")


# Step 2.


def sketch_of(sets: DataFrame) -> bytes:
    """About eight times the logarithm of the counts of tokens, by their low bits, a byte each: the order of rarity, the same for all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(SKETCH, np.uint32)
        for batch in batches:
            for raw in values(batch.column(0)):
                own[(np.frombuffer(raw, "<u8") & np.uint64(SKETCH - 1)).astype(np.int64)] += 1
        yield from segments(own, lambda part: part.astype("<u8"))

    whole = np.zeros(SKETCH, np.uint8)
    for k, part in added_up(sets.select("tokens").mapInArrow(releasing(count), ARRAYS), "<u8", total):
        whole[k * SEGMENT : (k + 1) * SEGMENT] = np.round(8 * np.log2(1.0 + part))
    return whole.tobytes()


def entries_of(sets: DataFrame, sketch: bytes, rule: Rule) -> DataFrame:
    """Entries of index lists: token, id, n, and ``rest``, how many tokens the entry's and all after it are."""
    shared = sets.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            ids, parts = [], []
            for id_, raw in zip(batch.column(0).to_pylist(), values(batch.column(1)), strict=True):
                tokens = np.frombuffer(raw, "<u8")
                n = len(tokens)
                order = np.lexsort((tokens, counts[(tokens & np.uint64(SKETCH - 1)).astype(np.int64)]))[: rule.spare(n) + 1]
                ids.append(np.full(len(order), id_))
                parts.append((tokens[order].astype(np.int64), np.full(len(order), n), n - np.arange(len(order))))
            columns = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (list(p) for p in zip(*parts, strict=True))] if parts else [np.empty(0, np.int64)] * 3
            own = np.concatenate(ids) if ids else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(own), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32))], names=["token", "id", "n", "rest"])

    return sets.select("id", "tokens").mapInArrow(releasing(run), "token long, id long, n int, rest int")


# Step 3.


def chosen_by_lists(entries: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The entries of lists that several sets are on; and for each of these sets (id) its ``head``, the set that most of its lists name, which may be itself."""
    named = entries.groupBy("token").agg(F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("first"), F.count("*").alias("m"))
    # Staged, so that a plain shuffle stands on both sides and a long list can be split.
    named = staged(named.where("m > 1").select("token", F.col("first.id").alias("head")), scratch)
    shared = staged(entries.join(named, "token"), scratch)
    votes = shared.groupBy("id", "head").agg(F.count("*").alias("votes"))
    heads = votes.groupBy("id").agg(F.max_by("head", F.struct("votes", F.bitwise_not(F.xxhash64("head")))).alias("head"))
    return shared.drop("head"), staged(heads, scratch)


def with_heads(heads: DataFrame, sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links of sets with their heads. A head's many followers go in chunks."""
    pairs = heads.where("id != head")
    chunks = staged(pairs.groupBy("head").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("chunks")), scratch)
    key = F.xxhash64("head", "chunk").alias("key")
    guests = pairs.join(chunks, "head").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).select(key, F.lit(GUEST).alias("role"), F.col("head").alias("near"), "id", F.col("id").alias("comp"))
    hosts = chunks.select("head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")).select(key, F.lit(HOST).alias("role"), F.col("head").alias("near"), F.col("head").alias("id"), F.col("head").alias("comp"))
    return compared(hosts.unionByName(guests), sets, rule)


# Step 4.


def grouped(heads: DataFrame, links: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Each set (id) with its component so far, and its block: part of that component (``linked``), or else of the sets that chose the same head."""
    found = staged(components(links), scratch)
    own = heads.join(found.select(F.col("node").alias("id"), "label"), "id", "left").join(sets.select("id", "n"), "id")
    own = staged(own.select("id", "n", F.coalesce("label", "id").alias("comp"), F.col("label").isNotNull().alias("linked"), F.coalesce("label", "head").alias("grp")), scratch)
    need = F.ceil(F.greatest(F.count("*") / MEMBERS, F.sum("n") / MEMBER_TOKENS)).cast("int")
    sliced = own.groupBy("linked", "grp").agg(need.alias("slices"), F.count("*").alias("members"))
    # Written out, as block numbers must be the same for all who read them.
    blocks = staged(sliced.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).withColumn("block", F.monotonically_increasing_id()), scratch)
    placed = own.join(blocks.where("slice = 0").select("linked", "grp", "slices"), ["linked", "grp"]).withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    return staged(placed.join(blocks.select("linked", "grp", "slice", "block"), ["linked", "grp", "slice"]).select("id", "comp", "linked", "grp", "block"), scratch)


LISTED = ["token", "left", "right", "slice", "block", "linked", "grp", "low", "high", "rest", "weight"]


def meeting(entries: DataFrame, members: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of blocks that share a list and whose sizes and positions allow a link; a block also with itself."""
    listed = entries.join(broadcast_up_to(members.select("id", "block", "linked", "grp"), NARROW), "id")
    # A block is one entry of a list, however many of its sets are on it.
    listed = staged(listed.groupBy("token", "block").agg(F.first("linked").alias("linked"), F.first("grp").alias("grp"), F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("rest"), F.count("*").cast("int").alias("weight")), scratch)
    long = staged(listed.groupBy("token").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")).where("slices > 1"), scratch)
    cut = listed.join(broadcast_up_to(long, NARROW), "token", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    cut = cut.withColumn("slice", F.pmod(F.xxhash64("block"), F.col("slices")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    dealt = cut.withColumn("left", F.least("slice", "other")).withColumn("right", F.greatest("slice", "other")).select(*LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= AHEAD:
                whole = pa.concat_tables(held).combine_chunks()
                end = last_list(whole)
                if end:
                    yield from walked(whole.slice(0, end), rule)
                held, rows = [whole.slice(end)], whole.num_rows - end
        if rows:
            yield from walked(pa.concat_tables(held).combine_chunks(), rule)

    ordered = dealt.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right")
    return ordered.mapInArrow(releasing(run), "a long, b long").distinct()


def last_list(rows: pa.Table) -> int:
    """Where the last list, which may go on, begins."""
    keys = [rows.column(c).to_numpy() for c in ("token", "left", "right")]
    differs = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    at = np.flatnonzero(differs)
    return int(at[-1]) + 1 if len(at) else 0


def walked(rows: pa.Table, rule: Rule) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks of whole lists."""
    get = {c: rows.column(c).to_numpy(zero_copy_only=False) for c in LISTED}
    order = np.lexsort((get["high"], get["right"], get["left"], get["token"]))
    get = {c: v[order] for c, v in get.items()}
    low, high, rest, block, weight = (get[c].astype(np.int64) for c in ("low", "high", "rest", "block", "weight"))
    linked, group, piece = get["linked"].astype(bool), get["grp"], get["slice"]
    parted = get["left"] != get["right"]
    change = np.logical_or.reduce([get[c][1:] != get[c][:-1] for c in ("token", "left", "right")])
    first = np.flatnonzero(np.append(True, change))
    ends = np.append(first[1:], len(low))
    found: list[np.ndarray] = []
    held = 0

    def add(i: np.ndarray, j: np.ndarray) -> None:
        need = rule.overlap(low[i], low[j])
        fits = (np.minimum(rest[i], rest[j]) >= need) & (high[j] >= rule.least_overlap(low[i])) & (high[i] >= rule.least_overlap(low[j]))
        # Blocks of one component have nothing to tell each other; a list cut in slices meets slice by slice.
        fits &= ~(linked[i] & linked[j] & (group[i] == group[j])) & ~(parted[i] & (piece[i] == piece[j]))
        if fits.any():
            a, b = block[i[fits]], block[j[fits]]
            found.append(np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0))

    def given() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    # A block whose sets are of several components meets itself, once.
    own = np.flatnonzero((weight > 1) & ~linked & ~parted & (rest >= rule.overlap(low, low)))
    if len(own):
        found.append(np.unique(np.column_stack([block[own], block[own]]), axis=0))
    lengths = ends - first
    place = np.arange(len(low)) - np.repeat(first, lengths)
    size = np.repeat(lengths, lengths)
    # Short lists all at once, by the distance of two entries.
    for gap in range(1, STRIDE):
        i = np.flatnonzero((size <= STRIDE) & (place + gap < size))
        if not len(i):
            break
        add(i, i + gap)
    yield given()
    # Long ones by strides; entries lie by greatest size, and a stride meets itself and those before it.
    for a, b in zip(first[lengths > STRIDE].tolist(), ends[lengths > STRIDE].tolist(), strict=True):
        starts = np.arange(a, b, STRIDE)
        stops = np.minimum(starts + STRIDE, b)
        least, most = np.minimum.reduceat(low[a:b], starts - a), np.maximum.reduceat(high[a:b], starts - a)
        reach = np.maximum.reduceat(rest[a:b], starts - a)
        for k, (at, to) in enumerate(zip(starts.tolist(), stops.tolist(), strict=True)):
            open_ = (most[: k + 1] >= rule.least_overlap(least[k])) & (np.minimum(reach[k], reach[: k + 1]) >= rule.overlap(least[k], least[: k + 1]))
            for o in np.flatnonzero(open_).tolist():
                i, j = np.meshgrid(np.arange(at, to), np.arange(starts[o], stops[o]), indexing="ij")
                keep = j < i if o == k else np.ones(i.shape, bool)
                add(i[keep], j[keep])
                held += STRIDE
            if held >= 4096:
                yield given()
                held = 0
    yield given()


def between_blocks(pairs: DataFrame, members: DataFrame, sets: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links between the sets of blocks (a, b): the smaller one's sets are guests of the larger one, many blocks' at once."""
    sizes = staged(members.groupBy("block").agg(F.count("*").alias("members")), scratch)
    met = pairs.join(sizes.select(F.col("block").alias("a"), F.col("members").alias("m_a")), "a").join(sizes.select(F.col("block").alias("b"), F.col("members").alias("m_b")), "b")
    swap = F.col("m_a") > F.col("m_b")
    met = staged(met.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("small"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("big"), F.least("m_a", "m_b").alias("guests")), scratch)
    hosts = staged(met.groupBy("big").agg(F.ceil(F.sum(F.when(F.col("small") != F.col("big"), F.col("guests")).otherwise(0)) / PARTNERS).cast("int").alias("chunks")).withColumn("chunks", F.greatest("chunks", F.lit(1))), scratch)
    own = members.select("id", "comp", "block", F.col("grp").alias("near"))
    key = F.xxhash64("big", "chunk").alias("key")
    # Dealt by set, as blocks may be few and of unlike sizes.
    guests = met.where("small != big").join(hosts, "big").join(own, F.col("small") == F.col("block"))
    guests = guests.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).select(key, F.lit(GUEST).alias("role"), "near", "id", "comp")
    # A block that meets itself does so in its first chunk.
    selves = met.where("small = big").select(F.col("big").alias("self"))
    there = hosts.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).join(selves, F.col("big") == F.col("self"), "left")
    there = there.select(key, F.when((F.col("chunk") == 0) & F.col("self").isNotNull(), BOTH).otherwise(HOST).alias("role"), F.col("big").alias("block")).join(own, "block").select("key", "role", "near", "id", "comp")
    return compared(there.unionByName(guests), sets, rule)


# Steps 3 and 5: comparisons.

#: Of a set where blocks meet: it only answers, it answers and asks, it only asks.
HOST, BOTH, GUEST = 0, 1, 2


def compared(asked: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """asked: key, role, near (like sets are near each other in its order), id, comp. Links (a, b): for each set that asks, one to each component of the sets of its key that it links to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, hosts, out = None, None, [], []
        for batch in batches:
            narrow = [batch.column(i).to_pylist() for i in range(5)]
            for k, role, _, id_, comp, raw in zip(*narrow, values(batch.column(5)), strict=True):
                if k != key:
                    if block is None and hosts:
                        out += Block(hosts, rule).inside()
                    key, block, hosts = k, None, []
                own = np.frombuffer(raw, "<u8")
                if role != GUEST:
                    hosts.append((id_, comp, own, role))
                    continue
                if block is None:
                    block = Block(hosts, rule)
                    out += block.inside()
                out += block.links(id_, comp, own)
            if len(out) >= 10_000:
                yield _links(out)
                out = []
        if block is None and hosts:
            out += Block(hosts, rule).inside()
        yield _links(out)

    whole = asked.join(sets.select("id", "tokens"), "id").select("key", "role", "near", "id", "comp", "tokens")
    return whole.repartition("key").sortWithinPartitions("key", "role", "near", "id").mapInArrow(releasing(run), "a long, b long")


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


class Block:
    """Sets that answer, under one index: which of their sets links to a set that asks?"""

    def __init__(self, hosts: list[tuple[int, int, np.ndarray, int]], rule: Rule):
        self.rule, self.hosts = rule, hosts
        self.ids, self.comps = [h[0] for h in hosts], np.array([h[1] for h in hosts], np.int64)
        self.sizes = np.array([len(h[2]) for h in hosts], np.int64)
        tokens, owner = np.concatenate([h[2] for h in hosts]) if hosts else np.empty(0, "<u8"), np.repeat(np.arange(len(hosts)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        #: Sets that have been answered: tokens and what each host shares with them.
        self.kept: list[tuple[np.ndarray, np.ndarray]] = []
        #: Pairs of components that a link has joined here.
        self.joined: dict[int, set[int]] = {}

    def listed(self, own: np.ndarray) -> np.ndarray:
        """How many of the tokens each host has: their index lists, added up."""
        low = np.searchsorted(self.tokens, own, "left")
        n = np.searchsorted(self.tokens, own, "right") - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[at], minlength=len(self.ids))

    def similar(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Of the sets answered, the one that shares most of the least tokens with ``own``, if it shares half of them."""
        best, most = None, min(SAMPLE, len(own)) / 2
        for other in self.kept:
            n = np.intersect1d(own[:SAMPLE], other[0][:SAMPLE], assume_unique=True).size
            if n > most:
                best, most = other, n
        return best

    def links(self, id_: int, comp: int, own: np.ndarray) -> list[tuple[int, int]]:
        """A link to each component here that the set links to, but for its own and those it has been joined with."""
        n = len(own)
        need = self.rule.overlap(n, self.sizes)
        open_ = (self.comps != comp) & (np.minimum(n, self.sizes) >= need)
        if comp in self.joined:
            open_ &= ~np.isin(self.comps, list(self.joined[comp]))
        if not open_.any():
            return []
        near = self.similar(own)
        if near is None:
            shared = self.listed(own)
        else:
            new, gone = np.setdiff1d(own, near[0], assume_unique=True), np.setdiff1d(near[0], own, assume_unique=True)
            least, most = near[1] - len(gone), np.minimum(near[1] + len(new), np.minimum(n, self.sizes))
            if not (open_ & (least < need) & (most >= need)).any():
                return self.told(id_, comp, np.flatnonzero(open_ & (least >= need)))
            shared = near[1] + self.listed(new) - self.listed(gone)
        self.kept = [*self.kept[-KEPT + 1 :], (own, shared)]
        return self.told(id_, comp, np.flatnonzero(open_ & (shared >= need)))

    def told(self, id_: int, comp: int, hits: np.ndarray) -> list[tuple[int, int]]:
        comps, first = np.unique(self.comps[hits], return_index=True)
        if len(comps):
            self.joined.setdefault(comp, set()).update(comps.tolist())
        return [(id_, self.ids[hits[i]]) for i in first.tolist()]

    def inside(self) -> list[tuple[int, int]]:
        """Links among the hosts that ask."""
        return [link for id_, comp, own, role in self.hosts if role == BOTH for link in self.links(id_, comp, own)]


def memberships(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """rows: at (long, unique), doc_id and text. Returns at, doc_id, n_shingles, component_id and kept, true for one row of a component."""
    rule = Rule(words, percent)
    spark = rows.sparkSession
    wide, work, kept = Scratch(), Scratch(), Scratch()
    described_rows = staged(described(rows, rule), wide)
    # The least of (id is null, id, row) stands for a class, and for a component.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("odd"), "doc_id", "at")).alias("first")
    sized = staged(described_rows.where("cls is not null").groupBy("cls").agg(first, F.max("n").alias("n"), F.first("prefix").alias("prefix")), wide)
    documents = staged(described_rows.drop("prefix"), kept)
    classes = staged(sized.select("cls", "first"), work)
    tokens = sized.agg(F.sum("n")).first()[0] or 0
    chosen = staged(able(sized.select(F.col("first.at").alias("id"), "n", "prefix"), rule, tokens, COMMON), work)
    wide.drop()
    label = spark.createDataFrame([], "node long, label long")
    if n := chosen.count():
        found = staged(sets_of(filtered(rows, chosen, n), rule).join(chosen, "id", "left_semi"), wide)
        # A second look, at nearly whole sets, leaves little but sets that do link.
        sets = staged(found.join(able(found, rule, found.agg(F.sum("n")).first()[0], MORE_COMMON), "id", "left_semi"), work)
        wide.drop()
        entries, heads = chosen_by_lists(staged(entries_of(sets, sketch_of(sets), rule), work), work)
        links = staged(with_heads(heads, sets, rule, work), work)
        members = grouped(heads, links, sets, work)
        met = staged(meeting(entries, members, rule, work), work)
        label = staged(components(links.unionByName(between_blocks(met, members, sets, rule, work))), work)
    named = classes.join(label.select(F.col("node").alias("id"), "label"), classes["first.at"] == F.col("id"), "left")
    named = staged(named.select("cls", "first", F.coalesce("label", "first.at").alias("label")), work)
    least = staged(named.groupBy("label").agg(F.min("first").alias("least")), work)
    named = staged(named.join(least, "label").select("cls", "least"), kept)
    work.drop()
    # Staged, so that a plain shuffle stands on both sides and a large class can be split.
    joined = documents.join(named, "cls").select("at", "doc_id", F.col("n").alias("n_shingles"), F.col("least.doc_id").alias("component_id"), (F.col("at") == F.col("least.at")).alias("kept"))
    alone = documents.where("cls is null").select("at", "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return joined.unionByName(alone)


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` without all but one row of each component, with its columns."""
    source = numbered(df, id_col, doc_id=F.col(id_col).cast("long"), text=F.col(text_col).cast("string"))
    dropped = staged(memberships(source.select("at", "doc_id", "text"), words, percent).where("not kept").select("at"))
    return unboxed(source.select("row", "at").join(broadcast_up_to(dropped, DROPPED), "at", "left_anti"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = numbered(docs, "doc_id", ("text",), doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string"))
    return memberships(rows.select("at", "doc_id", "text"), 4, 85).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive w as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
l as (select doc_id, case when trim(t, e' \t\n\x0b\x0c\r') = '' then [] else regexp_split_to_array(trim(t, e' \t\n\x0b\x0c\r'), '[ \t\n\x0b\x0c\r]+') end as l from w),
s as (select distinct doc_id, hash(array_to_string(l[i:i + 3], ' ')) as g from (select doc_id, l, unnest(range(1, greatest(len(l) - 2, 2))) as i from l where len(l) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
rare as (select g from s group by g having count(*) > 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id where a.g in (select g from rare) group by 1, 2),
k as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from k union all select b, a from k),
r as (select doc_id as node, doc_id as seen from l union select r.node, e.b from r join e on r.seen = e.a)
select l.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id
from l left join n using (doc_id) join (select node, min(seen) as component_id from r group by node) m on m.node = l.doc_id
"""
