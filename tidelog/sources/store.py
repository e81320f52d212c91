"""A persistent store of versioned keys: a log, sorted runs in levels, and a pointer to the current revision.

    <path>/CURRENT            the current revision's id, then the numbers of logs not yet in runs;
                              then the kind of keys, and each stream's last batch
    <path>/rev/<id>.json      its manifest: a line for each run, with its level
    <path>/sst/<id>/          a run: Parquet, sorted by key, newest version first
    <path>/wal/<number>.wal   framed records

Small writes go through ``put`` and ``delete``: to the log, then to a memtable on the
driver, which becomes a run of level 0 before it outgrows its limit. Bulk writes go
through ``load``: a table becomes a run without passing the driver. A level with more runs
than it may have is merged into one run of the next level.

A revision is published by renaming a finished pointer file over the old one in one step;
readers keep the files they have planned on, as nothing is deleted before ``vacuum``. There
is a single writer. Only Hadoop's file system is used, so any store that it knows will do.

Reads of single keys are cached twice: the readers of sets of runs stay open, and what a
run answers for a key is kept, which is right for ever, as runs never change.
"""

from __future__ import annotations

import json
import logging
import threading
from collections import OrderedDict
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.hashing import chained_id, content_of, content_sums
from tidelog.functions.keys import KEY_OVERHEAD, entry_bytes, newest, version_order
from tidelog.model import DELETE, LEVELS, MANIFEST, PUT, Options, Status, StoreError, log_schema
from tidelog.operators import lww
from tidelog.operators.runs import merge
from tidelog.sources import wal


LOGGER = logging.getLogger("tidelog.store")


class Files:
    """What the store needs of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"
        if self.local:  # without the side files of checksums, which can't be replaced in the same step
            self.fs = self.jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).getRawFileSystem()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def is_dir(self, name: str) -> bool:
        return self.exists(name) and self.fs.getFileStatus(self.path(name)).isDirectory()

    def mkdirs(self, name: str) -> None:
        self.fs.mkdirs(self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name)))

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes) -> None:
        """All or nothing: a file of another name is finished first, then takes the place."""
        self.fs.delete(self.path(f"{name}.tmp"), False)
        stream = self.fs.create(self.path(f"{name}.tmp"), True)
        stream.write(data)
        stream.close()
        self.replace(f"{name}.tmp", name)

    def replace(self, old: str, new: str) -> None:
        """Rename over what is there, in one step. Where the file system can't, ``new`` stays as it was and this fails."""
        try:
            if self.local:
                nio = self.jvm.java.nio.file
                how = self.gateway.new_array(nio.CopyOption, 1)
                how[0] = nio.StandardCopyOption.ATOMIC_MOVE
                nio.Files.move(*[self.jvm.java.io.File(self.path(x).toUri().getPath()).toPath() for x in (old, new)], how)
            else:
                hadoop = self.jvm.org.apache.hadoop.fs
                rename = getattr(hadoop, "Options$Rename")
                how = self.gateway.new_array(rename, 1)
                how[0] = rename.OVERWRITE
                hadoop.FileContext.getFileContext(self.fs.getUri(), self.fs.getConf()).rename(self.path(old), self.path(new), how)
        except Py4JJavaError as error:
            raise StoreError(f"{new}: can't be replaced: {error.java_exception}") from error


@dataclass(frozen=True)
class Run:
    level: int
    sst: str
    num_keys: int
    max_seq: int
    min_key: str
    max_key: str
    file_size: int

    def line(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True, ensure_ascii=False)


class Recent:
    """The ``most`` entries used last. Reads and the merging thread may share one."""

    def __init__(self, most: int):
        self.most, self.held, self.lock = most, OrderedDict(), threading.Lock()

    def get(self, key):
        """The entry, or None; it counts as used."""
        with self.lock:
            if key in self.held:
                self.held.move_to_end(key)
            return self.held.get(key)

    def put(self, key, value) -> None:
        with self.lock:
            self.held[key] = value
            self.held.move_to_end(key)
            while len(self.held) > self.most:
                self.held.popitem(last=False)

    def clear(self) -> None:
        with self.lock:
            self.held.clear()


Key = str | bytes


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options):
        self.spark, self.root, self.options = spark, path.rstrip("/"), options
        self.files, self.schema = Files(spark, self.root), log_schema(options.binary)
        self.closed = False
        self.runs: list[Run] = []
        self.memtable: list[tuple[Key, int, int, Key]] = []
        self.memtable_size, self.waiting = 0, b""
        self.next_seq, self.log = 0, 0
        #: Files of the open log, each written once.
        self.segment = 0
        #: Of each stream that was loaded, the number of its last batch.
        self.streams: dict[str, int] = {}
        self.readers, self.answers = Recent(options.open_runs), Recent(options.cached_answers)
        #: What is published, by the writer and the merging thread, goes one at a time.
        self.publishing = threading.RLock()
        self.worker = ThreadPoolExecutor(1) if options.background else None
        self.merging: Future | None = None

    # Opening and closing.

    @classmethod
    def create(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        store = cls(spark, path, options or Options())
        if store.files.exists(f"{store.root}/CURRENT"):
            raise StoreError(f"{path}: exists already")
        for name in ("sst", "rev", "wal"):
            store.files.mkdirs(f"{store.root}/{name}")
            if store.files.names(f"{store.root}/{name}"):
                raise StoreError(f"{path}: holds files in {name} but no CURRENT; it isn't made anew over them")
        store.publish([])
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        store = cls(spark, path, options or Options())
        if store.files.exists(store.root) and not store.files.is_dir(store.root):
            raise StoreError(f"{path}: is not a directory")
        if not store.files.exists(f"{store.root}/CURRENT"):
            if not store.options.create_if_missing:
                raise StoreError(f"{path}: {Status.NOT_FOUND}")
            return cls.create(spark, path, options)
        store.recover()
        return store

    def recover(self) -> None:
        """Read the pointer and the manifest, then take what the logs hold into runs."""
        first, *notes = self.files.read(f"{self.root}/CURRENT").decode().splitlines() or [""]
        revision, *logs = first.split(" ")
        if len(revision) != 64:
            raise StoreError(f"{self.root}/CURRENT: {Status.BAD_RECORD}")
        if ("kind binary" in notes) != self.options.binary:
            raise StoreError(f"{self.root}: was made with keys of the other kind, text or bytes")
        self.streams = {name: int(n) for kind, name, n in (x.split(" ") for x in notes if x.startswith("stream "))}
        lines = self.files.read(f"{self.root}/rev/{revision}.json").decode().splitlines()
        self.runs = [Run(**json.loads(line)) for line in lines]
        pending = [n for n in self.files.names(f"{self.root}/wal") if n.endswith(".wal") and n.split("-")[0] in logs]
        replayed = wal.replay(self.spark, [f"{self.root}/wal/{n}" for n in pending], self.options.binary) if pending else []
        done = max([r.max_seq for r in self.runs], default=-1)
        self.log = max([int(n) for n in logs], default=0) + 1
        fresh = [o for o in replayed if o[1] > done]
        self.next_seq = max([done, *(o[1] for o in fresh)]) + 1
        if fresh:
            self.publish([*self.runs, self.write_run(self.spark.createDataFrame(fresh, self.schema), 0)])
        else:
            self.publish(self.runs)
        for name in pending:
            self.files.delete(f"{self.root}/wal/{name}")

    @staticmethod
    def destroy(spark: SparkSession, path: str) -> None:
        Files(spark, path).delete(path)

    def close(self) -> None:
        """Write the log out. Its operations become a run when the store is opened again."""
        self.sync()
        self.closed = True
        if self.worker:
            try:
                self.merged()
            finally:
                self.worker.shutdown()

    def publish(self, runs: list[Run]) -> None:
        with self.publishing:
            lines = [r.line() for r in sorted(runs, key=lambda r: (r.level, r.min_key, r.sst))]
            revision = self.revision_id(runs)
            name = f"{self.root}/rev/{revision}.json"
            if not self.files.exists(name):
                self.files.write(name, "\n".join(lines).encode())
            notes = [f"{revision} {self.log}", *["kind binary"] * self.options.binary, *(f"stream {name} {n}" for name, n in sorted(self.streams.items()))]
            self.files.write(f"{self.root}/CURRENT", "".join(f"{x}\n" for x in notes).encode())
            self.runs = list(runs)

    @staticmethod
    def revision_id(runs: list[Run]) -> str:
        """Runs make the ids of levels, levels that of the revision."""
        by_level = {level: sorted(r.line() for r in runs if r.level == level) for level in range(LEVELS)}
        return chained_id([f"{level} {chained_id(lines)}" for level, lines in by_level.items() if lines])

    # Writing.

    def put(self, k: Key, v: Key) -> None:
        self.write(k, v, PUT)

    def delete(self, k: Key) -> None:
        """Whether the key exists isn't asked."""
        self.write(k, b"" if self.options.binary else "", DELETE)

    def write(self, k: Key, v: Key, op: int) -> None:
        self.writable()
        for x in (k, v):
            if isinstance(x, str) == self.options.binary:
                raise StoreError(f"{self.root}: its keys and values are {'bytes' if self.options.binary else 'text'}")
        if self.memtable_size > self.options.memtable_bytes:
            self.flush()
        entry = (k, self.next_seq, op, v)
        self.waiting += wal.framed(wal.encode(*entry))
        if self.options.sync or len(self.waiting) >= self.options.log_buffer:
            self.sync()
        self.memtable.append(entry)
        self.memtable_size += len(wal.as_bytes(k)) + KEY_OVERHEAD + len(wal.as_bytes(v))
        self.next_seq += 1

    def writable(self) -> None:
        if self.closed:
            raise StoreError(f"{self.root}: closed")

    def sync(self) -> None:
        if self.waiting:
            self.files.write(f"{self.root}/wal/{self.log}-{self.segment}.wal", self.waiting)
            self.segment, self.waiting = self.segment + 1, b""

    def load(self, ops: DataFrame, stream: str = "", batch: int = 0) -> None:
        """Write a table of k, op and v, in the order of its ``seq``, as one run.

        stream: whose batch of number ``batch`` this is; one that isn't later than the
        stream's last in the store has been loaded already, and nothing is done.
        """
        self.writable()
        if stream and self.streams.get(stream, -1) >= batch:
            return
        self.flush()
        first, last = ops.agg(F.min("seq"), F.max("seq")).first()
        runs: list[Run] = []
        if first is not None:
            # Numbers keep their distances and follow those in the store.
            kind = self.schema["k"].dataType
            shifted = ops.select(F.col("k").cast(kind).alias("k"), (F.col("seq") - first + self.next_seq).alias("seq"), F.col("op").cast("int").alias("op"), F.col("v").cast(kind).alias("v"))
            runs = [self.write_run(shifted, 0)]
            self.next_seq += last - first + 1
        with self.publishing:
            if stream:
                self.streams[stream] = batch
            if stream or runs:
                self.publish([*self.runs, *runs])
        self.compact()

    def flush(self) -> None:
        """The memtable becomes a run of level 0, with all of its versions."""
        if not self.memtable:
            return
        run = self.write_run(self.spark.createDataFrame(self.memtable, self.schema), 0)
        with self.publishing:
            old, self.log, self.segment = self.log, self.log + 1, 0
            self.waiting = b""
            self.publish([*self.runs, run])
        LOGGER.info("%s: flushed %d entries into %s", self.root, run.num_keys, run.sst)
        self.memtable, self.memtable_size = [], 0
        for name in self.files.names(f"{self.root}/wal"):
            if name.startswith(f"{old}-"):
                self.files.delete(f"{self.root}/wal/{name}")
        self.compact()

    def write_run(self, rows: DataFrame, level: int) -> Run:
        """A sorted run from k, seq, op and v. Ranges of keys are files; a bloom filter for each tells absent keys."""
        rows = rows.select("k", "seq", "op", "v").persist()
        try:
            # One pass for all that must be known before the rows are dealt.
            figures = [F.max("seq"), F.min("k"), F.max("k"), F.approx_count_distinct("k"), F.sum(entry_bytes(F.col("k"), F.col("v")))]
            found = rows.agg(*figures, *content_sums(rows, "k", "seq", "op", "v")).first()
            max_seq, low, high, keys, size, n = found[:6]
            sst = content_of(found[5:])
            where = f"{self.root}/sst/{sst}"
            parts = max(1, -(-size // self.options.file_bytes))
            # A key with many versions may lie in several files.
            ordered = rows.repartitionByRange(parts, *version_order()) if parts > 1 else rows.coalesce(1)
            writer = ordered.sortWithinPartitions("k", F.desc("seq"), F.desc("op")).write.mode("overwrite")
            # A column that is all dictionary has no bloom filter.
            writer = writer.option("parquet.enable.dictionary#k", "false").option("parquet.bloom.filter.enabled#k", "true")
            writer.option("parquet.bloom.filter.expected.ndv#k", str(max(1, keys * self.options.bits_per_key // 10))).parquet(where)
        finally:
            rows.unpersist()
        return Run(level, sst, n, max_seq, self.spoken(low), self.spoken(high), self.files.size(where))

    def spoken(self, k: Key) -> str:
        """A key as manifests have it: text, or the hex digits of bytes, whose order is the same."""
        return bytes(k).hex() if self.options.binary else k

    def compact(self) -> None:
        """Merge levels that have too many runs; in the background if so asked, and then what fails is told by the next write."""
        if not self.worker:
            self.merge_levels()
        elif self.merging is None or self.merging.done():
            self.merged()
            self.merging = self.worker.submit(self.merge_levels)

    def merged(self) -> None:
        """Wait for merges in the background."""
        if self.merging:
            self.merging.result()

    def merge_levels(self) -> None:
        """The least level with too many runs first. Deletes are kept, as deeper levels may hold what they mask."""
        while (level := next((n for n in range(LEVELS - 1) if sum(r.level == n for r in self.runs) > self.options.level_files), None)) is not None:
            old = [r for r in self.runs if r.level == level]
            run = self.write_run(merge(*[self.run(r.sst) for r in old]), level + 1)
            LOGGER.info("%s: merged %d runs of level %d into %s, %d entries", self.root, len(old), level, run.sst, run.num_keys)
            with self.publishing:  # runs may have been added meanwhile
                gone = {r.sst for r in old}
                self.publish([*[r for r in self.runs if r.level != level or r.sst not in gone], run])

    def vacuum(self) -> None:
        """Delete runs and revisions that the current revision doesn't name. Not while older readers are at work."""
        self.merged()
        self.readers.clear()
        kept = {r.sst for r in self.runs}
        for name in self.files.names(f"{self.root}/sst"):
            if name not in kept:
                self.files.delete(f"{self.root}/sst/{name}")
        for name in self.files.names(f"{self.root}/rev"):
            if name != f"{self.revision_id(self.runs)}.json":
                self.files.delete(f"{self.root}/rev/{name}")

    # Reading.

    def run(self, sst: str) -> DataFrame:
        return self.opened((sst,))

    def opened(self, ssts: tuple[str, ...]) -> DataFrame:
        """The reader of some runs; those used last stay open, so that their files aren't listed again."""
        found = self.readers.get(ssts)
        if found is None:
            found = self.spark.read.schema(self.schema).parquet(*[f"{self.root}/sst/{s}" for s in ssts])
            self.readers.put(ssts, found)
        return found

    def chosen(self, low: Key | None, high: Key | None) -> list[str]:
        """Runs whose keys can lie between ``low`` and ``high``."""
        return [r.sst for r in self.runs if (low is None or r.max_key >= self.spoken(low)) and (high is None or r.min_key <= self.spoken(high))]

    def entries(self, low: Key | None = None, high: Key | None = None) -> DataFrame:
        """All stored versions, of runs whose keys can lie between ``low`` and ``high``, and of the memtable."""
        held = [e for e in self.memtable if (low is None or e[0] >= low) and (high is None or e[0] <= high)]
        found = self.spark.createDataFrame(held, self.schema)
        if chosen := self.chosen(low, high):
            found = found.unionByName(self.opened(tuple(chosen)))
        return found

    def get(self, k: Key) -> tuple[Status, Key | None]:
        mine = [e for e in self.memtable if e[0] == k]
        if mine:
            return self.told(max(mine, key=lambda e: (e[1], e[2]))[1:])
        asked = tuple(self.chosen(k, k))
        kept = {s: self.answers.get((s, k)) for s in asked}
        known = {s: answer[0] for s, answer in kept.items() if answer}
        if len(known) < len(asked):
            run = F.regexp_extract("_metadata.file_path", "sst/([0-9a-f]{64})/", 1).alias("sst")
            # All runs in one job, whichever are known.
            heads = self.opened(asked).where(F.col("k") == F.lit(k)).groupBy(run).agg(F.max_by(F.struct("seq", "op", "v"), newest()).alias("h"))
            known = dict.fromkeys(asked) | {r.sst: (r.h.seq, r.h.op, bytes(r.h.v) if self.options.binary else r.h.v) for r in heads.collect()}
            for sst, answer in known.items():
                # In a tuple, as that a run has no version of the key is an answer too.
                self.answers.put((sst, k), (answer,))
        return self.told(max((a for a in known.values() if a), default=None))

    def told(self, version: tuple[int, int, Key] | None) -> tuple[Status, Key | None]:
        return (Status.OK, version[2]) if version and version[1] == PUT else (Status.NOT_FOUND, None)

    def get_at(self, k: Key, seq: int) -> tuple[Status, Key | None]:
        """As of the moment when ``seq`` had been written, as far as merges have kept versions."""
        found = lww.get(lww.at_seq(self.entries(k, k), seq), F.lit(k)).first()
        return (Status.OK, bytes(found.v) if self.options.binary else found.v) if found else (Status.NOT_FOUND, None)

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return lww.multi_get(self.entries(), probes)

    def live(self) -> DataFrame:
        return lww.live(self.entries())

    def range(self, low: Key, high: Key) -> DataFrame:
        return lww.key_range(self.entries(low, high), F.lit(low), F.lit(high))

    def seek(self, k: Key) -> DataFrame:
        """The first stored version, in version order, whose key isn't less than ``k``."""
        return lww.seek(self.entries(low=k), F.lit(k))

    def scan(self) -> DataFrame:
        """All stored versions in version order, deletes included."""
        return self.entries().orderBy(*version_order())

    def manifest(self) -> DataFrame:
        """The current revision's runs."""
        return self.spark.createDataFrame([tuple(getattr(r, f.name) for f in MANIFEST) for r in self.runs], MANIFEST)

    def debug_run(self, sst: str) -> DataFrame:
        """A run in its order, deletes included."""
        return self.run(sst).orderBy(*version_order())
