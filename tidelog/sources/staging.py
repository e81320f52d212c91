"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder given to ``setCheckpointDir``.

    Where neither is set a local session gets a temporary folder of its own. On a cluster
    that is an error: each executor would write to its own disk, and later reads would
    miss rows.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    if known.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {context.master} share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidelog-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


class Scratch:
    """Staged tables that are deleted together, once what is made of them has been staged elsewhere."""

    def __init__(self) -> None:
        self.paths: list = []

    def drop(self) -> None:
        for files, path in self.paths:
            files.delete(path, True)
            files.cancelDeleteOnExit(path)
        self.paths = []


def staged(df: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage.

    A lost executor then costs only the tasks it was running. The files go with
    ``scratch``, or when the session ends.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/tidelog-{uuid.uuid4().hex}"
    df.write.parquet(where)
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    if scratch is not None:
        scratch.paths.append((files, path))
    return spark.read.schema(df.schema).parquet(where)
