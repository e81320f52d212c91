"""A continuous stream of puts and deletes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions.keys import newest
from tidelog.model import PUT
from tidelog.sources.store import Files, Store


def live_stream(log: DataFrame) -> DataFrame:
    """Newest versions of a streamed log, deletes included, as they change.

    Late entries are harmless: versions are ordered by number, not by time of arrival. For
    output mode complete or update; take ``op = 0`` from the result for live keys.
    """
    return log.groupBy("k").agg(F.max_by(F.struct("seq", "op", "v"), newest()).alias("h")).select("k", "h.seq", "h.op", "h.v")


def live_of(state: DataFrame) -> DataFrame:
    return state.where(F.col("op") == PUT).select("k", "v", "seq")


def flush_stream(log: DataFrame, store: Store, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a streamed log into ``store``, a run for each batch.

    A batch that comes again after a failure is known by the stream's id, which Spark keeps
    in ``checkpoint``, and by its number, and skipped. Other streams, and the same one from
    another checkpoint, have ids of their own.
    """

    def flush(batch: DataFrame, number: int) -> None:
        known = json.loads(Files(store.spark, checkpoint).read(f"{checkpoint.rstrip('/')}/metadata"))
        store.load(batch, known["id"], number)

    return log.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
