"""Streams: sessions into the store, and counts of events over windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mnemospark.operators.memory import memorize
from mnemospark.sources.store import MemoryStore, latest


def ingest(sessions: DataFrame, store: MemoryStore, checkpoint: str, **options) -> StreamingQuery:
    """Each micro-batch becomes memories, linked to what is stored, and is upserted.

    Within a batch the last row of a memory holds. A late session is linked as if it arrived
    now. Repeating a batch after a failure gives the same tables: saving replaces by memory in all tables at once, and a memory's
    queries are never linked to its own.
    """

    def save(batch: DataFrame, _: int) -> None:
        batch = latest(batch, ["memory_id"], "created_at").persist()
        try:
            store.save(**memorize(batch, store.load("fake_queries"), store.load("knowledge_points"), **options))
        finally:
            batch.unpersist()

    return sessions.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Rows per key and window; rows later than ``late`` behind the newest are dropped by the watermark."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
