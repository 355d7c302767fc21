"""Incremental twins of the batch jobs on Structured Streaming.

A job's table and checkpoint are named by its caller; run again with the same
names, also on another driver, it goes on where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelweave.operators import ranking as rk
from reelweave.sources import pages as pg
from reelweave.sources.store import Store


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Process all that is available into the Parquet table ``path`` and read it; the checkpoint stands beside it."""
    q = (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_keyed(stream: DataFrame, store: Store, name: str, key: list[str], order: list[str] = (), mode: str = "update") -> DataFrame:
    """Process all that is available; rows of a batch replace those of their key in the stored table ``name``.

    Of several rows of a key in one batch the greatest by ``order`` counts.  The table and the batch number are committed together, so a batch that runs again changes nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        old = store.read(name, schema=batch.schema)
        if order:
            batch = rk.latest_by_key(batch, key, list(order)).select(*batch.columns)
        merged = old.join(batch.select(*key).distinct(), key, "left_anti").unionByName(batch)
        store.commit({name: merged}, (name, batch_id))

    q = (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{store.root}/checkpoints/{name}")
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()
    return store.read(name, schema=stream.schema)


def stream_first_seen(stream: DataFrame, key: list[str], ts: str, keep: str) -> DataFrame:
    """First arrival of every key, remembered for ``keep``."""
    return stream.withWatermark(ts, keep).dropDuplicatesWithinWatermark(key)


def stream_status_counts(stream: DataFrame, ts: str, by: str, size: str, late: str = "1 day") -> DataFrame:
    """Counts by window; in update mode a window's count goes once the watermark has passed it."""
    counts = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("day"), by, "n")


def stream_pages(stream: DataFrame, path: str) -> DataFrame:
    """New pages that are no block pages, stored as they arrive."""
    return run_to_table(pg.flag_blocked_pages(stream).filter(~F.col("is_blocked")).drop("is_blocked"), path)
