"""Continuous synchronisation and sliding request limits on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.committed import Change, Store


def sync_stream(rows: DataFrame, store: Store, checkpoint: str, order: str, table: str = "chunks", name: str = "sync", embed: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Upserts each batch of a stream of rows into a table of the store, of rows with one key the
    last by ``order``. The number of the batch is part of the commit: a batch that is run again,
    because its writer died before it could say that it was done, changes nothing. Ends when what
    is there has been read."""

    def apply(batch: DataFrame, number: int) -> None:
        store.commit({table: Change(upserts=embed(batch) if embed else batch, order=order)}, stream=name, batch=number)

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def searches_by_window(logs: DataFrame, size: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, source, searches) of a stream of logs (ts, source), late rows dropped after ``late``."""
    counted = logs.withWatermark("ts", late).groupBy(F.window("ts", size), "source").count()
    return counted.select(F.col("window.start").alias("start"), "source", F.col("count").alias("searches"))
