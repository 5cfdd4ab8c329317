"""Streaming forms: pages and requests as streams, de-duplication, state, windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from domloom import schemas
from domloom.crawl import frontier
from domloom.functions import http


def pages(spark: SparkSession, folder: str, *, schema: str = schemas.PAGES, max_files: int = 100) -> DataFrame:
    """New page files of a landing folder, at most max_files a batch (back-pressure)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def distinct_requests(reqs: DataFrame, *, event_time: str | None = None, ttl: str = "1 day") -> DataFrame:
    """Requests whose fingerprint was not seen (with an event time, seen within ttl: bounded state; else ever), and all with dont_filter."""
    marked = frontier.identify(reqs)
    marked = marked.withWatermark(event_time, ttl) if event_time else marked
    kept = marked.where("NOT dont_filter")
    kept = kept.dropDuplicatesWithinWatermark(["fp"]) if event_time else kept.dropDuplicates(["fp"])
    return kept.unionByName(marked.where("dont_filter"))


def retry_counts(responses: DataFrame, max_retries: int = 3) -> DataFrame:
    """(url, attempts, give_up) for each blocked response, with a counter a url kept as state for an hour."""

    def count(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = (state.get[0] if state.exists else 0) + sum(len(r) for r in rows)
        state.update((n,))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"url": [key[0]], "attempts": [n], "give_up": [n > max_retries]})

    blocked = responses.where(http.is_blocked("status"))
    return blocked.groupBy("url").applyInPandasWithState(count, "url string, attempts long, give_up boolean", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed(events: DataFrame, *keys: str, time: str = "ts", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Aggregates by time window and keys; rows later than the watermark are left out on a stream."""
    base = events.withWatermark(time, late) if events.isStreaming else events
    made = base.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys)
    found = made.agg(*[a.alias(n) for n, a in aggregates.items()])
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, *aggregates)


def sessions(events: DataFrame, key: str, *, time: str = "ts", gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    base = events.withWatermark(time, late) if events.isStreaming else events
    found = base.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def stream_items(items: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, once: bool = True):
    """Items to a function of (batch, number); the checkpoint makes each batch arrive at least once under its number."""
    writer = items.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
