"""Snapshots of a crawl: the pending requests and the seen fingerprints as Parquet.

A snapshot is written beside the last one and swapped in by renames; a missing or
broken one is treated as none, and a new crawl starts fresh.  Nothing is unpickled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from domloom import schemas

_QUEUE, _SEEN = f"{schemas.REQUESTS}, fp binary", "fp binary"


class Checkpoint:
    def __init__(self, spark: SparkSession, path: str, interval: float = 300.0) -> None:
        if interval < 0:
            raise ValueError("the interval cannot be negative")
        self.spark, self.path, self.interval, self.saved_at = spark, path.rstrip("/"), interval, 0.0
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def due(self, now: float) -> bool:
        """Whether the interval has passed since the last save; an interval of 0 never asks."""
        return bool(self.interval) and now - self.saved_at >= self.interval

    def exists(self) -> bool:
        return self.fs.exists(self._path(f"{self.path}/current/_DONE"))

    def save(self, queue: DataFrame, seen: DataFrame, now: float = 0.0) -> None:
        new, current, old = (f"{self.path}/{n}" for n in ("new", "current", "old"))
        self.fs.delete(self._path(new), True)
        queue.write.parquet(f"{new}/queue")
        seen.select("fp").write.parquet(f"{new}/seen")
        self.fs.create(self._path(f"{new}/_DONE")).close()
        self.fs.delete(self._path(old), True)
        if self.fs.exists(self._path(current)):
            self.fs.rename(self._path(current), self._path(old))
        self.fs.rename(self._path(new), self._path(current))
        self.fs.delete(self._path(old), True)
        self.saved_at = now

    def load(self) -> tuple[DataFrame, DataFrame] | None:
        """(queue in order, seen), or None."""
        if not self.exists():
            return None
        try:
            queue = self.spark.read.schema(_QUEUE).parquet(f"{self.path}/current/queue")
            seen = self.spark.read.schema(_SEEN).parquet(f"{self.path}/current/seen")
            queue.limit(1).collect(), seen.limit(1).collect()
        except Exception:  # broken files: start fresh, as without a snapshot
            return None
        return queue, seen

    def cleanup(self) -> None:
        self.fs.delete(self._path(self.path), True)
