"""A keyed fingerprint store: append-only Parquet, latest version wins.

Saving appends rows with a version; reading keeps the newest of each (site,
identifier).  No row is rewritten, concurrent writers do not disturb readers, and
``compact`` folds the history when it pays.  Sites partition the files only if asked.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom import schemas


class Store(Protocol):
    """What relocation needs of a store; any object with these two will do."""

    def save(self, rows: DataFrame) -> None: ...

    def retrieve(self, site: str | None = None, identifier: str | None = None) -> DataFrame: ...


def latest(rows: DataFrame, keys: tuple[str, ...] = ("site", "identifier"), version: str = "version") -> DataFrame:
    """The newest row of each key (of equal versions the one of greatest hash), with the creation version of the oldest; aggregated before the shuffle."""
    others = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(version, F.xxhash64(*others))).alias("r"), F.min(version).alias("created"))
    return found.select(*keys, *[F.col(f"r.{c}").alias(c) for c in others], "created")


class ParquetStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame:
        try:
            return self.spark.read.schema(schemas.STORE).parquet(self.path)
        except Exception as e:  # the folder appears with the first save
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schemas.STORE)

    def save(self, rows: DataFrame) -> None:
        """rows: site, identifier, fingerprint and, to order them, version (default: the time of saving)."""
        version = F.col("version") if "version" in rows.columns else F.unix_micros(F.current_timestamp())
        rows.select("site", "identifier", version.cast("long").alias("version"), "fingerprint").write.mode("append").parquet(self.path)

    def retrieve(self, site: str | None = None, identifier: str | None = None) -> DataFrame:
        rows = self._all()
        if site is not None:
            rows = rows.where(F.col("site") == site)
        if identifier is not None:
            rows = rows.where(F.col("identifier") == identifier)
        return latest(rows)

    def clear(self, site: str | None = None) -> int:
        """Remove a site, or everything; the number of keys removed."""
        rows = latest(self._all()).drop("created")
        gone = rows if site is None else rows.where(F.col("site") == site)
        n = gone.count()
        self._rewrite(rows.limit(0) if site is None else rows.where(F.col("site") != site))
        return n

    def compact(self) -> None:
        self._rewrite(latest(self._all()).drop("created"))

    def _rewrite(self, rows: DataFrame) -> None:
        """Write beside, then swap by renames, so a reader never sees half."""
        new, old = f"{self.path}.new", f"{self.path}.old"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path
        fs = where(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        rows.write.mode("overwrite").parquet(new)
        fs.delete(where(old), True)
        if fs.exists(where(self.path)):
            fs.rename(where(self.path), where(old))
        fs.rename(where(new), where(self.path))
        fs.delete(where(old), True)
        self.spark.catalog.refreshByPath(self.path)


def upsert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """Store and new rows as one table with the newest of each key (a pure plan, nothing written)."""
    return latest(store.unionByName(rows)).drop("created")


def auto_save(found: DataFrame, site: Column, identifier: str) -> DataFrame:
    """Store rows of each site's first match: found holds page_id, pre and fingerprint."""
    keyed = found.withColumn("site", site)
    return keyed.groupBy("site").agg(F.min_by("fingerprint", F.struct("page_id", "pre")).alias("fingerprint")).select("site", F.lit(identifier).alias("identifier"), F.lit(None).cast("long").alias("version"), "fingerprint")
