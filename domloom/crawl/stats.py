"""Crawl statistics as aggregations over the log of requests.

The log has one row a request: sid, domain, status (null if it failed), bytes and
what became of it.  All counts are combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom.functions import http


def by_key(log: DataFrame) -> DataFrame:
    """(kind, key, value): requests by status and session, bytes by domain."""
    status = log.where("status IS NOT NULL").groupBy(F.concat(F.lit("status_"), F.col("status").cast("string")).alias("key")).agg(F.count("*").alias("value"))
    domain = log.where("status IS NOT NULL").groupBy(F.col("domain").alias("key")).agg(F.sum("bytes").alias("value"))
    session = log.groupBy(F.col("sid").alias("key")).agg(F.count("*").alias("value"))
    parts = [d.select(F.lit(k).alias("kind"), "key", F.col("value").cast("long").alias("value")) for k, d in (("status", status), ("bytes", domain), ("session", session))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def totals(log: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """One row: requests, failures, blocked, bytes, elapsed seconds and requests per second (both to two places, 0 without time)."""
    begin, stop = (start if start is not None else F.min("ts")), (end if end is not None else F.max("ts"))
    elapsed = F.coalesce(stop - begin, F.lit(0.0))
    row = log.agg(F.count("status").alias("requests"), F.count_if(F.col("status").isNull()).alias("failed"), F.count_if(http.is_blocked("status")).alias("blocked"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), elapsed.alias("e"))
    rate = F.coalesce(F.try_divide(F.col("requests"), F.col("e")), F.lit(0.0))
    return row.select("requests", "failed", "blocked", "bytes", F.round("e", 2).alias("elapsed_seconds"), F.round(rate, 2).alias("requests_per_second"))


def log_levels(records: DataFrame) -> DataFrame:
    return records.groupBy("level").agg(F.count("*").alias("n"))


def report(log: DataFrame) -> DataFrame:
    """Requests and bytes by domain and status with subtotals."""
    return log.rollup("domain", "status").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))
