"""The frontier: requests, fingerprints, de-duplication, priority order, following links.

Requests are rows of ``schemas.REQUESTS`` with ``fp`` (20 bytes) added by ``identify``.
De-duplication keeps the first request of a fingerprint by ``seq`` - exactly one, also
among equal ``seq`` - in one aggregation, and drops those already in the table of seen
fingerprints by an anti-join on fp; nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domloom.functions import url as urls

# Defaults of a request.
DEFAULTS = {"sid": "", "method": "GET", "priority": 0, "dont_filter": False, "callback": "parse", "retry_count": 0}


def requests(df: DataFrame, *, url: str = "url", seq: Column | None = None) -> DataFrame:
    """Any table with a url as requests; other request columns are taken where present, defaults fill the rest."""
    have = set(df.columns)
    given = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(DEFAULTS.get(c)).cast(kind)) if c in have else F.lit(DEFAULTS.get(c)).cast(kind)
    strings = "map<string,string>"
    order = seq if seq is not None else F.col("seq") if "seq" in have else F.monotonically_increasing_id()
    return df.select(
        F.col(url).alias("url"),
        given("sid", "string").alias("sid"),
        given("method", "string").alias("method"),
        given("body", "binary").alias("body"),
        (F.col("headers").cast(strings) if "headers" in have else F.create_map().cast(strings)).alias("headers"),
        given("priority", "int").alias("priority"),
        given("dont_filter", "boolean").alias("dont_filter"),
        (F.col("meta").cast(strings) if "meta" in have else F.create_map().cast(strings)).alias("meta"),
        given("callback", "string").alias("callback"),
        given("retry_count", "int").alias("retry_count"),
        order.cast("long").alias("seq"),
    )


def seeds(df: DataFrame, **options) -> DataFrame:
    """Start requests; an empty table is an error."""
    if df.isEmpty():
        raise ValueError("no start urls")
    return requests(df, **options)


def identify(reqs: DataFrame, *, include_headers: bool = False, keep_fragments: bool = False) -> DataFrame:
    """Adds fp."""
    headers = F.col("headers") if include_headers else None
    return reqs.withColumn("fp", urls.fingerprint("url", sid="sid", method="method", body="body", headers=headers, keep_fragments=keep_fragments))


def admit(reqs: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, fingerprints that were not seen before).  Requests with dont_filter always pass."""
    if "fp" not in reqs.columns:
        reqs = identify(reqs)
    order = F.struct("seq", "dont_filter", "priority", "url", "sid", "method", "retry_count")
    first = reqs.groupBy("fp").agg(F.min_by(F.struct(*reqs.columns), order).alias("r"))
    if seen is not None:
        first = first.join(seen.select("fp"), "fp", "left_anti")
    # the first request of a fingerprint passes; one after a dont_filter twin does not
    fresh = first.where("NOT r.dont_filter").select("r.*")
    return fresh.unionByName(reqs.where("dont_filter")), first.select("fp")


def enqueue(reqs: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted requests, seen afterwards): as admit, with the new fingerprints appended to those seen."""
    accepted, new = admit(reqs, seen)
    return accepted, new if seen is None else seen.select("fp").unionAll(new)


def numbered(df: DataFrame, order: list[Column], after: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df with ``seq`` from after + 1 on without gaps, in order.

    A sort by range, written by keep so that its rows stand still, and one row a partition for the offsets.
    """
    placed = keep(df.drop("seq").orderBy(*order).withColumns({"_p": F.spark_partition_id(), "_r": F.monotonically_increasing_id()}))
    counts = placed.groupBy("_p").agg(F.count("*").alias("n"), F.min("_r").alias("low"))
    shift = (F.sum("n").over(W.orderBy("_p")) - F.col("n") - F.col("low") + F.lit(after + 1)).alias("shift")
    return placed.join(F.broadcast(counts.select("_p", shift)), "_p").withColumn("seq", F.col("_r") + F.col("shift")).drop("_p", "_r", "shift")


def dequeue(queue: DataFrame, n: int) -> DataFrame:
    """The n next requests: highest priority first, in order of arrival inside one."""
    return queue.orderBy(F.desc("priority"), "seq").limit(n)


def in_order(queue: DataFrame) -> DataFrame:
    """The queue as dequeue would empty it, by a global sort (a range shuffle)."""
    return queue.orderBy(F.desc("priority"), "seq")


def next_wave(queue: DataFrame, per_domain: int | None = None, total: int | None = None) -> DataFrame:
    """Requests of the next wave: at most per_domain of each domain, then at most total."""
    out = queue
    if per_domain is not None:
        w = W.partitionBy("_d").orderBy(F.desc("priority"), "seq")
        out = out.withColumn("_d", urls.domain("url")).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= per_domain).drop("_d", "_k")
    return out if total is None else dequeue(out, total)


def follow(parents: DataFrame, links: DataFrame, *, priority: int | None = None, callback: str | None = None, meta: dict[str, str] | None = None) -> DataFrame:
    """Requests for links (url, href, seq, and sid where sessions share pages) of parents (request rows).

    The link is resolved against its page; session, callback, priority and headers are
    the parent's unless given, meta is merged (new wins) and the page is the referer.
    ``place`` orders them: by their parent's seq, then by the link's; ``seq`` is the link's.
    """
    keys = ["url", "sid"] if "sid" in links.columns else ["url"]
    if len(keys) == 1:
        links = links.dropDuplicates(["url", "href", "seq"])  # of pages that several sessions took
    found = links.select(*[F.col(k).alias(f"l_{k}") for k in keys], "href", F.col("seq").alias("l_seq"))
    joined = found.join(parents, [F.col(f"l_{k}") == F.col(k) for k in keys])
    strings = "map<string,string>"
    new_meta = F.create_map(*[F.lit(x) for kv in (meta or {}).items() for x in kv]).cast(strings)

    def merged(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast(strings)), lambda k, v: ~F.map_contains_key(new, k)), new)

    referer = F.create_map(F.lit("referer"), F.col("url"))
    return joined.select(
        urls.absolute("url", "href").alias("url"),
        "sid",
        F.lit("GET").alias("method"),
        F.lit(None).cast("binary").alias("body"),
        merged(F.col("headers"), referer).alias("headers"),
        (F.lit(priority) if priority is not None else F.col("priority")).cast("int").alias("priority"),
        F.lit(False).alias("dont_filter"),
        merged(F.col("meta"), new_meta).alias("meta"),
        (F.lit(callback) if callback else F.col("callback")).alias("callback"),
        F.lit(0).alias("retry_count"),
        F.col("l_seq").cast("long").alias("seq"),
        F.struct(F.col("seq").alias("parent"), F.col("l_seq").cast("long").alias("link")).alias("place"),
    )
