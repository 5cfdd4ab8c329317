"""Spiders over a stored corpus: the crawl loop as waves of joins.

A wave takes the next requests, joins them with the corpus by canonical url, applies
the spider's hooks (columns and functions over whole tables, never rows), and puts
retries and followed links back in the queue.  Every wave's queue, seen table, items
and log are written and reread, so plans stay short, a wave is taken exactly once, and
a stopped crawl continues from its snapshot.  The driver holds only counts.

The corpus is keyed once: one row a canonical url (that of least hash, where rows
repeat one), in folders by a hash of it, so a wave reads the folders that its requests
fall into.  Seen fingerprints are appended, never rewritten.  Followed links get the
next numbers in the order of their pages and places, so the queue is first in, first out.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom import schemas
from domloom.crawl import frontier, policy
from domloom.crawl.checkpoint import Checkpoint
from domloom.functions import http
from domloom.functions import url as urls
from domloom.sources.pages import select


@dataclass
class CrawlResult:
    items: DataFrame
    log: DataFrame
    stats: dict
    paused: bool = False
    folder: str = field(default="", repr=False)

    @property
    def completed(self) -> bool:
        return not self.paused

    def __len__(self) -> int:
        return self.items.count()

    def __iter__(self) -> Iterator:
        return self.items.toLocalIterator()


class Spider:
    """Override the class values and hooks; every hook works on columns or tables."""

    name = "spider"
    start_urls: tuple[str, ...] = ()
    allowed_domains: tuple[str, ...] = ()
    sessions: tuple[tuple[str, str], ...] = (("default", "corpus"),)
    max_retries = policy.MAX_RETRIES
    per_domain: int | None = None
    wave_size: int | None = None
    max_waves: int | None = None  # where set, a crawl pauses after so many
    callbacks: tuple[str, ...] = ()  # methods that parse the responses of requests naming them; all others go to parse

    def start_requests(self, spark: SparkSession) -> DataFrame:
        if not self.start_urls:
            raise ValueError("no start urls")
        return frontier.requests(spark.createDataFrame([(u, i) for i, u in enumerate(self.start_urls)], "url string, seq long"))

    def parse(self, responses: DataFrame) -> DataFrame:
        """Items: (url, item) of responses that were not blocked."""
        return responses.select("url", F.parse_json(F.to_json(F.struct("url", "status"))).alias("item"))

    def links(self, responses: DataFrame) -> DataFrame:
        """(url, sid, href, seq) to follow."""
        found = responses.select("url", "sid", F.posexplode(select("html", h="a::attr(href)").getField("h")).alias("seq", "href"))
        return found.select("url", "sid", "href", "seq")

    def parsed(self, responses: DataFrame) -> DataFrame:
        """The items of all responses, each parsed by the callback that its request names."""
        rest = responses.where(~F.col("callback").isin(*self.callbacks)) if self.callbacks else responses
        return _union([self.parse(rest), *[getattr(self, c)(responses.where(F.col("callback") == c)) for c in self.callbacks]])

    def on_scraped_item(self, items: DataFrame) -> Column | None:
        """An item column to keep instead; null drops an item."""
        return None

    def is_blocked(self) -> Column:
        return http.is_blocked("status")

    def retry_blocked_request(self, retries: DataFrame) -> DataFrame:
        return retries

    def on_start(self, resuming: bool) -> None: ...

    def on_close(self) -> None: ...

    def on_error(self, failed: DataFrame) -> None:
        """failed: requests the corpus holds no response for, with the ``error``."""


def _union(parts: list[DataFrame]) -> DataFrame:
    """All parts in order, in pairs: the plan's depth grows with the logarithm of the waves."""
    while len(parts) > 1:
        parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64("c_url"), F.lit(n)).cast("int")


class Crawl:
    """One run of a spider over corpus: (url, html) and optionally status."""

    def __init__(self, spider: Spider, corpus: DataFrame, folder: str, *, checkpoint: Checkpoint | None = None, folders: int = 64) -> None:
        self.spider, self.spark, self.folder, self.checkpoint = spider, corpus.sparkSession, folder.rstrip("/"), checkpoint
        self.given = corpus
        self.stop, self.folders, self.last, self.seen_paths = 0, folders, 0, []
        self.run = uuid.uuid4().hex
        self.stats = dict.fromkeys(("requests", "failed", "blocked", "retries", "offsite", "items_scraped", "items_dropped", "waves", "response_bytes"), 0)

    def request_pause(self) -> None:
        """The first call stops after this wave, the second before its links are followed; more change nothing."""
        self.stop = min(self.stop + 1, 2)

    def _keyed(self) -> DataFrame:
        """(c_url, bucket, html, status) of the corpus, written once."""
        status = F.col("status").cast("int") if "status" in self.given.columns else F.lit(200)
        rows = self.given.select(urls.canonical_url("url").alias("c_url"), F.struct("html", status.alias("status")).alias("page"))
        one = rows.groupBy("c_url").agg(F.min_by("page", F.struct(F.xxhash64("page.html"), "page.status")).alias("page"))
        path = f"{self.folder}/{self.run}/corpus"
        made = one.select("c_url", "page.*", _bucket(self.folders).alias("bucket"))
        made.repartition("bucket").write.partitionBy("bucket").parquet(path)
        return self.spark.read.schema(made.schema).parquet(path)

    def _look(self, new: DataFrame, k: int) -> DataFrame:
        """The seen fingerprints with new ones appended."""
        self.seen_paths.append(f"{self.folder}/{self.run}/seen-{k}")
        new.select("fp").write.parquet(self.seen_paths[-1])
        return self.spark.read.schema("fp binary").parquet(*self.seen_paths)

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{self.run}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def waves(self) -> Iterator[DataFrame]:
        """The items of each wave as it ends."""
        spider, s = self.spider, self.stats
        held = self.checkpoint.load() if self.checkpoint else None
        sessions = policy.sessions(self.spark, list(spider.sessions))
        spider.on_start(held is not None)
        corpus = self._keyed()
        if held:
            queue, seen = self._keep(held[0], "queue-0"), self._look(held[1], 0)
        else:
            # sessions are part of a fingerprint: settle them before the first look
            queue, new = frontier.admit(policy.with_session(spider.start_requests(self.spark), sessions).drop("known"))
            queue, seen = self._keep(queue, "queue-0"), self._look(new, 0)
        self.last = queue.agg(F.max("seq")).first()[0] or 0
        self.logs: list[DataFrame] = []
        while (spider.max_waves is None or s["waves"] < spider.max_waves) and not self.stop and not queue.isEmpty():
            s["waves"] = k = s["waves"] + 1
            taken = self._keep(frontier.next_wave(queue, spider.per_domain, spider.wave_size), f"taken-{k}")
            rest = queue.join(taken.select("fp", "seq"), ["fp", "seq"], "left_anti").select(*queue.columns)
            named = policy.with_session(taken, sessions).withColumn("c_url", urls.canonical_url("url")).withColumn("bucket", _bucket(self.folders))
            done = self._keep(named.join(corpus, ["bucket", "c_url"], "left").drop("c_url", "bucket"), f"responses-{k}")
            size = F.coalesce(F.octet_length("html"), F.lit(0)).cast("long")
            log = done.select("url", "sid", urls.domain("url").alias("domain"), "status", size.alias("bytes"), spider.is_blocked().alias("blocked"))
            self.logs.append(log)
            n, failed, blocked, size_ = log.agg(F.count("status"), F.count_if(F.col("status").isNull()), F.count_if("blocked"), F.sum("bytes")).first()
            s["requests"], s["failed"], s["blocked"], s["response_bytes"] = s["requests"] + n, s["failed"] + failed, s["blocked"] + blocked, s["response_bytes"] + (size_ or 0)
            if failed:
                spider.on_error(done.where("status IS NULL").withColumn("error", F.lit("the corpus has no such page")))
            good = done.where(F.col("status").isNotNull() & ~spider.is_blocked())
            again = policy.retries(done.where("status IS NOT NULL"), max_retries=spider.max_retries, blocked=spider.is_blocked())
            again = self._keep(spider.retry_blocked_request(again.select(*taken.columns)), f"retries-{k}")
            s["retries"] += again.count()
            made = spider.parsed(good)
            kept, dropped = policy.keep_items(made, spider.on_scraped_item(made))
            kept = self._keep(kept, f"items-{k}")
            s["items_scraped"] += kept.count()
            s["items_dropped"] += dropped.count()
            if self.stop < 2:
                followed = frontier.follow(good.select(*[c for c in taken.columns if c != "fp"]), spider.links(good))
                inside, outside = policy.offsite(followed, list(spider.allowed_domains))
                s["offsite"] += outside.count()
                inside = frontier.numbered(inside, [F.col("place"), F.col("url")], self.last, lambda df, k=k: self._keep(df, f"links-{k}"))
                inside = self._keep(frontier.identify(inside.drop("place").select(*[c for c in taken.columns if c != "fp"])), f"followed-{k}")
                self.last = max(self.last, inside.agg(F.max("seq")).first()[0] or 0)
                fresh, new = frontier.admit(inside, seen)
                queue = rest.unionByName(again).unionByName(fresh)
                queue, seen = self._keep(queue, f"queue-{k}"), self._look(new, k)
            else:
                queue = self._keep(rest.unionByName(again), f"queue-{k}")
            if self.checkpoint and (self.stop or self.checkpoint.due(time.monotonic())):
                self.checkpoint.save(queue, seen, time.monotonic())
            yield kept
        self.paused = not queue.isEmpty()
        if self.checkpoint and not self.paused:
            self.checkpoint.cleanup()
        elif self.checkpoint and not self.stop:
            self.checkpoint.save(queue, seen, time.monotonic())
        spider.on_close()

    def start(self) -> CrawlResult:
        began, parts = time.monotonic(), list(self.waves())
        items = _union(parts) if parts else self.spark.createDataFrame([], schemas.ITEMS)
        log = _union(self.logs) if self.logs else None
        elapsed = time.monotonic() - began
        self.stats |= {"elapsed_seconds": round(elapsed, 2), "requests_per_second": round(self.stats["requests"] / elapsed, 2) if elapsed else 0.0}
        return CrawlResult(items, log, self.stats, self.paused, self.folder)
