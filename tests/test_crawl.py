"""Frontier, policy, statistics, snapshots, the crawl loop, and the streaming forms."""

from __future__ import annotations

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from domloom.crawl import frontier, policy, stats
from domloom.crawl.checkpoint import Checkpoint
from domloom.crawl.spider import Crawl, Spider
from domloom.streaming import streams


def _requests(spark, rows):
    schema = "url string, seq long, priority int, dont_filter boolean, method string"
    return frontier.requests(spark.createDataFrame([(*r, *(0, False, "GET")[len(r) - 2 :]) for r in rows], schema))


def _seqs(df):
    return sorted(r.seq for r in df.collect())


def test_enqueue(spark):
    reqs = _requests(spark, [("http://a.example/?b=1&a=2", 1), ("http://A.example/?a=2&b=1#f", 2), ("http://a.example/", 3), ("http://a.example/", 4, 0, True), ("http://a.example/", 5, 0, False, "POST")])
    accepted, seen = frontier.enqueue(reqs)
    assert _seqs(accepted) == [1, 3, 4, 5] and seen.count() == 3
    again, seen2 = frontier.enqueue(_requests(spark, [("http://a.example/", 6), ("http://b.example/", 7)]), seen)
    assert _seqs(again) == [7] and seen2.count() == 4
    after_twin, _ = frontier.enqueue(_requests(spark, [("http://c.example/", 1, 0, True), ("http://c.example/", 2)]))
    assert _seqs(after_twin) == [1]


def test_order(spark):
    reqs = _requests(spark, [("http://a.example/1", 1, 0), ("http://a.example/2", 2, 5), ("http://b.example/3", 3, 5), ("http://b.example/4", 4, 1)])
    assert [r.seq for r in frontier.dequeue(reqs, 3).collect()] == [2, 3, 4]
    assert [r.seq for r in frontier.in_order(reqs).collect()] == [2, 3, 4, 1]
    assert _seqs(frontier.next_wave(reqs, per_domain=1)) == [2, 3]
    assert _seqs(frontier.next_wave(reqs, per_domain=1, total=1)) == [2]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.sampled_from("abcde"), min_size=1, max_size=12))
def test_enqueue_keeps_each_first(spark_once, paths):
    rows = [(f"http://x.example/{p}", i) for i, p in enumerate(paths)]
    accepted, seen = frontier.enqueue(_requests(spark_once, rows))
    first = {}
    for p, i in zip(paths, range(len(paths)), strict=True):
        first.setdefault(p, i)
    assert _seqs(accepted) == sorted(first.values()) and seen.count() == len(first)


@pytest.fixture(scope="module")
def spark_once(spark):
    return spark


def test_policy(spark):
    reqs = _requests(spark, [("http://example.com/", 1), ("http://sub.example.com/", 2), ("http://notexample.com/", 3), ("http://example.com:81/", 4)])
    kept, dropped = policy.offsite(reqs, ["example.com"])
    assert _seqs(kept) == [1, 2] and _seqs(dropped) == [3, 4]
    assert policy.offsite(reqs, [])[1].count() == 0
    done = reqs.withColumns({"status": F.when(F.col("seq") == 1, 429).otherwise(200), "retry_count": F.lit(2), "meta": F.create_map(F.lit("proxy"), F.lit("p"), F.lit("k"), F.lit("v"))})
    again = policy.retries(done).collect()
    assert [(r.retry_count, r.priority, r.dont_filter, r.meta) for r in again] == [(3, -1, True, {"k": "v"})]
    assert policy.retries(done, max_retries=2).count() == 0
    with pytest.raises(ValueError):
        policy.sessions(spark, [("a", "x"), ("a", "y")])
    with pytest.raises(KeyError):
        policy.sessions(spark, [("a", "x")], default="b")
    assert [r.sid for r in policy.sessions(spark, [("a", "x"), ("b", "y")], default="b").where("is_default").collect()] == ["b"]
    items = spark.createDataFrame([({"a": "1"},), ({},), (None,)], "item map<string,string>")
    scraped, gone = policy.keep_items(items)
    assert scraped.count() == 1 and gone.count() == 2
    log = spark.sql("SELECT * FROM VALUES ('p', timestamp'2024-01-01 00:00:00', true), ('p', timestamp'2024-01-01 00:01:00', false), ('q', timestamp'2024-01-01 00:00:00', true) t(proxy, ts, ok)")
    state = policy.proxy_state(log)
    now = lambda t: F.to_timestamp(F.lit(t))
    assert {r.proxy for r in policy.active_proxies(state, now("2024-01-01 00:02:00")).collect()} == {"q"}
    assert policy.active_proxies(state, now("2024-01-01 00:06:00")).count() == 2
    assert policy.least_used(state, now("2024-01-01 00:06:00")).first().proxy == "q"


def test_stats(spark):
    log = spark.createDataFrame([("s", "d", 200, 5, 1.0), ("s", "d", 404, 7, 2.0), ("t", "e", None, 0, 3.0), ("t", "e", 503, 1, 5.0)], "sid string, domain string, status int, bytes long, ts double")
    got = {(r.kind, r.key): r.value for r in stats.by_key(log).collect()}
    assert got[("status", "status_200")] == 1 and got[("bytes", "d")] == 12 and got[("session", "t")] == 2
    row = stats.totals(log).first()
    assert (row.requests, row.failed, row.blocked, row.bytes, row.elapsed_seconds, row.requests_per_second) == (3, 1, 1, 13, 4.0, 0.75)
    assert stats.totals(log.limit(0)).first().requests_per_second == 0.0
    assert stats.report(log).count() == 7


def test_follow(spark):
    parents = _requests(spark, [("http://a.example/x/", 1, 3)]).withColumn("meta", F.create_map(F.lit("k"), F.lit("old"), F.lit("j"), F.lit("1")))
    links = spark.createDataFrame([("http://a.example/x/", "../y", 0)], "url string, href string, seq int")
    r = frontier.follow(parents, links, meta={"k": "new"}).first()
    assert (r.url, r.priority, r.meta, r.headers) == ("http://a.example/y", 3, {"k": "new", "j": "1"}, {"referer": "http://a.example/x/"})


def test_checkpoint(spark, tmp_path):
    c = Checkpoint(spark, str(tmp_path / "c"), 10)
    assert c.load() is None and c.due(11) and not c.due(5) and not Checkpoint(spark, str(tmp_path / "d"), 0).due(1e9)
    with pytest.raises(ValueError):
        Checkpoint(spark, str(tmp_path), -1)
    rows = [(f"http://a.example/{i}", i) for i in range(200)]
    queue, seen = frontier.enqueue(_requests(spark, rows))
    for _ in range(2):
        c.save(queue, seen, 7.0)
    held = c.load()
    assert _seqs(held[0]) == list(range(200)) and held[1].count() == 200 and c.saved_at == 7.0
    for p in (tmp_path / "c" / "current" / "queue").glob("*.parquet"):
        p.write_bytes(b"broken")
    for p in (tmp_path / "c" / "current" / "queue").glob(".*.crc"):
        p.unlink()
    assert c.load() is None
    c.cleanup()
    assert not (tmp_path / "c").exists()


class Follows(Spider):
    start_urls = ("http://a.example/1", "http://a.example/1#again", "http://a.example/gone")
    allowed_domains = ("a.example",)
    max_retries = 1

    def on_scraped_item(self, items):
        return F.when(~F.contains("url", F.lit("blocked")) & ~F.endswith("url", F.lit("/3")), F.col("item"))


def test_crawl(spark, tmp_path):
    corpus = spark.createDataFrame(
        [("http://a.example/1", "<a href='/2'>x</a><a href='/2'>y</a><a href='http://other.example/'>o</a>", 200), ("http://a.example/2", "<a href='/3'>x</a><a href='/blocked'>b</a>", 200), ("http://a.example/3", "<a href='/1'>x</a>", 200), ("http://a.example/blocked", "", 503)],
        "url string, html string, status int",
    )
    result = Crawl(Follows(), corpus, str(tmp_path / "w")).start()
    s = result.stats
    assert result.completed and len(result) == 2 and s["items_dropped"] == 1
    assert (s["requests"], s["failed"], s["blocked"], s["retries"], s["offsite"]) == (5, 1, 2, 1, 1)
    c = Checkpoint(spark, str(tmp_path / "c"), 300)
    run = Crawl(Follows(), corpus, str(tmp_path / "x"), checkpoint=c)
    waves = run.waves()
    next(waves)
    run.request_pause()
    list(waves)
    assert run.paused and c.exists()
    rest = Crawl(Follows(), corpus, str(tmp_path / "y"), checkpoint=c)
    done = rest.start()
    assert done.completed and not c.exists() and run.stats["requests"] + rest.stats["requests"] == 5
    with pytest.raises(ValueError):
        Crawl(Spider(), corpus, str(tmp_path / "z")).start()


def test_one_request_of_a_fingerprint(spark):
    """Equal seq, equal rows and twins of different kinds: one passes, and the seen table gets each fingerprint once."""
    rows = [("http://a.example/", 1), ("http://a.example/#x", 1), ("http://a.example/", 1), ("http://b.example/", 2, 0, True), ("http://b.example/", 2), ("http://b.example/", 2, 0, True)]
    accepted, seen = frontier.enqueue(_requests(spark, rows))
    assert _seqs(accepted.where("NOT dont_filter")) == [1, 2] and accepted.where("dont_filter").count() == 2 and seen.count() == 2
    again, seen = frontier.enqueue(_requests(spark, rows), seen)
    assert again.count() == 2 and seen.count() == 2


def test_followed_links_keep_their_order(spark, tmp_path):
    """First in, first out: by the parent's number, then by place; a page of two sessions is followed once for each."""
    parents = _requests(spark, [("http://a.example/b", 7), ("http://a.example/a", 9)])
    links = spark.createDataFrame([("http://a.example/a", "/1", 0), ("http://a.example/a", "/2", 1), ("http://a.example/b", "/3", 1), ("http://a.example/b", "/4", 0)], "url string, href string, seq int")
    kept = lambda df: (df.write.parquet(str(tmp_path / "n")), spark.read.parquet(str(tmp_path / "n")))[1]
    got = frontier.numbered(frontier.follow(parents, links.union(links).repartition(3)), [F.col("place")], 20, kept).orderBy("seq").collect()
    assert [(r.seq, r.url[-1]) for r in got] == [(21, "4"), (22, "3"), (23, "1"), (24, "2")]
    two = parents.unionByName(parents.withColumn("sid", F.lit("s")))
    both = links.crossJoin(spark.createDataFrame([("",), ("s",)], "sid string"))
    assert frontier.follow(two, both).groupBy("sid").count().collect() == [("", 4), ("s", 4)] or frontier.follow(two, both).count() == 8


class Routed(Spider):
    start_urls = ("http://a.example/0",)
    callbacks = ("parse_item",)

    def start_requests(self, spark):
        return super().start_requests(spark).unionByName(frontier.requests(spark.createDataFrame([("http://a.example/5", "parse_item", 9)], "url string, callback string, seq long")))

    def parse_item(self, responses):
        return responses.select("url", F.parse_json(F.lit('{"kind": "item"}')).alias("item"))


def test_callbacks_and_repeated_corpus_rows(spark, tmp_path):
    """Requests go to the parser that they name; rows that repeat a page count once."""
    rows = [(f"http://a.example/{i}", f"<a href='/{i + 1}'>x</a><a href='/{i + 1}#y'>x</a>" if i not in (4, 5) else "") for i in range(6)]
    corpus = spark.createDataFrame(rows + rows[:1] + [("http://A.example/0#z", rows[0][1])], "url string, html string")
    result = Crawl(Routed(), corpus, str(tmp_path / "w"), folders=2).start()
    assert result.completed and result.stats["requests"] == 6 and result.stats["failed"] == 0
    assert [r.url for r in result.items.where("to_json(item) LIKE '%kind%'").collect()] == ["http://a.example/5"]


def test_streamed_requests_with_event_time(spark, tmp_path):
    reqs = _requests(spark, [("http://a.example/1", 1), ("http://a.example/1", 2), ("http://a.example/1", 3, 0, True)]).withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    reqs.write.parquet(str(tmp_path / "reqs"))
    for name, options in (("plain_reqs", {}), ("timed_reqs", {"event_time": "ts"})):
        stream = spark.readStream.schema(reqs.schema).parquet(str(tmp_path / "reqs"))
        streams.distinct_requests(stream, **options).writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
        assert spark.table(name).count() == 2 and spark.table(name).where("dont_filter").count() == 1


def test_a_wave_limit_pauses(spark, tmp_path):
    class Chain(Spider):
        start_urls = ("http://a.example/0",)
        max_waves = 2

    assert Spider.max_waves is None
    corpus = spark.createDataFrame([(f"http://a.example/{i}", f"<a href='/{i + 1}'>x</a>" if i < 2 else "") for i in range(3)], "url string, html string")
    c = Checkpoint(spark, str(tmp_path / "c"), 0)
    first = Crawl(Chain(), corpus, str(tmp_path / "x"), checkpoint=c).start()
    assert first.paused and c.exists() and len(first) == 2
    rest = Crawl(Chain(), corpus, str(tmp_path / "y"), checkpoint=c).start()
    assert rest.completed and not c.exists() and [r.url for r in rest] == ["http://a.example/2"]


def test_streams(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/pages.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    found = []
    q = streams.stream_items(streams.pages(spark, str(tmp_path / "in"), max_files=1).select("page_id"), lambda df, n: found.append(df.count()), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert sum(found) == 50 and len(found) == 3
    reqs = _requests(spark, [("http://a.example/1", 1), ("http://a.example/1", 2), ("http://a.example/2", 3)])
    reqs.write.parquet(str(tmp_path / "reqs"))
    stream = spark.readStream.schema(reqs.schema).parquet(str(tmp_path / "reqs"))
    q = streams.distinct_requests(stream).writeStream.format("memory").queryName("distinct_reqs").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("distinct_reqs").count() == 2
    events = spark.sql("SELECT timestamp'2024-01-01 00:10:00' + make_interval(0,0,0,0,id) AS ts, 'k' AS k FROM range(3)")
    assert [r.n for r in streams.windowed(events, "k", n=F.count("*")).orderBy("start").collect()] == [1, 1, 1]
    assert [r.n for r in streams.sessions(events, "k", gap="2 hours").collect()] == [3]


def test_speed_of_one_page():
    """Parse and select on the 5,000-element page stays far below half a second."""
    from domloom.dom.tree import parse
    from domloom.selection.api import css

    html = "<html><body>" + '<div class="item">' * 5000 + "</div>" * 5000 + "</body></html>"
    plan, began = css(".item::text"), time.process_time()
    plan.strings(parse(html))
    assert time.process_time() - began < 0.5
