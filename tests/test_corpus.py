"""The table operators: golden pages, fused against relational, and every registered query against DuckDB."""

from __future__ import annotations

import json

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from domloom import queries
from domloom.functions import attrs, http, text
from domloom.functions import url as urls
from domloom.operators import convert, induce, metadata, navigation, pagination, similarity, structured
from domloom.operators.store import ParquetStore, auto_save, upsert
from domloom.plans import relational
from domloom.selection import css
from domloom.selection.api import xpath
from domloom.sinks import files
from domloom.sources.pages import pages_of, parse_pages, responses, select, text_nodes, tree_of

from .pages import AFTER, BEFORE, BOARD, DIARY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def shop(spark):
    return spark.createDataFrame([(1, "https://bus.example/p", BOARD), (2, "https://x.example/", DIARY), (3, "https://n.example/", None)], "page_id long, url string, html string")


@pytest.fixture(scope="module")
def nodes(shop):
    return parse_pages(shop).cache()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def _rows(df: pd.DataFrame) -> list:
    columns = sorted(df.columns)
    return sorted(tuple("NULL" if v is None or v is pd.NaT or v != v else str(v) for v in r) for r in df[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    if name not in queries.ORACLES:
        assert len(got)
        return
    want = duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


SELECTORS = [
    "section",
    "#board .line",
    "ol > li > a",
    "h4 + em",
    "h4 ~ i",
    "li:first-child",
    "li:nth-child(2n+1)",
    "p:last-of-type",
    "td:only-of-type",
    "*:empty",
    "section:not([data-no='19'])",
    'i:not(:contains("left"))',
    "form:has(.remark)",
    "tr:has(+ tr)",
    "article:has(> table) p",
    "h2, .fare, h2",
    "a[href*='i'], a[href$='y']",
    ":root",
    "article:is(.bed, .nested) span",
    "li:nth-last-child(1) a",
]


@pytest.mark.parametrize("selector", SELECTORS)
def test_fused_is_relational(shop, nodes, selector):
    found = {(r.page_id, r.pre) for r in relational.css(nodes, selector, texts=text_nodes(shop)).select("page_id", "pre").collect()}
    parsed = css.parse_css(selector)
    want = {(i, k) for i, h in ((1, BOARD), (2, DIARY), (3, None)) for k in css.select_nodes(tree_of(h), parsed)}
    assert found == want


def test_fused_is_relational_on_all_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    held = pages.select("page_id", "html").collect()
    table = parse_pages(pages).cache()
    for selector in ("nav li:nth-of-type(2) > a", "article p", "body > *", "ul, ol, h1"):
        found = {(r.page_id, r.pre) for r in relational.css(table, selector).select("page_id", "pre").collect()}
        assert found == {(r.page_id, k) for r in held for k in css.select_nodes(tree_of(r.html), css.parse_css(selector))}


def test_strings_and_select(shop, nodes):
    rows = {r.page_id: r.s for r in shop.select("page_id", select("html", ids="section::attr(data-no)", fares=xpath("//b[@class=$c]/text()", c="fare")).alias("s")).collect()}
    assert rows[1].ids == ["7", "19", "23", "40"] and rows[1].fares == ["EUR 2.40", "EUR 3.10", "EUR 1.85", "EUR 5.00"]
    assert rows[2].ids == [] and rows[3].ids == []
    assert sorted(r.value for r in relational.css_strings(nodes, "section::attr(data-no)").collect()) == ["19", "23", "40", "7"]
    assert sorted(r.value for r in relational.css_strings(nodes, "h4::text").collect()) == ["Harbour", "Haven", "Heath", "Hill"]
    assert relational.css(nodes, "h4, h4", concatenate=True).count() == 8
    assert relational.css(nodes, "h4, h4").count() == 4


def test_navigation(shop, nodes):
    one = nodes.where("page_id = 1")
    lst = relational.css(one, ".lines")
    assert [r.attrs["id"] for r in navigation.parent(one, lst).collect()] == ["board"]
    assert navigation.children(one, lst).count() == 4
    first = one.where(F.element_at("attrs", "data-no") == "7")
    assert [r.attrs["data-no"] for r in navigation.next_of(one, first).collect()] == ["19"]
    assert navigation.previous_of(one, first).count() == 0
    assert navigation.siblings(one, first).count() == 3
    fare = relational.css(one, ".fare")
    up = navigation.find_ancestor(one, fare, attrs.has_class("attrs", "line")).collect()
    assert len(up) == 4 and {r.tag for r in up} == {"section"}
    assert {(r.tag, r.distance) for r in navigation.ancestors(one, relational.css(one, "ol")).collect()} == {("aside", 1), ("body", 2), ("html", 3)}
    body = nodes.where("page_id = 2 AND tag = 'article' AND level = 2")
    got = navigation.all_text(body, text_nodes(shop), nodes, separator=" | ", strip=True, ignore=("table",)).collect()
    assert [r.all_text for r in got] == ["May | Sown | Thinned | Rain | Wind"]
    t = tree_of(BOARD)
    link = t.by_tag["a"][1]
    assert navigation.css_selector(t, link) == "body > aside > ol > li:nth-of-type(2) > a"
    assert navigation.css_selector(t, t.by_tag["h4"][1]) == "#board > div > section:nth-of-type(2) > h4"
    assert navigation.xpath_selector(t, t.by_tag["h4"][1]) == "//*[@id='board']/div/section[2]/h4"
    for full in (False, True):
        for i in range(1, len(t)):
            assert css.select_nodes(t, css.parse_css(navigation.css_selector(t, i, full)))[:1] == [i] or not full


def test_similar(spark, nodes):
    one = nodes.where("page_id = 1")
    second = one.where(F.element_at("attrs", "data-no") == "19")
    assert similarity.find_similar(one, second).count() == 3
    remark = one.where(F.element_at("attrs", "data-stars") == "5")
    assert similarity.find_similar(one, remark).count() == 2
    with_path = parse_pages(spark.createDataFrame([(1, BOARD)], "page_id long, html string"), want=["level", "tag", "attrs", "text", "path"])
    assert similarity.find_similar(with_path, F.element_at("attrs", "data-no") == "19").count() == 3
    a = {"tag": "p", "attr_names": ["id"], "attr_values": ["x"], "text": "hello", "path": ["html", "body", "p"], "parent_name": "body", "parent_attr_names": [], "parent_attr_values": [], "parent_text": None, "siblings": ["p"], "children": None}
    assert similarity.similarity(a, a) == 100.0
    b = a | {"parent_name": None, "text": None, "siblings": None}
    assert similarity.similarity(b, a) != similarity.similarity(a, b)
    assert similarity.alike({"class": "a"}, {}, "", "") is False


def test_adaptive(spark, tmp_path):
    old = spark.createDataFrame([(1, BEFORE, "museum.example")], "page_id long, html string, site string")
    new = spark.createDataFrame([(2, AFTER, "museum.example"), (3, AFTER, "other.example")], "page_id long, html string, site string")
    store = ParquetStore(spark, str(tmp_path / "store"))
    assert store.retrieve().count() == 0
    found = similarity.fingerprints(old, "#lamp")
    store.save(auto_save(found, F.lit("museum.example"), "#lamp").drop("version"))
    store.save(auto_save(found, F.lit("museum.example"), "#lamp").drop("version"))
    assert store.retrieve("museum.example", "#lamp").count() == 1
    rows = similarity.adaptive_select(new, "#lamp", store.retrieve()).collect()
    t = tree_of(AFTER)
    assert {(r.page_id, r.relocated) for r in rows} == {(2, True)}
    assert t.tag[rows[0].pre] == "li" and "card" in t.attr(rows[0].pre, "class")
    assert similarity.adaptive_select(new, "#lamp", store.retrieve(), percentage=101).count() == 0
    hits = similarity.adaptive_select(new, "li", store.retrieve()).collect()
    assert len(hits) == 6 and not any(r.relocated for r in hits)
    assert similarity.relocate_in(t, similarity.fingerprint_of(t, t.by_tag["h5"][1]))[0] == (t.by_tag["h5"][1], 100.0)
    store.compact()
    assert store.retrieve().count() == 1
    assert store.clear("nowhere") == 0 and store.clear() == 1 and store.retrieve().count() == 0
    twice = upsert(spark.createDataFrame([("s", "i", 1, 5)], "site string, identifier string, version long, v int"), spark.createDataFrame([("s", "i", 2, 6)], "site string, identifier string, version long, v int"))
    assert [r.v for r in twice.collect()] == [6]
    best = similarity.best_match(t, {"tag": "li", "text_content": "", "attributes": {"class": "", "data-key": ""}, "dom_path": "html > body > main > div > ul > li"})
    assert best and best[0] == t.by_tag["li"][0]
    assert similarity.best_match(t, {"tag": "nothing"}, 0.9) is None


@pytest.mark.parametrize(
    "examples, regex",
    [
        ([], ""),
        (["", " "], ""),
        (["a.b", "a.b"], r"a\.b"),
        (["page1", "page22"], r"page\d+"),
        (["item 1", "item 22"], r"^item\ .*?$"),
        (["ab1cd", "abxcd"], r"^ab.*?cd$"),
        (["x", "y"], ".*"),
        (["aa", "aaa"], r"^aa.*aa$"),
    ],
)
def test_induce(spark, examples, regex):
    assert induce.induce(examples) == regex
    if any(s.strip() for s in examples):
        df = spark.createDataFrame([("g", i, s) for i, s in enumerate(examples)], "g string, i int, s string")
        assert [r.regex for r in induce.induce_by(df, "g", "s", order="i").collect()] == [regex]
    assert induce.induce(["item 1", "item 22"], strict=False) == r"item\ \d+"


def test_analysis(spark):
    head = "<title>T</title><meta name=description content=' D '><meta name=keywords content='a, b ,c'><meta property=og:type content=article><meta property='og:site_name' content=S><link rel=canonical href=/c><meta charset=utf-8>"
    pages = spark.createDataFrame([(1, "https://a.example/x", f"<head>{head}</head>"), (2, "https://a.example/y", "<meta name=title content=M>"), (3, "https://a.example/z", "<p>x")], "page_id long, url string, html string")
    got = {r.page_id: r for r in pages.select("page_id", metadata.metadata().alias("m")).select("page_id", "m.*", metadata.summary("m").alias("s")).collect()}
    assert (got[1].title, got[1].description, got[1].keywords, got[1].canonical_url, got[1].charset) == ("T", "D", ["a", "b", "c"], "/c", "utf-8")
    assert got[1].s == "Title: T\nDescription: D\nType: article\nSite: S"
    assert got[2].title == "M" and got[2].keywords == [] and got[3].s == "No significant metadata found."
    flat = {r.page_id: r for r in metadata.metadata_from_nodes(parse_pages(pages)).collect()}
    for i in (1, 2, 3):
        assert {f: flat[i][f] for f in metadata.FIELDS} == {f: got[i][f] for f in metadata.FIELDS}
    summary = {r.url: r for r in convert.page_summary(pages.unionByName(pages.limit(1).withColumns({"html": F.lit(None).cast("string"), "url": F.lit("u")})), selector="title").collect()}
    assert summary["https://a.example/x"].selected == ["T"] and summary["u"].error == "no content"
    page = spark.createDataFrame([(1, "<body><h1>Hi</h1><script>x</script>tail<p>a  b\t\tc</p></body>")], "page_id long, html string")
    one = lambda *a, **k: page.select(convert.content("html", *a, **k).alias("c")).first().c
    assert one("text", main_content_only=True) == ["Hi\ntail\na b\tc", ""]
    assert one("html", selector="p") == ["<p>a  b\t\tc</p>", ""]
    assert one("markdown", selector="h1") == ["Hi\n==", ""]
    with pytest.raises(ValueError):
        convert.content("html", "pdf")
    as_json = spark.createDataFrame([(1, '{"a": 1}'), (2, '<body>{"a": 2}</body>'), (3, "<p>no")], "page_id long, html string")
    assert [r.a for r in as_json.orderBy("page_id").select(F.try_variant_get(convert.page_json(), "$.a", "int").alias("a")).collect()] == [1, 2, None]


def test_structured_and_pagination(spark):
    items = structured.items(queries._fixture(spark))
    assert {r.type for r in items.collect()} == {"Product", "Offer", "NewsArticle", "https://schema.org/Person"}
    assert [r.page_id for r in structured.corrupt(queries._fixture(spark)).collect()] == [6]
    t = tree_of('<a class="x-next" href="/c">b</a><a href="/t">NEXT</a>')
    assert pagination.next_page_in(t, "https://a.example/") == "https://a.example/c"
    t = tree_of('<ul><li class="active"><a href="/1">1</a></li><li><a href="/2">2</a></li></ul>')
    assert pagination.next_page_in(t, "https://a.example/") == "https://a.example/2"


def test_text_functions(spark):
    df = spark.createDataFrame([("  a\t b\r\n c &amp; ",), ("Ciónue x1 y22",), ("",), (None,)], "s string")
    rows = lambda c: [r.c for r in df.select(c.alias("c")).collect()]
    assert rows(text.clean("s")) == ["a b c &amp;", "Ciónue x1 y22", "", None]
    assert rows(text.clean("s", remove_entities=True))[0] == "a b c &"
    assert rows(text.clean_spaces("s"))[0] == " a b c &amp; "
    assert rows(text.re_all("s", r"\w+"))[1] == ["Ciónue", "x1", "y22"]
    assert rows(text.re_all("s", r"([a-z])(\d+)"))[1] == ["x", "1", "y", "22"]
    assert rows(text.re_first("s", r"\d+", "none")) == ["none", "1", "none", "none"]
    assert rows(text.re_test("s", "CIÓN", case_sensitive=False))[1] is True
    assert rows(text.sort_chars(F.lit("hello")))[0] == "ehllo"
    assert rows(text.to_int(F.lit("$1,234 x")))[0] == 1234 and rows(text.to_float(F.lit("$1,234.5")))[0] == 1234.5
    for value, width in (("ab", 7), ("abc", 6), ("abc", 7), ("ab", 6), ("abcdef", 3)):
        assert rows(text.center(F.lit(value), width, "*"))[0] == value.center(width, "*")
    assert rows(text.zfill(F.lit("-42"), 6))[0] == "-42".zfill(6)
    assert rows(text.swapcase(F.lit("aBc1")))[0] == "AbC1" and rows(text.capitalize(F.lit("hELLO wORLD")))[0] == "Hello world"
    assert rows(text.expandtabs(F.lit("a\tb"), 4))[0] == "a   b" and rows(text.casefold(F.lit("Straße")))[0] == "strasse"
    assert rows(text.get(F.array(F.lit("a")), "x"))[0] == "a" and rows(text.get(F.array().cast("array<string>"), "x"))[0] == "x"
    assert rows(text.re_each(F.array(F.lit("a1"), F.lit("b22")), r"\d+"))[0] == ["1", "22"]


def test_attribute_functions(spark):
    df = spark.createDataFrame([({"data-id": "1", "class": "a b", "title": "the one"},)], "m map<string,string>")
    one = lambda c: df.select(c.alias("c")).first().c
    assert one(attrs.search_values("m", "1")) == {"data-id": "1"} and one(attrs.search_values("m", "one", partial=True)) == {"title": "the one"}
    assert one(attrs.has_class("m", "b")) and not one(attrs.has_class("m", "c"))
    assert one(attrs.get("m", "x", "d")) == "d" and one(attrs.get_list("m", "class")) == ["a", "b"]
    assert json.loads(one(attrs.json_string("m")))["title"] == "the one"


def test_url_functions(spark):
    assert urls.canonical("HTTP://Ex.com:80?b=2&a=1#f") == "http://ex.com/?a=1&b=2"
    assert urls.canonical("https://ex.com/a b#f", keep_fragments=True) == "https://ex.com/a%20b#f"
    for u in ("http://a.example/x?y=1&x=%20z", "https://é.example/ü?q=é", "nonsense", "http://[::1]:8080/"):
        assert urls.canonical(urls.canonical(u)) == urls.canonical(u)
    assert [urls.registered_domain(u) for u in ("https://www.a.co.uk/x", "http://A.b.example.com", "http://localhost", "http://1.2.3.4", None)] == ["a.co.uk", "example.com", None, None, None]
    df = spark.createDataFrame([("https://example.com/page", "../other"), ("https://example.com/page", "/absolute"), ("https://example.com/page", "relative")], "b string, u string")
    assert [r.c for r in df.select(urls.absolute("b", "u").alias("c")).collect()] == ["https://example.com/other", "https://example.com/absolute", "https://example.com/relative"]
    f = df.limit(1).select(urls.fingerprint("b").alias("a"), urls.fingerprint("b", method=F.lit("POST")).alias("p"), urls.fingerprint(F.concat("b", F.lit("#x"))).alias("h"), urls.fingerprint("b", headers=F.create_map(F.lit("A"), F.lit("B"))).alias("x")).first()
    assert len(f.a) == 20 and f.a == f.h and f.a != f.p and f.a != f.x


def test_http_functions(spark):
    assert http.parse_header_lines(["A: b:c", "X;", "Cookie: a=1; b=2"]) == ({"A": "b:c", "X": ""}, {"a": "1", "b": "2"})
    with pytest.raises(ValueError):
        http.parse_header_lines(["nothing"])
    p = http.parse_curl("curl -X POST https://a.example -H 'A: b' -b 'k=v' -d 'x=1' -x h:1 -U u:p")
    assert (p["method"], p["headers"], p["cookies"], p["data"], p["proxy"]) == ("post", {"A": "b"}, {"k": "v"}, "x=1", "http://u:p@h:1")
    assert http.parse_curl("curl -G https://a.example -d 'x=1&y=2'")["params"] == {"x": "1", "y": "2"}
    assert http.parse_curl("curl https://a.example --data-urlencode 'a=1' --data-urlencode 'b=2'")["data"] == "a=1&b=2"
    for bad in ("curl https://a.example --nothing", "curl a b", "curl -sZ a", "curl --silent=1 a"):
        with pytest.raises(AttributeError):
            http.parse_curl(bad)
    for bad in ("curl a -X", "curl 'a", "curl a -H nothing"):
        with pytest.raises(ValueError):
            http.parse_curl(bad)
    for same in ("curl -skXPOST a --data={}", "curl \\\n a -sk --request POST -d '{}'", "curl a -X post --data-raw '${}'"):
        assert {k: v for k, v in http.parse_curl(same).items() if v} == {"method": "post", "url": "a", "json_data": "{}", "follow_redirects": True}
    p = http.parse_curl("curl a --data-binary '[1]' -A me -H 'User-Agent: you' -x 'socks5://q:r@h:2/x' -U u:p --compressed")
    assert (p["method"], p["data"], p["json_data"], p["headers"], p["proxy"]) == ("post", "[1]", None, {"User-Agent": "you"}, "socks5://u:p@h:2/x")
    assert spark.createDataFrame([("curl 'https://a.example/x?y' -s",), ("wget a",)], "c string").select(http.curl_url("c").alias("u")).toPandas().u.tolist() == ["https://a.example/x?y", None]
    df = spark.createDataFrame([("http://u:p@h.example:8/",), ("ftp://h",), ("bad",)], "p string")
    rows = [r.c for r in df.select(http.proxy_parts("p").alias("c")).collect()]
    assert (rows[0].server, rows[0].username, rows[0].password) == ("http://h.example:8", "u", "p") and rows[1:] == [None, None]
    raw = spark.createDataFrame([("u", 404, bytearray("é".encode("latin-1")), {"Content-Type": "text/html; charset=latin-1"})], "url string, status int, body binary, headers map<string,string>")
    r = responses(raw)
    assert (r.first().reason, r.first().encoding) == ("Not Found", "latin-1") and pages_of(r).first().html == "é"
    page = spark.createDataFrame([("cType: 'managed'",), ("<script src='https://challenges.cloudflare.com/turnstile/v0/api.js'>",), ("x",)], "h string")
    assert [x.c for x in page.select(http.challenge_kind("h").alias("c")).collect()] == ["managed", "embedded", None]
    messages = spark.createDataFrame([("net::ERR_PROXY_X",), ("fine",), (None,)], "m string")
    assert [x.c for x in messages.select(http.is_proxy_error("m").alias("c")).collect()] == [True, False, False]
    jar = spark.createDataFrame([("a=1; b=2; a=3",)], "c string")
    assert jar.select(http.cookies("c").alias("c")).first().c == {"b": "2", "a": "3"}


def test_sinks(spark, tmp_path, shop):
    items = spark.createDataFrame([(1, "a"), (2, "ü")], "id int, s string").coalesce(1)
    files.write_jsonl(items, str(tmp_path / "l"))
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "l")).collect()) == [1, 2]
    assert files.write_json_array(items, str(tmp_path / "new" / "a.json"), indent=True) == 2
    assert json.loads((tmp_path / "new" / "a.json").read_text()) == [{"id": 1, "s": "a"}, {"id": 2, "s": "ü"}]
    assert files.write_json_array(items.limit(0), str(tmp_path / "e.json")) == 0 and json.loads((tmp_path / "e.json").read_text()) == []
    files.write_content(shop.where("page_id = 1"), str(tmp_path / "out.txt"))
    assert "Harbour" in "\n".join(r.value for r in spark.read.text(str(tmp_path / "out.txt")).collect())
    for bad in ("x.pdf", " ", "x"):
        with pytest.raises(ValueError):
            files.write_content(shop, bad)


def test_sql_functions(spark, shop):
    from domloom.sources.sql import register

    register(spark)
    shop.where("html IS NOT NULL").createOrReplaceTempView("shop")
    assert spark.sql("SELECT count(*) AS n FROM shop p, LATERAL dom_nodes(p.html) n WHERE n.tag = 'section'").first().n == 4
    assert spark.sql("SELECT t.text FROM shop p, LATERAL dom_text(p.html) t WHERE p.page_id = 2 AND t.seq = 0").first().text == "May"
    r = spark.sql("SELECT css_all(html, 'h4::text') AS a, css_first(html, 'title::text') AS b, xpath_all(html, '//li[2]/a/@href') AS c, url_join(url, '../x') AS d FROM shop WHERE page_id = 1").first()
    assert (r.a[0], r.b, r.c, r.d) == ("Harbour", "Departures", ["/mill?zone=2"], "https://bus.example/x")
    assert spark.sql("SELECT html_text('<p>a<p>b') AS t, html_pretty('<p>a') AS p, url_canonical('HTTP://A.example') AS u, url_site('http://x.b.co.uk') AS s").first()[:] == ("a\nb", "<html>\n  <body>\n    <p>a</p>\n  </body>\n</html>", "http://a.example/", "b.co.uk")


def test_similarity_scores_against_difflib(spark, sf):
    got = {r.page_id: (r.host, r.score) for r in queries.similarity_scores(spark, sf).collect()}
    held = {r.page_id: tree_of(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    prints = {i: similarity.fingerprint_of(t, t.by_tag["h1"][0]) for i, t in held.items()}
    first: dict[str, int] = {}
    for i in sorted(got):
        first.setdefault(got[i][0], i)
    assert {i: s for i, (_, s) in got.items()} == {i: similarity.similarity(prints[first[h]], prints[i]) for i, (h, _) in got.items()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf):
    """Known selectors shuffle nothing, node plans join on page_id, filters and columns reach the scan."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    fused = _plan(pages.select("page_id", select("html", t="title::text").alias("s")))
    assert "Exchange" not in fused and "url" not in fused.split("ReadSchema")[1]
    table = parse_pages(pages)
    for selector in ("ul > li > a", "nav a", "h1 + p", "div:not(:has(p))"):
        plan = _plan(relational.css(table, selector))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    plan = _plan(queries.offsite_filter(spark, sf))
    assert "Python" not in plan and "o_comment" not in plan
    wave = _plan(queries.domain_wave_cap(spark, sf))
    assert "WindowGroupLimit" in wave  # ranks are cut before the shuffle
    top = _plan(queries.frontier_topk(spark, sf))
    assert "TakeOrderedAndProject" in top
