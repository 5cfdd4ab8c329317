"""Registered queries over the driver tables, with their DuckDB oracles.

Group A selects on pages, B navigates, C applies text, URL and JSON functions, D
similarity, E page analysis, F the crawl frontier, G time windows (an extension).  Page
oracles rest on the shape of the synthetic pages: what regular expressions see in the
markup is what the parser must find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domloom.crawl import frontier, policy, stats
from domloom.functions import attrs, http, text
from domloom.functions import url as urls
from domloom.operators import convert, induce, metadata, navigation, pagination, similarity, store, structured
from domloom.plans import relational
from domloom.selection.api import find_all, find_by_regex, xpath
from domloom.sources.pages import parse_pages, select, text_nodes
from domloom.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def spread(df: DataFrame) -> DataFrame:
    """A small page table over all cores, since parsing is work; a table of more partitions than cores is read as it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def strings(spark: SparkSession, sf_dir: str, **selectors) -> DataFrame:
    """page_id and one array column a selector, from one parse."""
    s = spread(pages(spark, sf_dir).select("page_id", "html")).select("page_id", select("html", **selectors).alias("s"))
    return s.select("page_id", *[F.col(f"s.{n}").alias(n) for n in selectors])


def each(found: DataFrame, name: str, *, seq: str = "seq") -> DataFrame:
    return found.select("page_id", F.posexplode(name).alias(seq, name))


# decoding of references in SQL: &amp; comes last
def _decoded(e: str) -> str:
    return f"replace(replace(replace(replace({e}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


_LINKS = "SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)) AS href, unnest(range(len(regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)))) AS seq FROM pages"
_ANCHORS = "SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)) AS anchor, unnest(range(len(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)))) AS seq FROM pages"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


# ---- A: selection

@query(f"SELECT {_HOST} AS host, count(*) AS pages, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY 1")
def domain_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("html").cast("long")
    return pages(spark, sf_dir).groupBy(urls.domain("url").alias("host")).agg(F.count("*").alias("pages"), F.sum(size).alias("bytes"))


@query(
    f"""SELECT {_HOST} AS host, count(*) AS pages, count(DISTINCT {_decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")}) AS titles,
    CAST(sum(len(regexp_extract_all(html, '<li><a href='))) AS BIGINT) AS links FROM pages GROUP BY 1"""
)
def host_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: pages, distinct titles and links by host, from one parse of each page."""
    found = spread(pages(spark, sf_dir)).select(urls.domain("url").alias("host"), select("html", title="title::text", links="nav a::attr(href)").alias("s"))
    return found.groupBy("host").agg(F.count("*").alias("pages"), F.countDistinct(F.get("s.title", 0)).alias("titles"), F.sum(F.size("s.links").cast("long")).alias("links"))


@query(f"SELECT page_id, {_decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir, title="title::text").select("page_id", F.get("title", 0).alias("title"))


@query(f"SELECT page_id, {_decoded("regexp_extract(html, '<footer>([^<]*)</footer>', 1)")} AS footer FROM pages")
def footer_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir, footer="footer::text").select("page_id", F.get("footer", 0).alias("footer"))


@query("SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '<script>', 'gs'), '<([a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(spread(pages(spark, sf_dir)), want=["tag"]).groupBy("tag").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, CAST(seq AS INTEGER) AS seq, {_decoded('href')} AS href FROM ({_LINKS})")
def nav_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(strings(spark, sf_dir, href="nav ul > li > a::attr(href)"), "href")


@query(f"SELECT page_id, CAST(seq AS INTEGER) AS seq, {_decoded('anchor')} AS anchor FROM ({_ANCHORS}) WHERE anchor <> ''")
def nav_link_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(strings(spark, sf_dir, anchor="nav a::text"), "anchor")


@query(f"SELECT page_id, {_decoded('anchor')} AS anchor FROM ({_ANCHORS}) WHERE seq = 1")
def nav_nth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir, anchor="nav li:nth-of-type(2) > a::text").select("page_id", F.explode("anchor").alias("anchor"))


@query(f"SELECT page_id, {_decoded('min_by(anchor, seq)')} AS first_anchor, {_decoded('max_by(anchor, seq)')} AS last_anchor FROM ({_ANCHORS}) GROUP BY 1")
def first_last_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["tag", "text"], tags=["a"])
    return nodes.groupBy("page_id").agg(F.min_by("text", "pre").alias("first_anchor"), F.max_by("text", "pre").alias("last_anchor"))


@query("SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def page_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir, lang="html::attr(lang)").select("page_id", F.get("lang", 0).alias("lang"))


@query("SELECT page_id, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def page_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir, charset=xpath("//meta[@charset]/@charset")).select("page_id", F.get("charset", 0).alias("charset"))


@query(f"SELECT page_id, {_decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS h1 FROM pages")
def h1_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir, h1=xpath("//article/h1/text()")).select("page_id", F.get("h1", 0).alias("h1"))


@query(f"SELECT page_id, {_decoded("regexp_extract(html, '<div class=\"ad\">([^<]*)</div>', 1)")} AS ad FROM pages")
def ad_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir, ad="div.ad::text").select("page_id", F.get("ad", 0).alias("ad"))


@query("SELECT page_id, CAST(2 AS INTEGER) AS n FROM pages")
def comma_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comma list is one union: title and h1 once each, although two selectors match h1."""
    nodes = parse_pages(spread(pages(spark, sf_dir)), tags=["title", "h1"])
    return relational.css(nodes, "h1, title, h1").groupBy("page_id").agg(F.count("*").cast("int").alias("n"))


@query(f"SELECT page_id, count(*) AS n FROM ({_LINKS}) WHERE starts_with(href, '/t') GROUP BY 1")
def attr_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), tags=["a"])
    return relational.css(nodes, 'a[href^="/t"]').groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, count(*) AS n FROM ({_ANCHORS}) WHERE NOT contains(anchor, 'e') GROUP BY 1")
def not_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strings(spark, sf_dir, a='nav a:not(:contains("e"))::attr(href)')
    return found.select("page_id", F.size("a").cast("long").alias("n")).where("n > 0")


@query(f"SELECT page_id, count(*) AS n FROM ({_ANCHORS}) WHERE lower(trim({_decoded('anchor')})) = 'the' GROUP BY 1")
def find_by_text_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), tags=["a"])
    return relational.find_by_text(nodes, "The").groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, count(*) AS n FROM ({_ANCHORS}) WHERE contains(lower({_decoded('anchor')}), 'an') GROUP BY 1")
def find_by_text_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), tags=["a"])
    return relational.find_by_text(nodes, "an", partial=True).groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, count(*) AS n FROM ({_ANCHORS}) WHERE regexp_matches({_decoded('anchor')}, '^[tT][a-z]+e') GROUP BY 1")
def find_by_regex_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), tags=["a"])
    return relational.find_by_regex(nodes, "^t[a-z]+e").groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(1 AS BIGINT) AS n FROM pages WHERE regexp_matches(html, '<h1>[^<]*[0-9]')")
def find_by_regex_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages whose heading holds a digit, by the in-page form: only the tree of each page is asked."""
    found = strings(spark, sf_dir, hit=find_by_regex("[0-9]", first_match=False), h1="h1")
    return found.where(F.arrays_overlap("hit", "h1")).select("page_id", F.lit(1).cast("long").alias("n"))


@query(f"SELECT page_id, count(*) AS n FROM ({_LINKS}) WHERE contains(href, 'th') GROUP BY 1")
def find_all_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strings(spark, sf_dir, a=find_all("a", {"href*": "th"}))
    return found.select("page_id", F.size("a").cast("long").alias("n")).where("n > 0")


@query("SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<p>')) AS BIGINT) AS n FROM pages")
def paragraphs_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), tags=["p", "article"])
    return relational.css(nodes, "article p").groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<div class=\"ad\">')) AS BIGINT) AS n FROM pages")
def has_class_ad(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), tags=["div"], want=["attrs"])
    return nodes.where(attrs.has_class("attrs", "ad")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '<script>', 'gs'), '<[a-z]')) AS BIGINT) AS n FROM pages")
def elements_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_pages(spread(pages(spark, sf_dir)), want=["pre"]).groupBy("page_id").agg(F.count("*").alias("n"))


@query(
    f"""SELECT page_id, array_to_string([trim(x) FOR x IN regexp_split_to_array({_decoded("regexp_replace(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '<[^>]*>', chr(1), 'g')")}, chr(1)) IF trim(x) <> ''], chr(10)) AS article FROM pages"""
)
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(pages(spark, sf_dir)).select("page_id", convert.all_text("html", strip=True, selector="article").alias("a"))
    return found.select("page_id", F.get("a", 0).alias("article"))


@query(f"SELECT page_id, CAST(seq AS INTEGER) AS seq, {_decoded('href')} AS href FROM ({_LINKS}) WHERE seq BETWEEN 1 AND 2")
def link_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), tags=["a"])
    cut = relational.part(nodes, 1, 3)
    from pyspark.sql import Window as W

    return cut.select("page_id", F.row_number().over(W.partitionBy("page_id").orderBy("pre")).alias("seq"), F.element_at("attrs", "href").alias("href"))


# ---- B: navigation

@query(f"SELECT page_id, CAST(seq AS INTEGER) AS seq, {_decoded('lag(anchor) OVER w')} AS previous, {_decoded('lead(anchor) OVER w')} AS next FROM ({_ANCHORS}) WINDOW w AS (PARTITION BY page_id ORDER BY seq)")
def link_next_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours of each li, by the texts of their links."""
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["parent", "tag", "text", "sib"], tags=["li", "a"])
    near = navigation.neighbours(nodes.where("tag = 'li'"))
    links = nodes.where("tag = 'a'").select("page_id", "parent", "text")
    at = lambda key, name: links.select(F.col("page_id"), F.col("parent").alias(key), F.col("text").alias(name))
    joined = near.select("page_id", "sib", "next_pre", "previous_pre").join(at("next_pre", "next"), ["page_id", "next_pre"], "left").join(at("previous_pre", "previous"), ["page_id", "previous_pre"], "left")
    return joined.select("page_id", (F.col("sib") - 1).alias("seq"), "previous", "next")


@query("SELECT 'li' AS parent_tag, CAST(sum(len(regexp_extract_all(html, '<li><a href='))) AS BIGINT) AS n FROM pages")
def link_parent_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["parent", "tag"])
    up = navigation.parent(nodes, nodes.where("tag = 'a'"))
    return up.groupBy(F.col("tag").alias("parent_tag")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(n * (n - 1) AS BIGINT) AS n FROM (SELECT page_id, len(regexp_extract_all(html, '<li><a href=')) AS n FROM pages) WHERE n > 1")
def link_siblings_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["parent", "tag"], tags=["li"])
    return navigation.siblings(nodes, nodes).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT 'html>body>nav>ul>li>a' AS path, CAST(sum(len(regexp_extract_all(html, '<li><a href='))) AS BIGINT) AS n FROM pages")
def anchor_ancestor_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["tag", "path"], tags=["a"])
    return nodes.groupBy(F.array_join("path", ">").alias("path")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(1 + 2 * len(regexp_extract_all(html, '<li><a href=')) AS BIGINT) AS n FROM pages")
def descendant_count_nav(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["end", "tag"])
    return navigation.descendants(nodes, nodes.where("tag = 'nav'")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href=')) AS BIGINT) AS n, 'ul' AS tag FROM pages")
def ancestor_with_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each link the nearest ancestor that is a list."""
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["end", "tag", "level"])
    found = navigation.find_ancestor(nodes, nodes.where("tag = 'a'"), F.col("tag").isin("ul", "ol"))
    return found.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(f"SELECT page_id, CAST(seq AS INTEGER) AS seq, 'body > nav > ul > li' || CASE WHEN seq > 0 THEN ':nth-of-type(' || (seq + 1) || ')' ELSE '' END || ' > a' AS selector FROM ({_LINKS})")
def gen_css_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(pages(spark, sf_dir)).select("page_id", navigation.generated_selectors("html", "nav a").alias("selector"))
    return each(found, "selector")


@query(f"SELECT page_id, CAST(seq AS INTEGER) AS seq, '//body/nav/ul/li' || CASE WHEN seq > 0 THEN '[' || (seq + 1) || ']' ELSE '' END || '/a' AS selector FROM ({_LINKS})")
def gen_xpath_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(pages(spark, sf_dir)).select("page_id", navigation.generated_selectors("html", "nav a", kind="xpath").alias("selector"))
    return each(found, "selector")


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href=')) AS BIGINT) AS items FROM pages")
def list_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["parent", "tag"])
    return navigation.children(nodes, nodes.where("tag = 'ul'")).groupBy("page_id").agg(F.count("*").alias("items"))


# ---- C: text, URL and JSON functions

@query("SELECT doc_id, trim(regexp_replace(translate(text, chr(9) || chr(10) || chr(13), '   '), ' +', ' ', 'g')) AS cleaned FROM documents")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean("text").alias("cleaned"))


@query("SELECT doc_id, regexp_replace(replace(replace(replace(text, chr(9), ' '), chr(10), ''), chr(13), ''), ' +', ' ', 'g') AS cleaned FROM documents")
def text_clean_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clean_spaces("text").alias("cleaned"))


@query("SELECT n_nationkey, array_to_string(list_sort(string_split(n_name, '')), '') AS sorted FROM nation")
def char_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", text.sort_chars("n_name").alias("sorted"))


@query(
    """SELECT n_nationkey, upper(n_name) AS upper, lower(n_name) AS lower, upper(left(lower(n_name), 1)) || substr(lower(n_name), 2) AS capitalized,
    lower(n_name) AS swapped, rpad(n_name, 30, '.') AS left_justified, lpad(n_name, 30, '.') AS right_justified,
    repeat('0', greatest(0, 6 - length(CAST(n_nationkey AS VARCHAR)))) || n_nationkey AS filled, replace(n_name, 'A', 'aa') AS replaced, len(string_split(n_name, ' ')) AS words FROM nation"""
)
def string_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("n_name")
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        F.upper(c).alias("upper"),
        F.lower(c).alias("lower"),
        text.capitalize(c).alias("capitalized"),
        text.swapcase(c).alias("swapped"),
        text.ljust(c, 30, ".").alias("left_justified"),
        text.rjust(c, 30, ".").alias("right_justified"),
        text.zfill(F.col("n_nationkey").cast("string"), 6).alias("filled"),
        text.replace(c, "A", "aa").alias("replaced"),
        F.size(text.split(c, " ")).cast("long").alias("words"),
    )


@query("SELECT page_id, array_to_string(list_sort(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')), '&') AS query FROM pages WHERE contains(url, '?')")
def url_query_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.try_parse_url("url", F.lit("QUERY"))
    return pages(spark, sf_dir).where(q.isNotNull()).select("page_id", F.array_join(F.array_sort(F.split(q, "&")), "&").alias("query"))


@query("SELECT page_id, sha256(lower(trim(url))) || '_' || strlen(lower(trim(url))) AS hash FROM pages")
def url_identifier_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("page_id", urls.identifier_hash("url").alias("hash"))


@query("SELECT o_orderkey, sha1('{\"body\":\"\",\"method\":\"GET\",\"sid\":\"s' || (o_orderkey % 3) || '\",\"url\":\"https://shop.example/o/' || o_orderkey || '\"}') AS fp FROM orders")
def request_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("https://SHOP.example/o/"), F.col("o_orderkey"), F.lit("#f")).alias("url"), F.concat(F.lit("s"), F.col("o_orderkey") % 3).alias("sid"))
    return o.select("o_orderkey", F.lower(F.hex(urls.fingerprint("url", sid="sid"))).alias("fp"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(text.json("props"), "$.k", "bigint").alias("k"))


@query(f"SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) AS scheme, {_HOST} AS authority, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '') AS path, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda p: F.nullif(F.try_parse_url("url", F.lit(p)), F.lit(""))
    return pages(spark, sf_dir).select("page_id", part("PROTOCOL").alias("scheme"), part("AUTHORITY").alias("authority"), part("PATH").alias("path"), part("REF").alias("fragment"))


@query("SELECT o_orderkey, 'https://shop.example/a?x=' || (o_orderkey % 7) || '&y=1' AS url FROM orders")
def canonical_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    raw = F.concat(F.lit("HTTPS://Shop.Example:443/a?y=1&x="), F.col("o_orderkey") % 7, F.lit("#top"))
    return o.select("o_orderkey", urls.canonical_url(raw).alias("url"))


@query(f"SELECT l.page_id, CAST(l.seq AS INTEGER) AS seq, regexp_extract(p.url, '^([a-z]+://[^/?#]+)', 1) || {_decoded('l.href')} AS abs_url FROM ({_LINKS}) l JOIN pages p ON p.page_id = l.page_id")
def link_absolute(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(pages(spark, sf_dir)).select("page_id", "url", F.posexplode(select("html", h="nav a::attr(href)").getField("h")).alias("seq", "href"))
    return found.select("page_id", "seq", urls.absolute("url", "href").alias("abs_url"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[0-9]+')) AS n, CAST(coalesce(list_sum([len(x) FOR x IN regexp_extract_all(text, '[0-9]+')]), 0) AS BIGINT) AS digits FROM documents")
def regex_findall_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", text.re_all("text", "[0-9]+", replace_entities=False).alias("m"))
    return found.select("doc_id", F.size("m").cast("long").alias("n"), F.coalesce(F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + F.length(x)), F.lit(0)).alias("digits"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[A-Z][a-z]+') THEN regexp_extract(text, '[A-Z][a-z]+') ELSE 'none' END AS word FROM documents")
def regex_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.re_first("text", "[A-Z][a-z]+", "none", replace_entities=False).alias("word"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'th(e|is|at)[^a-z]', 1)) AS BIGINT) AS n FROM documents")
def regex_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.re_all("text", "TH(E|IS|AT)[^a-z]", case_sensitive=False, replace_entities=False)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9.]+@[A-Za-z0-9]+[.][a-z]+')) AS email FROM documents")
def emails_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.re_all("text", "[A-Za-z0-9.]+@[A-Za-z0-9]+[.][a-z]+", replace_entities=False)
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("email"))


@query(f"SELECT page_id, count(*) AS n FROM ({_LINKS}) WHERE contains({_decoded('href')}, 'an') GROUP BY 1")
def attr_search_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["attrs"], tags=["a"])
    return nodes.where(F.size(attrs.search_values("attrs", "an", partial=True)) > 0).groupBy("page_id").agg(F.count("*").alias("n"))


@query("SELECT page_id, '{\"href\":\"' || " + _decoded("min_by(href, seq)") + " || '\"}' AS json FROM (" + _LINKS + ") WHERE NOT contains(href, '&quot;') GROUP BY 1 HAVING min(seq) = 0")
def attr_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["attrs"], tags=["a"])
    first = nodes.groupBy("page_id").agg(F.min_by("attrs", "pre").alias("attrs"))
    return first.where(~F.contains(attrs.get("attrs", "href"), F.lit('"'))).select("page_id", attrs.json_string("attrs").alias("json"))


@query("SELECT * FROM (VALUES (1, 'text/html', 'a=1;b=2'), (2, '', '')) t(id, accept, cookies)")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.createDataFrame([(1, ["Accept: text/html", "Cookie: a=1; b=2"]), (2, ["Accept;"])], "id int, lines array<string>")
    h = lines.select("id", http.headers("lines").alias("h"))
    jar = F.array_join(F.array_sort(F.transform(F.map_entries("h.cookies"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return h.select("id", F.element_at("h.headers", "Accept").alias("accept"), jar.alias("cookies"))


@query(
    """SELECT * FROM (VALUES (1, 'get', 'https://x.example/a', NULL, NULL), (2, 'post', 'https://x.example/b', NULL, '{"k": 1}'), (3, 'put', 'https://x.example/c', 'raw', NULL))
    t(id, method, url, data, json)"""
)
def curl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "curl 'https://x.example/a' -H 'Accept: */*' --compressed"), (2, "curl https://x.example/b --data-raw '{\"k\": 1}'"), (3, "curl -X PUT -d raw https://x.example/c")]
    c = spark.createDataFrame(rows, "id int, command string").select("id", http.curl("command").alias("c"))
    return c.select("id", "c.method", "c.url", "c.data", F.col("c.json_data").alias("json"))


@query("SELECT CAST(s AS INTEGER) AS status, CASE s WHEN 200 THEN 'OK' WHEN 404 THEN 'Not Found' WHEN 418 THEN 'I''m a teapot' WHEN 503 THEN 'Service Unavailable' ELSE 'Unknown Status Code' END AS phrase FROM (SELECT unnest([200, 404, 418, 503, 799]) AS s)")
def status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = spark.createDataFrame([(s,) for s in (200, 404, 418, 503, 799)], "status int")
    return codes.select("status", http.status_text("status").alias("phrase"))


@query("SELECT doc_id, CAST(len([w FOR w IN regexp_split_to_array(text, '[ \\t\\n\\r]+') IF w <> '']) AS BIGINT) AS n_words FROM documents")
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", r"[ \t\n\r]+"), lambda w: w != "")).cast("long").alias("n_words"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS as_int, CAST(l_quantity AS DOUBLE) AS as_float FROM lineitem")
def numbers_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("Qty "), F.col("l_quantity").cast("bigint"), F.lit(" pcs")).alias("s"))
    return shown.select("l_orderkey", "l_linenumber", text.to_int("s").alias("as_int"), text.to_float("s").alias("as_float"))


# ---- D: similarity

@query("SELECT page_id, CAST(n * (n - 1) AS BIGINT) AS pairs FROM (SELECT page_id, len(regexp_extract_all(html, '<li><a href=')) AS n FROM pages) WHERE n > 1")
def find_similar_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["level", "tag", "attrs", "text", "path"], tags=["a"])
    return similarity.find_similar(nodes, F.col("tag") == "a").groupBy("page_id").agg(F.count("*").alias("pairs"))


@query("SELECT page_id, CAST(1.0 AS DOUBLE) AS link_link, CAST(0.0 AS DOUBLE) AS link_div FROM pages")
def attr_key_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["tag", "attrs"], tags=["a", "div"])
    link = nodes.where("tag = 'a'").groupBy("page_id").agg(F.min_by("attrs", "pre").alias("a"), F.max_by("attrs", "pre").alias("b"))
    div = nodes.where("tag = 'div'").select("page_id", F.col("attrs").alias("d"))
    return link.join(div, "page_id").select("page_id", attrs.key_jaccard("a", "b").alias("link_link"), attrs.key_jaccard("a", "d").alias("link_div"))


@query(f"SELECT page_id, 'h1' AS tag, nullif(trim({_decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")}), '') AS text, 'html/body/article/h1' AS path, 'article' AS parent_name FROM pages")
def fingerprint_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.fingerprints(spread(pages(spark, sf_dir)), "h1")
    return found.select("page_id", F.col("fingerprint.tag").alias("tag"), F.col("fingerprint.text").alias("text"), F.array_join("fingerprint.path", "/").alias("path"), F.col("fingerprint.parent_name").alias("parent_name"))


@query("SELECT page_id, CAST(100.0 AS DOUBLE) AS score, CAST(1 AS BIGINT) AS places FROM pages")
def relocate_ad_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's own ad block is found again, alone and with the full score."""
    p = spread(pages(spark, sf_dir)).withColumn("site", F.col("page_id").cast("string"))
    saved = similarity.fingerprints(p, "div.ad").select(F.col("page_id").cast("string").alias("site"), F.lit("ad").alias("identifier"), "fingerprint")
    found = similarity.relocate(p, saved, "ad", percentage=50)
    return found.groupBy("page_id").agg(F.max("score").alias("score"), F.count("*").alias("places"))


@query()
def similarity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's heading against that of its host's first page; no SQL form, tested against difflib."""
    p = spread(pages(spark, sf_dir))
    found = similarity.fingerprints(p, "h1").join(p.select("page_id", urls.domain("url").alias("host")), "page_id")
    first = found.groupBy("host").agg(F.min_by("fingerprint", "page_id").alias("stored"))
    return found.join(first, "host").select("page_id", "host", similarity.score_pairs("stored", "fingerprint").alias("score"))


@query("SELECT n_regionkey, CASE WHEN count(DISTINCT n_name) = 1 THEN min(n_name) ELSE 'NATION_\\d+' END AS regex FROM nation GROUP BY 1")
def regex_induced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induce.induce_by(table(spark, sf_dir, "nation"), "n_regionkey", "n_name")


@query("SELECT CAST(o_orderkey % 10 AS BIGINT) AS g, CASE WHEN count(DISTINCT o_orderkey) = 1 THEN 'page' || min(o_orderkey) ELSE 'page\\d+' END AS regex FROM orders GROUP BY 1")
def regex_induced_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10).alias("g"), F.concat(F.lit("page"), F.col("o_orderkey").cast("string")).alias("s"))
    return induce.induce_by(o, "g", "s")


# ---- E: page analysis

_TITLE = _decoded("regexp_extract(html, '<title>([^<]*)</title>', 1)")


@query(f"SELECT page_id, {_TITLE} AS title, CAST(NULL AS VARCHAR) AS description, CAST(0 AS INTEGER) AS n_keywords, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(pages(spark, sf_dir)).select("page_id", metadata.metadata("html").alias("m"))
    return found.select("page_id", "m.title", "m.description", F.size("m.keywords").alias("n_keywords"), "m.charset")


@query(f"SELECT page_id, {_TITLE} AS title, regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1) AS charset FROM pages")
def page_metadata_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = parse_pages(spread(pages(spark, sf_dir)), want=["tag", "attrs", "text"], tags=["meta", "link", "title"])
    return metadata.metadata_from_nodes(nodes).select("page_id", "title", "charset")


@query(f"SELECT page_id, CASE WHEN {_TITLE} = '' THEN 'No significant metadata found.' ELSE 'Title: ' || {_TITLE} END AS summary FROM pages")
def page_summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(pages(spark, sf_dir)).select("page_id", metadata.metadata("html").alias("m"))
    return found.select("page_id", metadata.summary("m").alias("summary"))


@query(f"SELECT url, CAST(200 AS INTEGER) AS status_code, {_TITLE} AS title, CAST(length(html) AS INTEGER) AS html_length, {_decoded("regexp_extract(html, '<h1>([^<]*)</h1>', 1)")} AS selected FROM pages")
def tool_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = convert.page_summary(spread(pages(spark, sf_dir)), selector="h1::text")
    return found.select("url", "status_code", "title", "html_length", F.get("selected", 0).alias("selected"))


def _fixture(spark: SparkSession) -> DataFrame:
    rows = [
        (1, "https://s.example/l?p=1", '<head><link rel="next" href="/l?p=2"></head><body><a class="next" href="/other">Next</a></body>'),
        (2, "https://s.example/l", '<a class="pg-next" href="?p=2">more</a>'),
        (3, "https://s.example/l", '<a href="/x">back</a><a href="/y">Weiter</a>'),
        (4, "https://s.example/l", '<div class="pagination"><a href="/l">1</a><span class="current">2</span><a href="/l3">3</a><a href="/l3">3</a></div>'),
        (5, "https://s.example/l", "<p>nothing</p>"),
        (6, "https://s.example/p", '<script type="application/ld+json">{"@type":"Product","name":"A"}</script><script type="application/ld+json">[{"@type":"Offer"},{"@type":"NewsArticle"}]</script><script type="application/ld+json">{bad</script>'),
        (7, "https://s.example/m", '<div itemscope itemtype="https://schema.org/Person"><span itemprop="name">Ann</span><img itemprop="image" src="/a.png"><meta itemprop="age" content="7"></div>'),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'https://s.example/l?p=2'), (2, 'https://s.example/l?p=2'), (3, 'https://s.example/y'), (4, 'https://s.example/l3'), (5, NULL), (6, NULL), (7, NULL)) t(page_id, next_page)")
def next_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark).select("page_id", pagination.next_page().alias("next_page"))


_NEXT = ", ".join(f"min_by(href, seq) FILTER (contains(lower({_decoded('anchor')}), '{w}'))" for w in pagination.WORDS)


@query(
    f"""WITH l AS (SELECT h.page_id, h.seq, {_decoded('h.href')} AS href, a.anchor FROM ({_LINKS}) h JOIN ({_ANCHORS}) a ON a.page_id = h.page_id AND a.seq = h.seq),
    n AS (SELECT page_id, coalesce({_NEXT}) AS href FROM l GROUP BY 1)
    SELECT p.page_id, regexp_extract(p.url, '^([a-z]+://[^/?#]+)', 1) || n.href AS next_page FROM pages p LEFT JOIN n ON n.page_id = p.page_id"""
)
def next_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the page corpus only the third tier, words in link texts, can give an address."""
    return spread(pages(spark, sf_dir)).select("page_id", pagination.next_page().alias("next_page"))


@query("SELECT * FROM (VALUES (CAST(4 AS BIGINT), 'https://s.example/l3')) t(page_id, link)")
def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark).select("page_id", F.explode(pagination.all_pages()).alias("link"))


@query("SELECT * FROM (VALUES (CAST(6 AS BIGINT), 'json-ld', 'Product'), (6, 'json-ld', 'Offer'), (6, 'json-ld', 'NewsArticle'), (7, 'microdata', 'https://schema.org/Person')) t(page_id, source, type)")
def structured_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.items(_fixture(spark)).select("page_id", "source", "type")


@query("SELECT * FROM (VALUES (CAST(6 AS BIGINT), 'NewsArticle')) t(page_id, type)")
def find_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.find_by_type(structured.items(_fixture(spark)), "article").select("page_id", "type")


@query("SELECT * FROM (VALUES (CAST(7 AS BIGINT), 'Ann', '/a.png', '7')) t(page_id, name, image, age)")
def microdata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _fixture(spark).select("page_id", F.explode(structured.microdata()).alias("m"))
    return m.select("page_id", *[F.element_at("m.properties", k).alias(k) for k in ("name", "image", "age")])


@query("SELECT page_id, CAST(length(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) > 0 AS BOOLEAN) AS has_heading FROM pages")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page has an underlined heading in Markdown exactly if its h1 holds text."""
    found = spread(pages(spark, sf_dir)).select("page_id", F.get(convert.content("html", "markdown", selector="h1"), 0).alias("md"))
    return found.select("page_id", F.rlike("md", F.lit("\n=+$")).alias("has_heading"))


# ---- F: crawl

_ORDER_URL = "'https://h' || (o_custkey % 5) || '.example/c/' || o_custkey"


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    url = F.concat(F.lit("https://h"), (F.col("o_custkey") % 5).cast("string"), F.lit(".example/c/"), F.col("o_custkey").cast("string"))
    return frontier.requests(o.select(url.alias("url"), F.col("o_orderkey").alias("seq"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority")))


@query(f"SELECT {_ORDER_URL} AS url, min(o_orderkey) AS seq FROM orders GROUP BY 1")
def frontier_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, _ = frontier.enqueue(_requests(spark, sf_dir))
    return accepted.select("url", "seq")


@query(f"SELECT {_ORDER_URL} AS url, min(o_orderkey) AS seq FROM orders GROUP BY 1 HAVING min(o_orderkey) NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 3 = 0) AND bool_and(o_custkey % 3 <> 0)")
def seen_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    reqs = frontier.identify(_requests(spark, sf_dir))
    seen = reqs.where((F.substring_index("url", "/", -1).cast("long") % 3) == 0).select("fp").distinct()
    accepted, _ = frontier.enqueue(reqs, seen)
    return accepted.select("url", "seq")


@query("SELECT o_orderkey AS seq, CAST(row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY CAST(o_orderpriority[1] AS INTEGER) DESC, o_orderkey) AS INTEGER) AS place FROM orders")
def frontier_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    r = _requests(spark, sf_dir)
    place = F.row_number().over(W.partitionBy(urls.domain("url")).orderBy(F.desc("priority"), "seq"))
    return r.select("seq", place.alias("place"))


@query("SELECT o_orderkey AS seq, CAST(o_orderpriority[1] AS INTEGER) AS priority FROM orders ORDER BY 2 DESC, 1 LIMIT 50")
def frontier_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.dequeue(_requests(spark, sf_dir), 50).select("seq", "priority")


@query("SELECT CAST(o_custkey % 5 IN (1, 2) AS BOOLEAN) AS allowed, count(*) AS n FROM orders GROUP BY 1")
def offsite_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = policy.allowed(_requests(spark, sf_dir), ["h1.example", "h2.example"])
    return marked.groupBy("allowed").agg(F.count("*").alias("n"))


@query("SELECT o_custkey % 5 AS host, o_orderkey AS seq FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey % 5 ORDER BY CAST(o_orderpriority[1] AS INTEGER) DESC, o_orderkey) AS k FROM orders) WHERE k <= 10")
def domain_wave_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    wave = frontier.next_wave(_requests(spark, sf_dir), per_domain=10)
    return wave.select(F.substring(urls.domain("url"), 2, 1).cast("long").alias("host"), "seq")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as responses: the status follows from the key."""
    status = F.get(F.array(*[F.lit(s) for s in (200, 200, 404, 429, 503, 301, 200)]), (F.col("seq") % 7).cast("int"))
    return _requests(spark, sf_dir).withColumn("status", status)


_STATUS = "[200, 200, 404, 429, 503, 301, 200][1 + CAST(o_orderkey % 7 AS INTEGER)]"


@query(f"SELECT o_orderkey AS seq, CAST(o_orderpriority[1] AS INTEGER) - 1 AS priority, CAST(1 AS INTEGER) AS retry_count FROM orders WHERE {_STATUS} IN (429, 503)")
def blocked_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.retries(_responses(spark, sf_dir)).select("seq", "priority", "retry_count")


@query(f"SELECT 'status_' || {_STATUS} AS key, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _responses(spark, sf_dir).select("sid", "status", urls.domain("url").alias("domain"), F.lit(1).cast("long").alias("bytes"))
    return stats.by_key(log).where("kind = 'status'").select("key", F.col("value").alias("n"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT {h} AS domain, count(*) AS requests, CAST(sum(strlen(html)) AS BIGINT) AS bytes FROM pages GROUP BY ROLLUP (1)".replace("{h}", _HOST).replace("ROLLUP (1)", f"ROLLUP ({_HOST})"))
def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtotals by domain and in all (an extension)."""
    log = pages(spark, sf_dir).select(urls.domain("url").alias("domain"), F.octet_length("html").cast("long").alias("bytes"))
    return log.rollup("domain").agg(F.count("*").alias("requests"), F.sum("bytes").alias("bytes"))


@query(f"SELECT regexp_extract(p.url, '^([a-z]+://[^/?#]+)', 1) || {_decoded('l.href')} AS abs_url, count(*) AS in_degree FROM ({_LINKS}) l JOIN pages p ON p.page_id = l.page_id GROUP BY 1")
def link_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(pages(spark, sf_dir)).select("url", F.explode(select("html", h="nav a::attr(href)").getField("h")).alias("href"))
    return found.groupBy(urls.absolute("url", "href").alias("abs_url")).agg(F.count("*").alias("in_degree"))


_BFS = """
WITH RECURSIVE reach(node, depth) AS (
  SELECT CAST(1 AS BIGINT), 0
  UNION ALL
  SELECT e.dst, r.depth + 1 FROM reach r JOIN (SELECT DISTINCT o_custkey % 40 AS src, (o_custkey * 3 + 1) % 40 AS dst FROM orders) e ON e.src = r.node WHERE r.depth < 5
) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM reach GROUP BY node
"""


@query(_BFS)
def bfs_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(_BFS)


@query("SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'main' ELSE 'alt' END AS sid, count(*) AS n, CAST(true AS BOOLEAN) AS known FROM orders GROUP BY 1")
def session_default_sid(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = policy.sessions(spark, [("main", "corpus"), ("alt", "corpus")])
    named = _requests(spark, sf_dir).withColumn("sid", F.when(F.col("seq") % 2 == 0, "").otherwise("alt"))
    return policy.with_session(named, s).groupBy("sid", "known").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS seq, ['p0', 'p1', 'p2'][1 + CAST(o_orderkey % 3 AS INTEGER)] AS proxy FROM orders")
def proxy_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.rotate(_requests(spark, sf_dir), ["p0", "p1", "p2"]).select("seq", "proxy")


@query("SELECT user_id % 4 AS proxy, count(*) AS uses, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY 1")
def proxy_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select((F.col("user_id") % 4).alias("proxy"), "ts", (F.col("event_type") != "error").alias("ok"))
    return policy.proxy_state(log).select("proxy", "uses", "failures")


@query("SELECT r.r_name AS resource_type, n.n_name AS host, CAST(r.r_name = 'ASIA' OR n.n_name = 'FRANCE' AS BOOLEAN) AS blocked FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey")
def resource_blocking(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    named = log.select(F.col("r_name").alias("resource_type"), F.col("n_name").alias("host"))
    return named.withColumn("blocked", http.is_blocked_resource("resource_type", "host", types=("ASIA",), domains=("FRANCE",)))


@query("SELECT level, count(*) AS n FROM (SELECT event_type AS level FROM events) GROUP BY 1")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.log_levels(table(spark, sf_dir, "events").select(F.col("event_type").alias("level")))


# ---- G: time windows (extensions)

@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.windowed(table(spark, sf_dir, "events"), "event_type", size="1 hour", n=F.count("*")).select("start", "event_type", "n")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOURS THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k"""
)
def events_sessionised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.sessions(table(spark, sf_dir, "events"), "user_id").select("user_id", "start", "n")


@query("SELECT event_type, CAST(user_id % 3 AS VARCHAR) AS bucket, count(*) AS n FROM events GROUP BY ROLLUP (event_type, CAST(user_id % 3 AS VARCHAR))")
def events_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 3).cast("string").alias("bucket"))
    return e.rollup("event_type", "bucket").agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def events_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query("SELECT page_id, CAST(count(*) AS BIGINT) AS texts FROM (SELECT page_id, unnest([x FOR x IN regexp_split_to_array(regexp_replace(regexp_replace(html, '<!DOCTYPE html>|<!--.*?-->', '', 'gs'), '<script>.*?</script>', '<s>x</s>', 'gs'), '<[^>]*>') IF trim(x) <> '']) AS x FROM pages) GROUP BY 1")
def text_node_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_nodes(spread(pages(spark, sf_dir))).groupBy("page_id").agg(F.count("*").alias("texts"))


# ---- H: more of the same, for operators that the groups above do not reach

@query(
    """SELECT n_nationkey, lower(n_name) AS folded, repeat('*', (30 - length(n_name)) // 2) || n_name || repeat('*', 30 - length(n_name) - (30 - length(n_name)) // 2) AS centred,
    repeat(' ', 8) || n_name AS tabs, n_name AS stripped, n_name || ' ' AS left_stripped, rtrim(n_name, '12') AS right_stripped, upper(left(n_name, 1)) || lower(substr(n_name, 2)) AS titled,
    CAST(3 AS INTEGER) AS pieces, n_name || '-x' AS joined, contains(lower(n_name), 'nation_1') AS has, replace(replace(n_name, 'N', ''), 'A', 'aa') AS mapped, '7' || n_name AS formatted FROM nation"""
)
def string_methods_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("n_name")
    padded = F.concat(F.lit(" \t"), c, F.lit(" "))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey",
        text.casefold(c).alias("folded"),
        text.center(c, 30, "*").alias("centred"),
        text.expandtabs(F.concat(F.lit("\t"), c)).alias("tabs"),
        text.strip(padded).alias("stripped"),
        text.lstrip(padded).alias("left_stripped"),
        text.rstrip(c, "12").alias("right_stripped"),
        text.title(c).alias("titled"),
        F.size(text.split(F.concat(F.lit("a  b "), c))).alias("pieces"),
        text.join("-", F.array(c, F.lit("x"))).alias("joined"),
        text.contains(c, "Nation_1", case_sensitive=False).alias("has"),
        text.translate_map(c, {65: "aa", 78: None}).alias("mapped"),
        text.format_text(F.concat(F.lit("{x}"), c), x="7").alias("formatted"),
    )


_HREFS = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\"', 1)"


@query(f"""WITH l AS (SELECT page_id, {_HREFS} AS h FROM pages)
    SELECT page_id, {_decoded('h[1]')} AS first_href, {_decoded('h[len(h)]')} AS last_href, CAST(len(h) AS INTEGER) AS n, CAST(len(regexp_extract_all(array_to_string(h, ' '), '/')) AS INTEGER) AS slashes FROM l""")
def text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = strings(spark, sf_dir, h="nav li > a::attr(href)")
    return found.select("page_id", text.get("h").alias("first_href"), text.last("h").alias("last_href"), text.length("h").alias("n"), F.size(text.re_each("h", "/")).alias("slashes"))


@query(r"""SELECT n_regionkey, CASE WHEN count(*) = 1 THEN 'item\ ' || min(chr(CAST(65 + n_nationkey AS INTEGER))) || '\ end' ELSE '^item\ .*?\ end$' END AS regex FROM nation GROUP BY 1""")
def regex_induced_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neither equal nor of one shape: what the examples share at both ends."""
    example = F.concat(F.lit("item "), F.char((F.col("n_nationkey") + 65).cast("long")), F.lit(" end"))
    return induce.induce_by(table(spark, sf_dir, "nation").select("n_regionkey", example.alias("s")), "n_regionkey", "s")


@query("SELECT page_id, replace(replace(replace(regexp_extract(html, '<h1>[^<]*</h1>'), '&copy;', '©'), '&middot;', '·'), '&quot;', '\"') AS markup FROM pages WHERE contains(html, '<h1>')")
def h1_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spread(pages(spark, sf_dir)).select("page_id", convert.content("html", "html", selector="h1").alias("c"))
    return found.select("page_id", F.get("c", 0).alias("markup")).where("markup <> ''")


# Worked out by hand.  The checks are tag, text, attributes, class, path, parent's tag, parent's attributes:
# seven in all, and each row changes one or two of them.
@query("SELECT id, CAST(score AS DOUBLE) AS score FROM (VALUES (1, 100.0), (2, 96.43), (3, 85.71), (4, 85.71), (5, 85.71)) t(id, score)")
def similarity_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 the same; 2 three of four letters of the text; 3 no text; 4 the parent, bare before, gains an attribute; 5 another class, half alike."""
    rows = [(1, '<div><p class="abcd">wxyz</p></div>'), (2, '<div><p class="abcd">wxya</p></div>'), (3, '<div><p class="abcd"></p></div>'), (4, '<div id="k"><p class="abcd">wxyz</p></div>'), (5, '<div><p class="abxx">wxyz</p></div>')]
    found = similarity.fingerprints(spark.createDataFrame(rows, "id int, html string"), "p", page_id="id")
    stored = found.where("page_id = 1").select(F.col("fingerprint").alias("stored"))
    return found.join(F.broadcast(stored)).select(F.col("page_id").alias("id"), similarity.score_pairs("stored", "fingerprint").alias("score"))


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), false, 'new'), (2, true, 'old')) t(page_id, relocated, price)")
def adaptive_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selector's match where it has one, else the element most like the saved one."""
    rows = [(1, "s", '<div><i>x</i><p id="cost" class="price">new</p></div>'), (2, "s", '<main><i>x</i><p id="sum" class="price">old</p><b>y</b></main>')]
    p = spark.createDataFrame(rows, "page_id long, site string, html string")
    saved = store.auto_save(similarity.fingerprints(p, "#cost"), F.lit("s"), "#cost")
    places = similarity.adaptive_select(p, "#cost", saved)
    return places.join(parse_pages(p, want=["text"]), ["page_id", "pre"]).select("page_id", "relocated", F.col("text").alias("price"))


@query("SELECT o_custkey % 50 AS site, o_custkey % 3 AS identifier, max(o_orderkey) AS version, max_by(o_totalprice, o_orderkey) AS price, min(o_orderkey) AS created FROM orders GROUP BY 1, 2")
def store_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("site"), (F.col("o_custkey") % 3).alias("identifier"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("price"))
    return store.latest(saved)


@query("SELECT n_nationkey, n_nationkey % 3 = 2 AS kept FROM nation")
def items_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("n_nationkey") % 3
    item = F.when(kind == 1, F.array().cast("array<string>")).when(kind == 2, F.array("n_name"))
    kept, dropped = policy.keep_items(table(spark, sf_dir, "nation"), item)
    return kept.select("n_nationkey", F.lit(True).alias("kept")).unionAll(dropped.select("n_nationkey", F.lit(False)))


@query(
    """SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'http://h' || n_nationkey || '.example:80' END AS server, CASE WHEN n_nationkey % 2 = 0 THEN 'u' || n_nationkey END AS username,
    CASE WHEN n_nationkey % 2 = 0 THEN 'p:' || n_nationkey END AS password, CASE WHEN n_nationkey % 2 = 0 THEN 'iso-8859-' || n_nationkey ELSE 'utf-8' END AS charset FROM nation"""
)
def proxy_and_charset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of proxies taken apart (null for a scheme that is none of a proxy's), and declared encodings."""
    key, even = F.col("n_nationkey").cast("string"), F.col("n_nationkey") % 2 == 0
    rest = F.concat(F.lit("://u"), key, F.lit(":p:"), key, F.lit("@h"), key, F.lit(".example:80"))
    address = F.concat(F.when(even, "http").otherwise("ftp"), rest)
    kind = F.when(even, F.concat(F.lit("text/html; charset=iso-8859-"), key)).otherwise("text/html")
    return table(spark, sf_dir, "nation").select("n_nationkey", http.proxy_parts(address).alias("p"), http.charset_of(kind).alias("charset")).select("n_nationkey", "p.server", "p.username", "p.password", "charset")


@query("SELECT * FROM (VALUES (1, '1'), (2, '2'), (3, '3'), (4, NULL)) t(id, a)")
def json_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON of the raw body, of its leading text, of all its text; null where none parses."""
    rows = [(1, '{"a": 1}'), (2, '<body>{"a": 2}<p>x</p></body>'), (3, '<body><p>{"a":</p><p>3}</p></body>'), (4, "<p>no</p>")]
    found = spark.createDataFrame(rows, "id int, html string").select("id", convert.page_json().alias("v"))
    return found.select("id", F.try_variant_get("v", "$.a", "string").alias("a"))
