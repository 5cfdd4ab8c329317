"""SQL forms: table functions over pages and scalar functions, registered on a session.

    SELECT p.page_id, n.tag FROM pages p, LATERAL dom_nodes(p.html) n WHERE n.tag = 'a'
    SELECT css_all(html, 'nav a::attr(href)') FROM pages
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from domloom.dom.serialize import outer_html
from domloom.functions.url import canonical, join_one, registered_domain
from domloom.selection.api import css, xpath
from domloom.sources.pages import tree_of


class Nodes:
    """One row per element."""

    def eval(self, html: str):
        tree = tree_of(html)
        sib, of_type = tree.place
        for i in range(len(tree)):
            yield i, tree.end[i], tree.level[i], tree.parent[i], tree.tag[i], tree.attrs(i), tree.text[i], tree.tail[i], sib[i], of_type[i]


class Texts:
    """One row per text node, in document order."""

    def eval(self, html: str):
        yield from ((seq, *piece) for seq, piece in enumerate(tree_of(html).pieces(0)))


def _arrow(f, ddl: str, kind: pa.DataType, n: int):
    def one(a: pa.Array) -> pa.Array:
        return pa.array([f(x) for x in a.to_pylist()], kind)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], kind)

    run = one if n == 1 else two
    run.__annotations__ = dict.fromkeys("ab"[:n], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(run, ddl)


def register(spark: SparkSession) -> None:
    nodes = "pre int, end int, level int, parent int, tag string, attrs map<string,string>, text string, tail string, sib int, nth_of_type int"
    spark.udtf.register("dom_nodes", F.udtf(Nodes, returnType=nodes))
    spark.udtf.register("dom_text", F.udtf(Texts, returnType="seq int, owner int, is_tail boolean, text string"))
    strings, many = pa.string(), pa.list_(pa.string())
    spark.udf.register("css_all", _arrow(lambda h, s: css(s).strings(tree_of(h)), "array<string>", many, 2))
    spark.udf.register("css_first", _arrow(lambda h, s: css(s).first(tree_of(h)), "string", strings, 2))
    spark.udf.register("xpath_all", _arrow(lambda h, s: xpath(s).strings(tree_of(h)), "array<string>", many, 2))
    spark.udf.register("html_text", _arrow(lambda h: tree_of(h).all_text(0, strip=True), "string", strings, 1))
    spark.udf.register("html_pretty", _arrow(lambda h: outer_html(tree_of(h), pretty=True), "string", strings, 1))
    spark.udf.register("url_join", _arrow(join_one, "string", strings, 2))
    spark.udf.register("url_canonical", _arrow(lambda u: None if u is None else canonical(u), "string", strings, 1))
    spark.udf.register("url_site", _arrow(registered_domain, "string", strings, 1))
