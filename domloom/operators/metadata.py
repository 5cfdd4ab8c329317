"""Page metadata: titles, descriptions, social cards, technical fields, and summaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom import schemas
from domloom.dom.tree import Tree
from domloom.sources.pages import per_page

# Fields and the meta elements they come from.
BY_NAME = {"description": "description", "author": "author", "twitter_card": "twitter:card", "twitter_title": "twitter:title", "twitter_description": "twitter:description", "twitter_image": "twitter:image", "robots": "robots", "viewport": "viewport"}
BY_PROPERTY = {"og_title": "og:title", "og_description": "og:description", "og_image": "og:image", "og_type": "og:type", "og_site_name": "og:site_name"}
FIELDS = ("title", "description", "keywords", "author", "canonical_url", *BY_PROPERTY, "twitter_card", "twitter_title", "twitter_description", "twitter_image", "robots", "viewport", "charset")
NOTHING = "No significant metadata found."

TYPE = pa.struct([(f, pa.list_(pa.string()) if f == "keywords" else pa.string()) for f in FIELDS])


def metadata_in(tree: Tree) -> dict:
    metas = tree.by_tag.get("meta", ())

    def meta(key: str, name: str) -> str | None:
        for i in metas:
            if tree.attr(i, key) == name and tree.attr(i, "content") is not None:
                return tree.attr(i, "content").strip() or None
        return None

    title = next((tree.text[i] for i in tree.by_tag.get("title", ()) if tree.text[i]), None) or meta("name", "title")
    words = meta("name", "keywords")
    out = {f: meta("name", n) for f, n in BY_NAME.items()} | {f: meta("property", n) for f, n in BY_PROPERTY.items()}
    out["title"] = title
    out["keywords"] = [w.strip() for w in words.split(",")] if words else []
    out["canonical_url"] = next((h for i in tree.by_tag.get("link", ()) if tree.attr(i, "rel") == "canonical" and (h := tree.attr(i, "href")) is not None), None)
    out["charset"] = next((c for i in metas if (c := tree.attr(i, "charset")) is not None), None)
    return out


def metadata(html: str | Column = "html") -> Column:
    """All fields as one struct."""
    return per_page(lambda tree, _: metadata_in(tree), TYPE, schemas.METADATA, html)


def summary(m: Column | str) -> Column:
    """Lines of title, description, type and site, or a fixed sentence, of a metadata struct."""
    m = F.col(m) if isinstance(m, str) else m
    line = lambda label, f: F.when(F.coalesce(m[f], F.lit("")) != "", F.concat(F.lit(f"{label}: "), m[f]))
    text = F.concat_ws("\n", line("Title", "title"), line("Description", "description"), line("Type", "og_type"), line("Site", "og_site_name"))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NOTHING))


def metadata_from_nodes(nodes: DataFrame) -> DataFrame:
    """The same fields as columns, from the node table: one conditional aggregation a page, combined before the shuffle."""
    content = F.nullif(F.trim(F.element_at("attrs", "content")), F.lit(""))
    is_meta = F.col("tag") == "meta"

    def first(value: Column, test: Column) -> Column:
        return F.min_by(F.when(test, value), F.when(test & value.isNotNull(), F.col("pre")))

    by = lambda key, name: first(content, is_meta & (F.element_at("attrs", key) == name))
    cols = {f: by("name", n) for f, n in BY_NAME.items()} | {f: by("property", n) for f, n in BY_PROPERTY.items()}
    cols["title"] = F.coalesce(first(F.nullif("text", F.lit("")), F.col("tag") == "title"), by("name", "title"))
    cols["keywords"] = F.coalesce(F.transform(F.split(by("name", "keywords"), ","), lambda s: F.trim(s)), F.array().cast("array<string>"))
    cols["canonical_url"] = first(F.element_at("attrs", "href"), (F.col("tag") == "link") & (F.element_at("attrs", "rel") == "canonical"))
    cols["charset"] = first(F.element_at("attrs", "charset"), is_meta)
    some = nodes.select("page_id", "pre", "tag", "attrs", F.when(F.col("tag") == "title", F.col("text")).alias("text"))
    return some.groupBy("page_id").agg(*[cols[f].alias(f) for f in FIELDS])
