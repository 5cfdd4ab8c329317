"""Structured data of pages: JSON-LD and microdata.

The worker only finds the elements; JSON is parsed in the JVM into VARIANT.  Malformed
JSON-LD is skipped in ``items`` and listed by ``corrupt``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom.dom.tree import Tree
from domloom.selection.api import css
from domloom.sources.pages import per_page, select

LD = 'script[type="application/ld+json"]::text'


def microdata_in(tree: Tree) -> list[dict]:
    """Every element with itemscope and itemtype; later properties of a name overwrite earlier ones."""
    out = []
    for i in range(len(tree)):
        if "itemscope" not in tree.names[i] or "itemtype" not in tree.names[i]:
            continue
        properties: dict[str, str] = {}
        for k in range(i + 1, tree.end[i] + 1):
            if name := tree.attr(k, "itemprop"):
                value = next((v for v in (tree.attr(k, "content"), tree.attr(k, "src"), tree.attr(k, "href"), tree.text[k]) if v), "")
                properties.pop(name, None)
                properties[name] = value
        out.append({"type": tree.attr(i, "itemtype"), "properties": list(properties.items())})
    return out


def json_ld_texts(html: str | Column = "html") -> Column:
    return select(html, ld=css(LD)).getField("ld")


def json_ld(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, seq, part, item VARIANT): JSON-LD blocks in order, arrays opened by one level."""
    blocks = pages.select(F.col(page_id).alias("page_id"), F.posexplode(json_ld_texts(html)).alias("seq", "text"))
    parsed = blocks.withColumn("v", F.try_parse_json("text")).where("v IS NOT NULL")
    parsed = parsed.withColumn("is_array", F.startswith(F.schema_of_variant("v"), F.lit("ARRAY")))
    single = parsed.where("NOT is_array").select("page_id", "seq", F.lit(0).alias("part"), F.col("v").alias("item"))
    parsed.where("is_array").select("page_id", "seq", "v").createOrReplaceTempView("_domloom_ld")
    opened = pages.sparkSession.sql("SELECT page_id, seq, pos AS part, value AS item FROM _domloom_ld, LATERAL variant_explode(v)")
    return single.unionByName(opened)


def corrupt(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, seq, text) of JSON-LD blocks that are not JSON."""
    blocks = pages.select(F.col(page_id).alias("page_id"), F.posexplode(json_ld_texts(html)).alias("seq", "text"))
    return blocks.where(F.try_parse_json("text").isNull())


def microdata(html: str | Column = "html") -> Column:
    kind = pa.list_(pa.struct([("type", pa.string()), ("properties", pa.map_(pa.string(), pa.string()))]))
    return per_page(lambda tree, _: microdata_in(tree), kind, "array<struct<type:string,properties:map<string,string>>>", html)


def items(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, source, seq, part, type, item): JSON-LD first, then microdata, items as VARIANT."""
    ld = json_ld(pages, page_id=page_id, html=html)
    kind = F.coalesce(F.try_variant_get("item", "$['@type']", "string"), F.try_variant_get("item", "$.type", "string"))
    ld = ld.select("page_id", F.lit("json-ld").alias("source"), "seq", "part", kind.alias("type"), "item")
    micro = pages.select(F.col(page_id).alias("page_id"), F.posexplode(microdata(html)).alias("seq", "m"))
    shaped = F.parse_json(F.to_json(F.struct(F.col("m.type").alias("@type"), F.col("m.properties").alias("properties"))))
    return ld.unionByName(micro.select("page_id", F.lit("microdata").alias("source"), "seq", F.lit(0).alias("part"), F.col("m.type").alias("type"), shaped.alias("item")))


def find_by_type(found: DataFrame, kind: str) -> DataFrame:
    """Items whose type holds the text, whatever the case."""
    return found.where(F.contains(F.lower("type"), F.lit(kind.lower())))
