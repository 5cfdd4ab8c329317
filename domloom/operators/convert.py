"""Page content as Markdown, HTML or text, and page summaries."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom.dom.serialize import markdown, outer_html
from domloom.dom.tree import Tree
from domloom.selection.api import compiled
from domloom.sources.pages import per_page

NOISE = frozenset(("script", "style", "noscript", "svg"))
KINDS = {"md": "markdown", "html": "html", "txt": "text"}
TEXT_CAP, SUMMARY_CAP = 50_000, 5_000


def without(tree: Tree, tags: frozenset[str]) -> Tree:
    """A copy without the subtrees of these tags; their tails move to what stands before them."""
    out, number, k = Tree(), {}, 0
    n = len(tree)
    while k < n:
        p = number.get(tree.parent[k], -1)
        if tree.tag[k] in tags:
            if tree.tail[k] and p >= 0:
                last = next((i for i in range(len(out) - 1, p, -1) if out.parent[i] == p), None)
                at, held = (last, out.tail) if last is not None else (p, out.text)
                held[at] = (held[at] or "") + tree.tail[k]
            k = tree.end[k] + 1
            continue
        number[k] = len(out)
        for name in ("tag", "level", "names", "values", "text", "tail"):
            getattr(out, name).append(getattr(tree, name)[k])
        out.parent.append(p)
        out.end.append(len(out) - 1)
        k += 1
    for i in range(len(out) - 1, 0, -1):
        p = out.parent[i]
        out.end[p] = max(out.end[p], out.end[i])
    return out


def content_in(tree: Tree, kind: str = "markdown", selector: str | None = None, main_content_only: bool = False) -> list[str]:
    """One text for the page or for each match, and a last empty one."""
    if kind not in KINDS.values():
        raise ValueError(f"unknown kind of content: {kind}")
    root = 0
    if main_content_only:
        tree = without(tree, NOISE)
        root = next(iter(tree.by_tag.get("body", ())), 0)
    roots = [i for i, v in compiled(selector).nodes(tree, root) if v is None] if selector else [root]
    out = []
    for i in roots:
        if kind == "text":
            text = tree.all_text(i, strip=True, ignore=("script", "style", "noscript", "svg", "iframe"))
            for blank in "\n\r\t ":
                text = re.sub(f"[{blank}]+", blank, text)
            out.append(text)
        else:
            out.append(outer_html(tree, i) if kind == "html" else markdown(tree, i))
    return [*out, ""]


def content(html: str | Column = "html", kind: str = "markdown", *, selector: str | None = None, main_content_only: bool = False) -> Column:
    """ARRAY<STRING> of the content; the kind is checked at once."""
    if kind not in KINDS.values():
        raise ValueError(f"unknown kind of content: {kind}")
    if selector:
        compiled(selector)
    return per_page(lambda tree, _: content_in(tree, kind, selector, main_content_only), pa.list_(pa.string()), "array<string>", html)


def all_text(html: str | Column = "html", *, separator: str = "\n", strip: bool = False, ignore: tuple[str, ...] = ("script", "style"), valid: bool = True, selector: str | None = None) -> Column:
    """All descendant text of the page, or ARRAY<STRING> of it for each match of a selector."""
    if not selector:
        return per_page(lambda tree, _: tree.all_text(0, separator, strip, ignore, valid), pa.string(), "string", html)
    plan = compiled(selector)
    return per_page(lambda tree, _: [tree.all_text(i, separator, strip, ignore, valid) for i, v in plan.nodes(tree) if v is None], pa.list_(pa.string()), "array<string>", html)


def page_json(html: str | Column = "html") -> Column:
    """The page as VARIANT: its raw body, else its leading text, else all its text."""
    texts = per_page(lambda tree, _: [tree.text[next(iter(tree.by_tag.get("body", ())), 0)] or "", tree.all_text(0)], pa.list_(pa.string()), "array<string>", html)
    raw = F.col(html) if isinstance(html, str) else html
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(F.get(texts, 0)), F.try_parse_json(F.get(texts, 1)))


def page_summary(pages: DataFrame, *, selector: str | None = None, text_cap: int = SUMMARY_CAP) -> DataFrame:
    """(url, status_code, title, text, selected, html_length, elapsed_ms, error) of each page; a missing page is an error row."""
    plan = compiled(selector) if selector else None
    kind = pa.struct([("title", pa.string()), ("text", pa.string()), ("selected", pa.list_(pa.string()))])

    def run(tree: Tree, _: dict) -> dict:
        title = next((tree.text[i] for i in tree.by_tag.get("title", ()) if tree.text[i]), "")
        chosen = [tree.all_text(i, strip=True) if v is None else v for i, v in plan.nodes(tree)] if plan else []
        return {"title": title, "text": tree.all_text(0, strip=True)[:TEXT_CAP], "selected": chosen}

    found = pages.withColumn("_s", per_page(run, kind, "struct<title:string,text:string,selected:array<string>>"))
    optional = lambda c, kind: F.col(c).cast(kind) if c in pages.columns else F.lit(None).cast(kind)
    missing = F.when(F.col("html").isNull(), F.lit("no content"))
    return found.select(
        "url",
        F.coalesce(optional("status", "int"), F.when(F.col("html").isNotNull(), 200).otherwise(0)).alias("status_code"),
        F.col("_s.title").alias("title"),
        F.left("_s.text", F.lit(text_cap)).alias("text"),
        F.col("_s.selected").alias("selected"),
        F.coalesce(F.length("html"), F.lit(0)).alias("html_length"),
        F.coalesce(optional("elapsed_ms", "double"), F.lit(0.0)).alias("elapsed_ms"),
        F.coalesce(optional("error", "string"), missing).alias("error"),
    )


def as_response_model(pages: DataFrame, kind: str = "markdown", **options) -> DataFrame:
    """(status, content ARRAY<STRING>, url)."""
    status = F.col("status").cast("int") if "status" in pages.columns else F.lit(200)
    return pages.select(status.alias("status"), content("html", kind, **options).alias("content"), "url")
