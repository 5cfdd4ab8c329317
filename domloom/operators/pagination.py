"""Links to the next page and to all pages of a list."""

from __future__ import annotations

from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column

from domloom.dom.tree import Tree
from domloom.selection.css import parse_css, select_nodes
from domloom.sources.pages import per_page

# Words and classes that mark a link to the next page, containers of page links, in order of trust.
WORDS = ("next", "siguiente", "proximo", "proxima", "suivant", "weiter", "nächste", "»", ">", "arrow-right", "forward")
MARKS = (".next", ".next-page", ".pg-next", ".arrow-next", '[class*="next"]', '[rel="next"]')
CONTAINERS = (".pagination", ".pager", ".paging", ".page-nav", ".pages", '[class*="pagination"]', '[class*="pager"]', '[class*="paging"]')
CURRENT = '.active, .current, [aria-current="page"]'

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _nodes(tree: Tree, selector: str, context: int = 0) -> list[int]:
    return select_nodes(tree, parse_css(selector), context)


def _hrefs(tree: Tree, nodes: list[int]) -> list[str]:
    return [h for i in nodes if (h := tree.attr(i, "href"))]


def next_page_in(tree: Tree, url: str | None) -> str | None:
    """The first of four tiers that gives an address: rel, class, text, neighbour of the current page."""
    tiers = [lambda: _hrefs(tree, sorted(_nodes(tree, 'link[rel="next"], a[rel="next"]')))]
    tiers += [lambda m=m: _hrefs(tree, _nodes(tree, "a" + m)) for m in MARKS]
    links = [(i, (tree.text[i] or next((tree.tail[c] for c in tree.children[i] if tree.tail[c]), "") or "").translate(_UPPER)) for i in tree.by_tag.get("a", ())]
    tiers += [lambda w=w: _hrefs(tree, [i for i, t in links if w in t]) for w in WORDS]
    tiers.append(lambda: _after_current(tree))
    for tier in tiers:
        if found := tier():
            return urljoin(url or "", found[0])
    return None


def _after_current(tree: Tree) -> list[str]:
    out: list[tuple[int, str]] = []
    for i in _nodes(tree, CURRENT):
        if tree.parent[i] < 0:
            continue
        kids = tree.children[tree.parent[i]]
        after = kids[kids.index(i) + 1 :]
        a = next((k for k in after if tree.tag[k] == "a"), None)
        li = next((k for k in after if tree.tag[k] == "li"), None)
        candidates = ([a] if a is not None else []) + ([k for k in tree.children[li] if tree.tag[k] == "a"] if li is not None else [])
        out += [(k, tree.attr(k, "href")) for k in sorted(candidates) if tree.attr(k, "href")]
        if out:
            break
    return [h for _, h in sorted(out)]


def all_pages_in(tree: Tree, url: str | None) -> list[str]:
    """Distinct addresses of the first container's links, without the page itself, in order."""
    for selector in CONTAINERS:
        if found := _nodes(tree, selector):
            links = [urljoin(url or "", h) for h in _hrefs(tree, _nodes(tree, "a[href]", found[0]))]
            return [u for u in dict.fromkeys(links) if u != url]
    return []


def next_page(html: str | Column = "html", url: str | Column = "url") -> Column:
    return per_page(lambda tree, x: next_page_in(tree, x["url"]), pa.string(), "string", html, url=url)


def all_pages(html: str | Column = "html", url: str | Column = "url") -> Column:
    return per_page(lambda tree, x: all_pages_in(tree, x["url"]), pa.list_(pa.string()), "array<string>", html, url=url)
