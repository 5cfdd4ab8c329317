"""Element fingerprints, similarity scores, relocation and look-alikes.

``ratio`` is difflib's matching ratio, which is not symmetric: the stored element
always comes first.  Scores therefore run in Python workers, in Arrow batches, on the
candidates that equi-joins leave; everything around them is a join or an aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domloom import schemas
from domloom.dom.tree import Tree


def ratio(a: Sequence, b: Sequence) -> float:
    return SequenceMatcher(None, a, b).ratio()


def fingerprint_of(tree: Tree, i: int) -> dict:
    """What a redesign is likely to keep of an element; optional fields are None when empty."""
    kept = [(n, v.strip()) for n, v in zip(tree.names[i], tree.values[i], strict=True) if v and v.strip()]
    p = tree.parent[i]
    kids = tree.children[p] if p >= 0 else []
    return {
        "tag": tree.tag[i],
        "attr_names": [n for n, _ in kept],
        "attr_values": [v for _, v in kept],
        "text": (tree.text[i] or "").strip() or None,
        "path": tree.path(i),
        "parent_name": tree.tag[p] if p >= 0 else None,
        "parent_attr_names": list(tree.names[p]) if p >= 0 else None,
        "parent_attr_values": list(tree.values[p]) if p >= 0 else None,
        "parent_text": (tree.text[p] or "").strip() or None if p >= 0 else None,
        "siblings": [tree.tag[k] for k in kids if k != i] or None,
        "children": [tree.tag[k] for k in tree.children[i]] or None,
    }


_STRINGS = pa.list_(pa.string())
FINGERPRINT_TYPE = pa.struct(
    [("tag", pa.string()), ("attr_names", _STRINGS), ("attr_values", _STRINGS), ("text", pa.string()), ("path", _STRINGS), ("parent_name", pa.string())]
    + [("parent_attr_names", _STRINGS), ("parent_attr_values", _STRINGS), ("parent_text", pa.string()), ("siblings", _STRINGS), ("children", _STRINGS)]
)


def _pair_ratio(names_a: list, values_a: list, names_b: list, values_b: list) -> float:
    return 0.5 * ratio(names_a, names_b) + 0.5 * ratio(values_a, values_b)


def similarity(stored: dict, found: dict) -> float:
    """Mean of the checks that apply, in per cent, to two places."""
    checks = [float(stored["tag"] == found["tag"])]
    if stored["text"]:
        checks.append(ratio(stored["text"], found["text"] or ""))
    checks.append(_pair_ratio(stored["attr_names"], stored["attr_values"], found["attr_names"], found["attr_values"]))
    mine, theirs = (dict(zip(f["attr_names"], f["attr_values"], strict=True)) for f in (stored, found))
    checks += [ratio(mine[a], theirs.get(a, "")) for a in ("class", "id", "href", "src") if mine.get(a)]
    checks.append(ratio(stored["path"], found["path"]))
    if stored["parent_name"] and found["parent_name"]:
        checks.append(ratio(stored["parent_name"], found["parent_name"]))
        checks.append(_pair_ratio(stored["parent_attr_names"] or [], stored["parent_attr_values"] or [], found["parent_attr_names"] or [], found["parent_attr_values"] or []))
        if stored["parent_text"]:
            checks.append(ratio(stored["parent_text"], found["parent_text"] or ""))
    if stored["siblings"]:
        checks.append(ratio(stored["siblings"], found["siblings"] or []))
    return round(sum(checks) / len(checks) * 100, 2)


def fingerprints(pages: DataFrame, selector: str, *, page_id: str = "page_id", html: str = "html", first: bool = True) -> DataFrame:
    """(page_id, pre, fingerprint) of the selector's matches, of the first one of each page by default."""
    from domloom.selection.api import compiled
    from domloom.sources.pages import per_page

    plan = compiled(selector)
    kind = pa.list_(pa.struct([("pre", pa.int32()), ("fingerprint", FINGERPRINT_TYPE)]))

    def run(tree: Tree, _: dict) -> list[dict]:
        nodes = list(dict.fromkeys(i for i, _ in plan.nodes(tree)))
        return [{"pre": i, "fingerprint": fingerprint_of(tree, i)} for i in (nodes[:1] if first else nodes)]

    made = per_page(run, kind, f"array<struct<pre:int,fingerprint:{schemas.FINGERPRINT}>>", html)
    return pages.select(F.col(page_id).alias("page_id"), F.explode(made).alias("f")).select("page_id", "f.pre", "f.fingerprint")


def relocate_in(tree: Tree, stored: dict, percentage: float = 0) -> list[tuple[int, float]]:
    """All elements that share the best score, if it reaches the percentage."""
    best, out = -1.0, []
    for i in range(len(tree)):
        if tree.tag[i] == "#comment":
            continue
        score = similarity(stored, fingerprint_of(tree, i))
        if score > best:
            best, out = score, []
        if score == best:
            out.append((i, score))
    return out if best >= percentage else []


def relocate(pages: DataFrame, store: DataFrame, identifier: str | None = None, *, percentage: float = 0, site: str = "site", page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, identifier, pre, score): where the store's elements of a page's site are now.

    The store holds few rows a site and joins by site; with broadcast it is up to the
    planner, by its measured size.  Each page is parsed once for each of its site's elements.
    """
    want = store if identifier is None else store.where(F.col("identifier") == identifier)
    joined = pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html"), F.col(site).alias("site")).join(want.select("site", "identifier", "fingerprint"), "site")
    kind = pa.list_(pa.struct([("pre", pa.int32()), ("score", pa.float64())]))

    def run(html: pa.Array, stored: pa.Array) -> pa.Array:
        from domloom.sources.pages import tree_of

        return pa.array([[{"pre": i, "score": s} for i, s in relocate_in(tree_of(h), f, percentage)] for h, f in zip(html.to_pylist(), stored.to_pylist(), strict=True)], kind)

    run.__annotations__ = {"html": pa.Array, "stored": pa.Array, "return": pa.Array}
    hits = F.arrow_udf(run, "array<struct<pre:int,score:double>>")("html", "fingerprint")
    return joined.select("page_id", "identifier", F.explode(hits).alias("h")).select("page_id", "identifier", "h.pre", "h.score")


def adaptive_select(pages: DataFrame, selector: str, store: DataFrame, *, identifier: str | None = None, percentage: float = 0, site: str = "site") -> DataFrame:
    """(page_id, pre, relocated): matches where the selector has some, relocated elements where it has none."""
    found = fingerprints(pages, selector, first=False).select("page_id", "pre", F.lit(False).alias("relocated"))
    missed = pages.join(found.select("page_id").distinct(), "page_id", "left_anti")
    moved = relocate(missed, store, identifier or selector, percentage=percentage, site=site)
    return found.unionByName(moved.select("page_id", "pre", F.lit(True).alias("relocated")))


# ---- look-alikes

def alike(own: dict[str, str], other: dict[str, str], own_text: str, other_text: str, *, ignore: tuple[str, ...] = ("href", "src"), threshold: float = 0.2, match_text: bool = False) -> bool:
    """Attribute likeness; the sum runs over the element's attributes, the count over the candidate's."""
    a, b = ({k: v for k, v in x.items() if k not in ignore} for x in (own, other))
    score = checks = 0.0
    if a:
        score, checks = sum(ratio(v, b.get(k, "")) for k, v in a.items()), float(len(b))
    elif not b:
        score = checks = 1.0
    if match_text:
        from re import sub

        flat = lambda s: sub(" +", " ", (s or "").translate({9: " ", 10: None, 13: None}))
        score, checks = score + ratio(flat(own_text), flat(other_text)), checks + 1
    return bool(checks) and round(score / checks, 2) >= threshold


def find_similar(nodes: DataFrame, context: DataFrame | Column, *, ignore: tuple[str, ...] = ("href", "src"), threshold: float = 0.2, match_text: bool = False) -> DataFrame:
    """(page_id, c_pre, pre): for each row of context the elements at its depth, with its tag, parent and grandparent tags, and like attributes.

    context is a table of nodes, or a condition on nodes (which saves a join).  With a
    ``path`` column the tags above come from it, else from two joins on page_id.
    Candidates come from one equi-join on (page, depth, the three tags).  Where the
    rows that score have equal attributes (and text does not count) the JVM decides;
    the Python score runs on the rest.
    """
    if "path" in nodes.columns:
        keyed = nodes.withColumns({"p_tag": F.try_element_at("path", F.lit(-2)), "g_tag": F.try_element_at("path", F.lit(-3))})
    else:
        up = nodes.select(F.col("page_id").alias("u_page"), F.col("pre").alias("u_pre"), F.col("tag").alias("p_tag"), F.col("parent").alias("p_parent"))
        top = nodes.select(F.col("page_id").alias("g_page"), F.col("pre").alias("g_pre"), F.col("tag").alias("g_tag"))
        keyed = nodes.join(up, (F.col("page_id") == F.col("u_page")) & (F.col("parent") == F.col("u_pre")), "left").join(top, (F.col("page_id") == F.col("g_page")) & (F.col("p_parent") == F.col("g_pre")), "left")
    keep = lambda c: F.map_filter(c, lambda k, v: ~k.isin(*ignore)) if ignore else c
    shaped = ["page_id", "pre", "level", "tag", F.coalesce("p_tag", F.lit("")).alias("p_tag"), F.coalesce("g_tag", F.lit("")).alias("g_tag"), F.map_entries(keep(F.col("attrs"))).alias("attrs"), F.coalesce("text", F.lit("")).alias("text")]
    keys = ["page_id", "level", "tag", "p_tag", "g_tag"]
    row = keyed.select(*shaped)
    chosen = keyed.where(context).select(*shaped) if isinstance(context, Column) else row.join(context.select("page_id", "pre"), ["page_id", "pre"], "left_semi")
    starts = chosen.select(*keys, F.col("pre").alias("c_pre"), F.col("attrs").alias("c_attrs"), F.col("text").alias("c_text"))
    pairs = starts.join(row, keys).where(F.col("pre") != F.col("c_pre"))
    kind = pa.bool_()

    def run(c_attrs: pa.Array, attrs: pa.Array, c_text: pa.Array, text: pa.Array) -> pa.Array:
        out = []
        for a, b, s, t in zip(c_attrs.to_pylist(), attrs.to_pylist(), c_text.to_pylist(), text.to_pylist(), strict=True):
            x, y = ({e["key"]: e["value"] for e in m} for m in (a, b))
            out.append(alike(x, y, s, t, ignore=(), threshold=threshold, match_text=match_text))
        return pa.array(out, kind)

    run.__annotations__ = dict.fromkeys(("c_attrs", "attrs", "c_text", "text"), pa.Array) | {"return": pa.Array}
    if not match_text and threshold <= 1:
        same = pairs.where(F.col("c_attrs") == F.col("attrs")).select("page_id", "c_pre", "pre")
        other = pairs.where(F.col("c_attrs") != F.col("attrs"))
        return same.unionAll(other.where(F.arrow_udf(run, "boolean")("c_attrs", "attrs", "c_text", "text")).select("page_id", "c_pre", "pre"))
    return pairs.where(F.arrow_udf(run, "boolean")("c_attrs", "attrs", "c_text", "text")).select("page_id", "c_pre", "pre")


# ---- the weighted score of the second store

def dom_path(tree: Tree, i: int) -> str:
    return " > ".join(tree.tag[k] + (f"#{tree.attr(k, 'id')}" if tree.attr(k, "id") else "") for k in reversed([i, *tree.ancestors(i)]))


def weighted_similarity(stored: dict, tag: str, text: str | None, attributes: dict[str, str], path: str) -> float:
    """0.30 for the tag, 0.25 for the first 500 characters of text, 0.25 for attribute names, 0.20 for the path."""
    score = 0.30 if stored.get("tag") and stored["tag"] == tag else 0.0
    own, other = stored.get("text_content") or "", (text or "")[:500]
    score += 0.25 * ratio(own, other) if own or other else 0.0
    a, b = set(stored.get("attributes") or {}), set(attributes)
    score += 0.25 * len(a & b) / len(a | b) if a | b else 0.0
    return score + (0.20 * ratio(stored.get("dom_path") or "", path) if stored.get("dom_path") or path else 0.0)


def best_match(tree: Tree, stored: dict, threshold: float = 0.6) -> tuple[int, float] | None:
    """The first element with the highest weighted score, if that reaches the threshold."""
    scored = [(weighted_similarity(stored, tree.tag[i], tree.text[i], tree.attrs(i), dom_path(tree, i)), -i) for i in range(len(tree)) if tree.tag[i] != "#comment"]
    score, i = max(scored, default=(0.0, 0))
    return (-i, score) if scored and score >= threshold else None


def score_pairs(stored: str | Column, found: str | Column) -> Column:
    """similarity() of two fingerprint columns, as a column."""

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.float64())

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "double")(stored, found)


def ranked(scored: DataFrame, percentage: float = 0) -> DataFrame:
    """Rows of (page_id, identifier, score, ...) that share the best score of their page and identifier."""
    w = W.partitionBy("page_id", "identifier").orderBy(F.desc("score"))
    return scored.where(F.col("score") >= percentage).withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")
