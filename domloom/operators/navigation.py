"""Axes of the node table and generated selectors.

Each takes nodes (what to navigate in) and, where it differs, context (the rows to
start from; c_pre names the start in the result).  All joins key on page_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domloom.dom.tree import Tree


def _from(context: DataFrame, *columns: str) -> DataFrame:
    return context.select(*[F.col(c).alias(f"c_{c}") for c in ("page_id", *columns)])


def _join(nodes: DataFrame, context: DataFrame, columns: tuple[str, ...], on: Callable[[], Column]) -> DataFrame:
    c = _from(context, *columns)
    joined = nodes.join(c, (F.col("page_id") == F.col("c_page_id")) & on())
    return joined.select(*nodes.columns, "c_pre")


def parent(nodes: DataFrame, context: DataFrame) -> DataFrame:
    return _join(nodes, context, ("pre", "parent"), lambda: F.col("pre") == F.col("c_parent"))


def children(nodes: DataFrame, context: DataFrame) -> DataFrame:
    return _join(nodes.where("tag <> '#comment'"), context, ("pre",), lambda: F.col("parent") == F.col("c_pre"))


def siblings(nodes: DataFrame, context: DataFrame) -> DataFrame:
    return _join(nodes.where("tag <> '#comment'"), context, ("pre", "parent"), lambda: (F.col("parent") == F.col("c_parent")) & (F.col("pre") != F.col("c_pre")))


def descendants(nodes: DataFrame, context: DataFrame) -> DataFrame:
    return _join(nodes, context, ("pre", "end"), lambda: (F.col("pre") > F.col("c_pre")) & (F.col("pre") <= F.col("c_end")))


def ancestors(nodes: DataFrame, context: DataFrame) -> DataFrame:
    """With distance: 1 for the parent."""
    found = _join(nodes, context, ("pre", "level"), lambda: (F.col("pre") < F.col("c_pre")) & (F.col("end") >= F.col("c_pre")))
    levels = _from(context, "pre", "level").select("c_page_id", F.col("c_pre").alias("x"), "c_level")
    return found.join(levels, (F.col("page_id") == F.col("c_page_id")) & (F.col("c_pre") == F.col("x"))).withColumn("distance", F.col("c_level") - F.col("level")).drop("c_page_id", "x", "c_level")


def find_ancestor(nodes: DataFrame, context: DataFrame, where: Column) -> DataFrame:
    """The nearest ancestor for which a column expression holds."""
    found = _join(nodes.where(where), context, ("pre",), lambda: (F.col("pre") < F.col("c_pre")) & (F.col("end") >= F.col("c_pre")))
    best = found.groupBy("page_id", "c_pre").agg(F.max_by(F.struct(*nodes.columns), "pre").alias("n"))
    return best.select("n.*", "c_pre")


def neighbours(nodes: DataFrame) -> DataFrame:
    """nodes with next_pre and previous_pre, the adjacent element siblings."""
    w = W.partitionBy("page_id", "parent").orderBy("pre")
    return nodes.where("tag <> '#comment'").withColumn("next_pre", F.lead("pre").over(w)).withColumn("previous_pre", F.lag("pre").over(w))


def next_of(nodes: DataFrame, context: DataFrame) -> DataFrame:
    return _join(nodes, context, ("pre", "parent", "sib"), lambda: (F.col("parent") == F.col("c_parent")) & (F.col("sib") == F.col("c_sib") + 1))


def previous_of(nodes: DataFrame, context: DataFrame) -> DataFrame:
    return _join(nodes, context, ("pre", "parent", "sib"), lambda: (F.col("parent") == F.col("c_parent")) & (F.col("sib") == F.col("c_sib") - 1))


def all_text(context: DataFrame, texts: DataFrame, nodes: DataFrame, *, separator: str = "\n", strip: bool = False, ignore: tuple[str, ...] = ("script", "style"), valid: bool = True) -> DataFrame:
    """(page_id, c_pre, all_text): descendant text in order; texts inside ignored elements go, their tails stay."""
    t = texts.select(F.col("page_id").alias("t_page"), "seq", "owner", "is_tail", (F.trim("text") if strip else F.col("text")).alias("piece"))
    if valid:
        t = t.where(F.trim("piece") != "")
    c = context.select("page_id", F.col("pre").alias("c_pre"), F.col("end").alias("c_end"))
    inside = (F.col("page_id") == F.col("t_page")) & F.col("owner").between(F.col("c_pre"), F.col("c_end")) & ~((F.col("owner") == F.col("c_pre")) & F.col("is_tail"))
    found = c.join(t, inside)
    if ignore:
        drop = nodes.where(F.col("tag").isin(*ignore)).select(F.col("page_id").alias("i_page"), F.col("pre").alias("i_pre"), F.col("end").alias("i_end"))
        hidden = (F.col("page_id") == F.col("i_page")) & (F.col("i_pre") >= F.col("c_pre")) & F.col("owner").between(F.col("i_pre"), F.col("i_end")) & ~((F.col("owner") == F.col("i_pre")) & F.col("is_tail"))
        found = found.join(drop, hidden, "left_anti")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"])
    return found.groupBy("page_id", "c_pre").agg(F.array_join(ordered, separator).alias("all_text"))


# ---- generated selectors, inside one tree

def css_selector(tree: Tree, i: int, full: bool = False) -> str:
    """Steps from the node up to below html; an id ends the walk unless full."""
    parts = []
    for k in (i, *tree.ancestors(i)):
        if tree.tag[k] == "html" and k != i:
            break
        node_id = tree.attr(k, "id")
        if node_id and not full:
            parts.append(f"#{node_id}")
            break
        nth = tree.place[1][k]
        parts.append(tree.tag[k] + (f":nth-of-type({nth})" if nth > 1 else "") if not node_id else f"#{node_id}")
    return " > ".join(reversed(parts))


def xpath_selector(tree: Tree, i: int, full: bool = False) -> str:
    parts = []
    for k in (i, *tree.ancestors(i)):
        if tree.tag[k] == "html" and k != i:
            break
        node_id = tree.attr(k, "id")
        if node_id and not full:
            parts.append(f"*[@id='{node_id}']")
            break
        nth = tree.place[1][k]
        parts.append(f"*[@id='{node_id}']" if node_id else tree.tag[k] + (f"[{nth}]" if nth > 1 else ""))
    return "//" + "/".join(reversed(parts))


def generated_selectors(html: str | Column, selector: str, *, kind: str = "css", full: bool = False) -> Column:
    """ARRAY<STRING>: a selector for each match of a CSS selector (kind: css or xpath)."""
    import pyarrow as pa

    from domloom.selection.api import compiled
    from domloom.sources.pages import per_page

    make, plan = (css_selector if kind == "css" else xpath_selector), compiled(selector)
    return per_page(lambda tree, _: [make(tree, i, full) for i, _ in plan.nodes(tree)], pa.list_(pa.string()), "array<string>", html)
