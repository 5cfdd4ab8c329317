"""Selectors as relational plans over the node table.

Every compound is a filter on columns of ``nodes``; every combinator is one join on
page_id and a structural key:  ``>`` on parent = pre, ``+`` and ``~`` on a shared
parent, descendants on the interval ``a.pre < d.pre <= a.end`` (page_id stays the equi
key, so the plan is a hash or merge join with a residual, never a nested loop over
pages).  Chains are read from left to right and only (page_id, pre, end, parent, sib)
of the matches so far are carried; a last semi-join fetches whole rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from domloom.selection.css import Attribute, Complex, Compound, ExpressionError, Pseudo, parse_css

KEYS = ["page_id", "pre", "end", "parent", "sib"]


def attribute_test(t: Attribute) -> Column:
    v, want = F.element_at("attrs", t.name), F.lit(t.value)
    if t.ignore_case:
        v, want = F.lower(v), F.lit(t.value.lower())
    some = F.lit(bool(t.value))
    match t.operator:
        case "":
            test = v.isNotNull()
        case "=":
            test = v == want
        case "!=":
            return ~F.coalesce(v == want, F.lit(False))
        case "~=":
            test = some & F.array_contains(F.split(v, r"\s+"), want)
        case "|=":
            test = (v == want) | F.startswith(v, F.concat(want, F.lit("-")))
        case "^=":
            test = some & F.startswith(v, want)
        case "$=":
            test = some & F.endswith(v, want)
        case "*=":
            test = some & F.contains(v, want)
        case _:
            raise ExpressionError(f"unknown operator {t.operator}")
    return F.coalesce(test, F.lit(False))


def _nth(step: int, offset: int, k: Column) -> Column:
    if not step:
        return k == offset
    return (F.pmod(k - offset, F.lit(abs(step))) == 0) & ((k - offset) * (1 if step > 0 else -1) >= 0)


def pseudo_test(p: Pseudo) -> Column:
    """Tests that one node row decides; those on other rows are joins (see compound)."""
    match p.name:
        case "first-child":
            return F.col("sib") == 1
        case "last-child":
            return F.col("sib") == F.col("n_sib")
        case "only-child":
            return F.col("n_sib") == 1
        case "first-of-type":
            return F.col("nth_of_type") == 1
        case "last-of-type":
            return F.col("nth_of_type") == F.col("n_of_type")
        case "only-of-type":
            return F.col("n_of_type") == 1
        case "nth-child":
            return _nth(*p.argument, F.col("sib"))
        case "nth-of-type":
            return _nth(*p.argument, F.col("nth_of_type"))
        case "nth-last-child":
            return _nth(*p.argument, F.col("n_sib") + 1 - F.col("sib"))
        case "nth-last-of-type":
            return _nth(*p.argument, F.col("n_of_type") + 1 - F.col("nth_of_type"))
        case "empty":
            return (F.col("n_children") == 0) & (F.coalesce(F.length("text"), F.lit(0)) == 0)
        case "root":
            return F.col("parent") < 0
        case "link" | "any-link":
            return F.col("tag").isin("a", "area", "link") & F.map_contains_key("attrs", "href")
        case "checked":
            return F.col("tag").isin("input", "option") & (F.map_contains_key("attrs", "checked") | F.map_contains_key("attrs", "selected"))
        case "disabled" | "enabled":
            off = F.map_contains_key("attrs", "disabled")
            return F.col("tag").isin("button", "input", "select", "textarea", "option", "optgroup", "fieldset") & (off if p.name == "disabled" else ~off)
    raise ExpressionError(f":{p.name} is not a test on one node")


_JOINED = ("not", "is", "has", "contains", "lang")


def compound(nodes: DataFrame, c: Compound, texts: DataFrame | None) -> DataFrame:
    out = nodes.where(F.col("tag") != "#comment")
    if c.tag != "*":
        out = out.where(F.col("tag") == c.tag)
    for t in c.tests:
        if isinstance(t, Attribute):
            out = out.where(attribute_test(t))
        elif t.name not in _JOINED:
            out = out.where(pseudo_test(t))
    for t in c.tests:
        if not isinstance(t, Pseudo) or t.name not in _JOINED:
            continue
        if t.name in ("not", "is"):
            simple = all(len(x.compounds) == 1 and not any(isinstance(y, Pseudo) and y.name in _JOINED for y in x.compounds[0].tests) for x in t.argument)
            if simple:
                test = F.lit(False)
                for x in t.argument:
                    test |= _on_row(x.compounds[0])
                out = out.where(~test if t.name == "not" else test)
            else:
                hits = _list(nodes, t.argument, texts).select("page_id", "pre")
                out = out.join(hits, ["page_id", "pre"], "left_anti" if t.name == "not" else "left_semi")
        elif t.name == "contains":
            out = out.join(string_values(out, texts).where(F.contains("string", F.lit(t.argument))).select("page_id", "pre"), ["page_id", "pre"], "left_semi")
        elif t.name == "lang":
            near = nodes.where(F.map_contains_key("attrs", "lang")).select(F.col("page_id").alias("p"), F.col("pre").alias("a"), F.col("end").alias("z"), F.element_at("attrs", "lang").alias("lang"))
            langs = out.select("page_id", "pre").join(near, (F.col("page_id") == F.col("p")) & F.col("pre").between(F.col("a"), F.col("z")))
            langs = langs.groupBy("page_id", "pre").agg(F.lower(F.max_by("lang", "a")).alias("lang"))
            want = t.argument.lower()
            out = out.join(langs.where((F.col("lang") == want) | F.startswith("lang", F.lit(want + "-"))).select("page_id", "pre"), ["page_id", "pre"], "left_semi")
        else:
            out = out.join(_having(nodes, out, t.argument, texts), ["page_id", "pre"], "left_semi")
    return out


def _on_row(c: Compound) -> Column:
    test = F.lit(True) if c.tag == "*" else F.col("tag") == c.tag
    for t in c.tests:
        test &= attribute_test(t) if isinstance(t, Attribute) else pseudo_test(t)
    return F.coalesce(test, F.lit(False))


def string_values(nodes: DataFrame, texts: DataFrame | None) -> DataFrame:
    """(page_id, pre, string): all text under each node."""
    if "string" in nodes.columns:
        return nodes.select("page_id", "pre", "string")
    if texts is None:
        raise ExpressionError(":contains() needs the text table, or a string column")
    t = texts.select(F.col("page_id").alias("p"), "seq", "owner", "is_tail", F.col("text").alias("piece"))
    inside = (F.col("page_id") == F.col("p")) & F.col("owner").between(F.col("pre"), F.col("end")) & ~((F.col("owner") == F.col("pre")) & F.col("is_tail"))
    found = nodes.select("page_id", "pre", "end").join(t, inside)
    return found.groupBy("page_id", "pre").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("string"))


def _step(before: DataFrame, combinator: str, after: DataFrame) -> DataFrame:
    b = before.select(*[F.col(k).alias(f"b_{k}") for k in KEYS])
    same = F.col("page_id") == F.col("b_page_id")
    match combinator:
        case ">":
            on = same & (F.col("parent") == F.col("b_pre"))
        case " ":
            on = same & (F.col("pre") > F.col("b_pre")) & (F.col("pre") <= F.col("b_end"))
        case "+":
            on = same & (F.col("parent") == F.col("b_parent")) & (F.col("sib") == F.col("b_sib") + 1)
        case _:
            on = same & (F.col("parent") == F.col("b_parent")) & (F.col("sib") > F.col("b_sib"))
    return after.join(b, on, "left_semi")


def _chain(nodes: DataFrame, c: Complex, texts: DataFrame | None) -> DataFrame:
    found = compound(nodes, c.compounds[0], texts)
    for combinator, nxt in zip(c.combinators, c.compounds[1:], strict=True):
        found = _step(found.select(*KEYS), combinator, compound(nodes, nxt, texts))
    return found


def _list(nodes: DataFrame, selector: tuple[Complex, ...], texts: DataFrame | None) -> DataFrame:
    """Matches of any of the selectors, each node once."""
    if all(len(c.compounds) == 1 and not any(isinstance(t, Pseudo) and t.name in _JOINED for t in c.compounds[0].tests) for c in selector):
        test = F.lit(False)
        for c in selector:
            test |= _on_row(c.compounds[0])
        return nodes.where((F.col("tag") != "#comment") & test)  # one filter, no union
    if len(selector) == 1:
        return _chain(nodes, selector[0], texts)
    hits = _chain(nodes, selector[0], texts).select("page_id", "pre")
    for c in selector[1:]:
        hits = hits.unionAll(_chain(nodes, c, texts).select("page_id", "pre"))
    return nodes.join(hits.distinct(), ["page_id", "pre"], "left_semi")


def _having(nodes: DataFrame, outer: DataFrame, selector: tuple[Complex, ...], texts: DataFrame | None) -> DataFrame:
    """Nodes of outer from which one of the relative selectors leads somewhere."""
    hits = None
    for c in selector:
        start = outer.select(*KEYS, F.col("pre").alias("origin"))
        relative = bool(c.combinators) and any(isinstance(t, Pseudo) and t.name == "scope" for t in c.compounds[0].tests)
        chain = list(zip(c.combinators, c.compounds[1:], strict=True)) if relative else [(" ", c.compounds[0]), *zip(c.combinators, c.compounds[1:], strict=True)]
        for combinator, nxt in chain:
            b = start.select(*[F.col(k).alias(f"b_{k}") for k in KEYS], "origin")
            after = compound(nodes, nxt, texts).select(*KEYS)
            on = {
                ">": F.col("parent") == F.col("b_pre"),
                " ": (F.col("pre") > F.col("b_pre")) & (F.col("pre") <= F.col("b_end")),
                "+": (F.col("parent") == F.col("b_parent")) & (F.col("sib") == F.col("b_sib") + 1),
                "~": (F.col("parent") == F.col("b_parent")) & (F.col("sib") > F.col("b_sib")),
            }[combinator]
            start = after.join(b, (F.col("page_id") == F.col("b_page_id")) & on).select(*KEYS, "origin").distinct()
        found = start.select("page_id", F.col("origin").alias("pre"))
        hits = found if hits is None else hits.unionAll(found)
    return hits.distinct()


def css(nodes: DataFrame, selector: str, *, texts: DataFrame | None = None, concatenate: bool = False) -> DataFrame:
    """Node rows that match; with concatenate a node comes once for each selector of the list that it matches."""
    parsed = parse_css(selector)
    if any(c.element for c in parsed):
        raise ExpressionError("use css_strings for ::text and ::attr()")
    if not concatenate:
        return _list(nodes, parsed, texts)
    out = _chain(nodes, parsed[0], texts)
    for c in parsed[1:]:
        out = out.unionByName(_chain(nodes, c, texts))
    return out


def css_strings(nodes: DataFrame, selector: str, texts: DataFrame | None = None) -> DataFrame:
    """(page_id, pre, value) of ``::text`` or ``::attr()`` selectors; texts is needed for ``::text``."""
    out = None
    for c in parse_css(selector):
        if not c.element:
            raise ExpressionError("the selector ends in an element")
        hits = _list(nodes, (Complex(c.compounds, c.combinators),), texts)
        if c.element[0] == "attr":
            found = hits.select("page_id", "pre", F.element_at("attrs", c.element[1]).alias("value")).where("value IS NOT NULL")
        else:
            leading = hits.select("page_id", "pre", F.lit(-1).alias("o"), F.col("text").alias("value"))
            tails = nodes.select(F.col("page_id").alias("p"), F.col("parent").alias("q"), F.col("pre").alias("o"), F.col("tail").alias("value"))
            tails = hits.select("page_id", "pre").join(tails, (F.col("page_id") == F.col("p")) & (F.col("pre") == F.col("q"))).select("page_id", "pre", "o", "value")
            found = leading.unionAll(tails).where("value IS NOT NULL AND value <> ''").select("page_id", "pre", "value")
        out = found if out is None else out.unionAll(found)
    return out


def css_first(found: DataFrame, *columns: str) -> DataFrame:
    """Of each page the first match, by an aggregation with map-side combine."""
    return found.groupBy("page_id").agg(*[F.min_by(c, "pre").alias(c) for c in columns])


def css_last(found: DataFrame, *columns: str) -> DataFrame:
    return found.groupBy("page_id").agg(*[F.max_by(c, "pre").alias(c) for c in columns])


def part(found: DataFrame, start: int, stop: int) -> DataFrame:
    """Matches start .. stop - 1 of each page, from 0, in document order."""
    k = F.row_number().over(W.partitionBy("page_id").orderBy("pre")) - 1
    return found.withColumn("_k", k).where(F.col("_k").between(start, stop - 1)).drop("_k")


def find_all(nodes: DataFrame, tags: list[str] | None = None, attributes: dict[str, str] | None = None, patterns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """Tags are alternatives, everything else must hold; attribute keys may end in an operator."""
    from domloom.functions.text import re_test

    if not (tags or attributes or patterns or where is not None):
        raise TypeError("find_all needs a filter")
    out = nodes.where(F.col("tag") != "#comment")
    if tags:
        out = out.where(F.col("tag").isin([t.lower() for t in tags]))
    for key, value in (attributes or {}).items():
        operator = key[-1] if key[-1] in "~|^$*" else ""
        out = out.where(attribute_test(Attribute((key[:-1] if operator else key).lower(), operator + "=", value)))
    for p in patterns or ():
        out = out.where(re_test(F.coalesce("text", F.lit("")), p))
    return out if where is None else out.where(where)


def find_by_text(nodes: DataFrame, text: str, *, partial: bool = False, case_sensitive: bool = False, clean_match: bool = True) -> DataFrame:
    from domloom.functions.text import clean

    c = clean("text") if clean_match else F.col("text")
    c, want = (c, text) if case_sensitive else (F.lower(c), text.lower())
    return nodes.where((F.col("pre") > 0) & (F.trim("text") != "") & (F.contains(c, F.lit(want)) if partial else c == want))


def find_by_regex(nodes: DataFrame, pattern: str, *, case_sensitive: bool = False, clean_match: bool = True) -> DataFrame:
    from domloom.functions.text import clean, re_test

    c = clean("text") if clean_match else F.col("text")
    return nodes.where((F.col("pre") > 0) & (F.trim("text") != "") & re_test(c, pattern, case_sensitive=case_sensitive))
