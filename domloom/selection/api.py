"""Compiled selectors: one interface over CSS and XPath, and the element filters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from domloom.dom.serialize import outer_html
from domloom.dom.tree import Tree
from domloom.selection import css as css_
from domloom.selection import xpath as xpath_


@dataclass(frozen=True)
class Plan:
    """nodes(tree, context) gives (node, string or None) pairs in document order."""

    text: str
    nodes: Callable[..., list[tuple[int, str | None]]] = field(compare=False)

    def strings(self, tree: Tree, context: int = 0) -> list[str]:
        return [outer_html(tree, i) if v is None else v for i, v in self.nodes(tree, context)]

    def first(self, tree: Tree, context: int = 0, default: str | None = None) -> str | None:
        found = self.strings(tree, context)
        return found[0] if found else default


def css(text: str, *, concatenate: bool = False) -> Plan:
    """With concatenate a comma list is several queries one after the other instead of a union."""
    css_.parse_css(text)  # errors show here, not in a worker
    if concatenate:
        return Plan(text, lambda tree, context=0: [r for c in css_.parse_css(text) for r in css_.results(tree, (c,), context)])
    return Plan(text, lambda tree, context=0: list(css_.results(tree, css_.parse_css(text), context)))


def xpath(text: str, **variables) -> Plan:
    xpath_.parse_xpath(text)
    return Plan(text, lambda tree, context=0: xpath_.results(tree, text, context, variables))


def compiled(selector: str | Plan) -> Plan:
    return selector if isinstance(selector, Plan) else css(selector)


def clean(s: str) -> str:
    """Tabs and line ends become blanks, runs of blanks one, ends are stripped."""
    return re.sub(" +", " ", s.translate({9: " ", 10: " ", 13: " "})).strip()


_KEYWORDS = {"class_": "class", "for_": "for"}
_OPERATORS = "~|^$*"


def find_all(*filters, **attributes) -> Plan:
    """Elements of any of the tags, with all of the attributes, whose direct text matches all patterns, holding for all predicates.

    Tags are strings or iterables of strings; attributes a dict or keywords
    (``class_``, ``for_``; keys may end in an operator such as ``href*``); patterns
    compiled expressions; predicates callables (tree, node) -> bool.
    """
    tags: set[str] = set()
    tests: list[css_.Attribute] = []
    patterns: list[re.Pattern] = []
    predicates: list[Callable] = []

    def attribute(key: str, value: object) -> None:
        if not isinstance(key, str) or not isinstance(value, str):
            raise TypeError("attribute filters must be strings")
        operator = key[-1] if key and key[-1] in _OPERATORS else ""
        tests.append(css_.Attribute((key[: -len(operator)] if operator else key).lower(), operator + "=", value))

    for f in filters:
        if isinstance(f, str):
            tags.add(f.lower())
        elif isinstance(f, re.Pattern):
            patterns.append(f)
        elif isinstance(f, dict):
            for k, v in f.items():
                attribute(k, v)
        elif callable(f):
            predicates.append(f)
        elif isinstance(f, Iterable):
            names = list(f)
            if not all(isinstance(t, str) for t in names):
                raise TypeError(f"tags must be strings: {names!r}")
            tags.update(t.lower() for t in names)
        else:
            raise TypeError(f"cannot filter by {f!r}")
    for k, v in attributes.items():
        attribute(_KEYWORDS.get(k, k), v)
    if not (tags or tests or patterns or predicates):
        raise TypeError("find_all needs a filter")

    def run(tree: Tree, context: int = 0) -> list[tuple[int, None]]:
        return [
            (i, None)
            for i in range(context, tree.end[context] + 1)
            if tree.tag[i] != "#comment"
            and (not tags or tree.tag[i] in tags)
            and all(css_.attribute_holds(t, tree.attr(i, t.name)) for t in tests)
            and all(p.search(tree.text[i] or "") for p in patterns)
            and all(p(tree, i) for p in predicates)
        ]

    return Plan(f"find_all({filters}, {attributes})", run)


def _by_direct_text(name: str, holds: Callable[[str], bool], first_match: bool) -> Plan:
    def run(tree: Tree, context: int = 0) -> list[tuple[int, None]]:
        out = []
        for i in range(context + 1, tree.end[context] + 1):
            if tree.tag[i] != "#comment" and tree.text[i] and tree.text[i].strip() and holds(tree.text[i]):
                out.append((i, None))
                if first_match:
                    break
        return out

    return Plan(name, run)


def find_by_text(text: str, *, first_match: bool = True, partial: bool = False, case_sensitive: bool = False, clean_match: bool = True) -> Plan:
    """Descendants whose leading text is (or with partial contains) the text."""
    fold = (lambda s: s) if case_sensitive else str.lower
    want = fold(text)

    def holds(s: str) -> bool:
        s = fold(clean(s) if clean_match else s)
        return want in s if partial else s == want

    return _by_direct_text(f"text {text!r}", holds, first_match)


def find_by_regex(pattern: str | re.Pattern, *, first_match: bool = True, case_sensitive: bool = False, clean_match: bool = True) -> Plan:
    """Descendants whose leading text matches somewhere; case matters to a compiled pattern as it says."""
    compiled_ = pattern if isinstance(pattern, re.Pattern) else re.compile(pattern, 0 if case_sensitive else re.I)
    return _by_direct_text(f"regex {compiled_.pattern!r}", lambda s: bool(compiled_.search(clean(s) if clean_match else s)), first_match)
