"""CSS selectors: text to a small syntax tree, and matching inside one tree.

A selector list is a tuple of ``Complex``; each is a chain of compounds joined by
combinators, and may end in ``::text`` or ``::attr(name)``.  Parsing is cached.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from domloom.dom.tree import Tree


class SelectorSyntaxError(ValueError):
    """The selector cannot be read."""


class ExpressionError(SelectorSyntaxError):
    """The selector is well-formed but names something unknown."""


@dataclass(frozen=True)
class Attribute:
    name: str
    operator: str = ""
    value: str = ""
    ignore_case: bool = False


@dataclass(frozen=True)
class Pseudo:
    name: str
    argument: object = None


@dataclass(frozen=True)
class Compound:
    tag: str = "*"
    tests: tuple = ()


@dataclass(frozen=True)
class Complex:
    compounds: tuple[Compound, ...]
    combinators: tuple[str, ...]
    element: tuple[str, str] | None = None


_NAME = r"(?:[-_a-zA-Z0-9\u0080-￿]|\\.)+"
_TOKEN = re.compile(
    rf"""(?P<space>\s*[>+~,]\s*|\s+)|(?P<hash>\#{_NAME})|(?P<cls>\.{_NAME})|(?P<pe>::{_NAME})|(?P<pc>:{_NAME})|(?P<open>\()|(?P<close>\))|(?P<attr>\[)|(?P<name>\*|{_NAME})"""
)
_ATTR = re.compile(rf"""\[\s*({_NAME})\s*(?:([~|^$*!]?=)\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|({_NAME}))\s*([iIsS])?\s*)?\]""")
_NTH = re.compile(r"\s*(?:(odd)|(even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)
_STRING = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|([^)'"]*?))\s*$""")
_PLAIN = frozenset("first-child last-child only-child first-of-type last-of-type only-of-type empty root link any-link checked disabled enabled scope".split())
_NTHS = frozenset("nth-child nth-last-child nth-of-type nth-last-of-type".split())
_LISTS = frozenset("not is where matches any has".split())


def _plain(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at = text, 0

    def fail(self, why: str = "unexpected text") -> SelectorSyntaxError:
        return SelectorSyntaxError(f"{why} at {self.at} of {self.text!r}")

    def balanced(self) -> str:
        """The text up to the parenthesis that closes the one just read."""
        depth, i, quote = 1, self.at, ""
        while i < len(self.text):
            c = self.text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "()":
                depth += 1 if c == "(" else -1
                if not depth:
                    inside, self.at = self.text[self.at : i], i + 1
                    return inside
            i += 1
        raise self.fail("unclosed parenthesis")

    def selector_list(self) -> tuple[Complex, ...]:
        out = []
        for part in self.split():
            out.append(_Reader(part.strip()).complex(relative=False))
        return tuple(out)

    def split(self) -> list[str]:
        parts, depth, quote, start = [], 0, "", 0
        for i, c in enumerate(self.text):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
            elif c == "," and not depth:
                parts.append(self.text[start:i])
                start = i + 1
        return [*parts, self.text[start:]]

    def complex(self, relative: bool) -> Complex:
        if not self.text:
            raise self.fail("empty selector")
        compounds, combinators, tag, tests, began, element = [], [], "*", [], False, None
        if relative and self.text[0] in ">+~":
            combinators.append(self.text[0])
            compounds.append(Compound("*", (Pseudo("scope"),)))
            self.at = len(re.match(r"[>+~]\s*", self.text)[0])
        while self.at < len(self.text):
            m = _TOKEN.match(self.text, self.at)
            if not m or element:
                raise self.fail()
            kind, word = m.lastgroup, m[0]
            if kind == "attr":
                a = _ATTR.match(self.text, self.at)
                if not a:
                    raise self.fail("bad attribute test")
                value = next((v for v in a.groups()[2:5] if v is not None), "")
                tests.append(Attribute(_plain(a[1]).lower(), a[2] or "", _plain(value), (a[6] or "").lower() == "i"))
                self.at, began = a.end(), True
                continue
            self.at = m.end()
            if kind == "space":
                c = word.strip() or " "
                if not began or c == ",":
                    raise self.fail("misplaced combinator")
                compounds.append(Compound(tag, tuple(tests)))
                combinators.append(c)
                tag, tests, began = "*", [], False
                continue
            if kind == "name":
                if began:
                    raise self.fail("misplaced name")
                if word[0].isdigit():
                    raise self.fail("a name cannot begin with a digit")
                tag = _plain(word).lower()
            elif kind == "hash":
                tests.append(Attribute("id", "=", _plain(word[1:])))
            elif kind == "cls":
                tests.append(Attribute("class", "~=", _plain(word[1:])))
            elif kind == "pc":
                tests.append(self.pseudo(word[1:].lower()))
            elif kind == "pe":
                element = self.pseudo_element(word[2:].lower())
            else:
                raise self.fail()
            began = True
        if not began:
            raise self.fail("a selector cannot end here")
        compounds.append(Compound(tag, tuple(tests)))
        return Complex(tuple(compounds), tuple(combinators), element)

    def argument(self) -> str | None:
        if self.text[self.at : self.at + 1] != "(":
            return None
        self.at += 1
        return self.balanced()

    def pseudo(self, name: str) -> Pseudo:
        argument = self.argument()
        if argument is None:
            if name not in _PLAIN:
                raise ExpressionError(f"unknown pseudo-class :{name}")
            return Pseudo(name)
        if name in _NTHS:
            m = _NTH.match(argument)
            if not m:
                raise self.fail("bad argument of an nth test")
            if m[1]:
                return Pseudo(name, (2, 1))
            if m[2]:
                return Pseudo(name, (2, 0))
            if m[6] is not None:
                return Pseudo(name, (0, int(m[6])))
            step = int(m[3] + "1") if m[3] in ("", "+", "-") else int(m[3])
            return Pseudo(name, (step, int((m[4] or "+") + (m[5] or "0"))))
        if name == "has":
            return Pseudo(name, tuple(_Reader(p.strip()).complex(relative=True) for p in _Reader(argument).split()))
        if name in _LISTS:
            return Pseudo("not" if name == "not" else "is", _Reader(argument).selector_list())
        if name in ("contains", "lang"):
            m = _STRING.match(argument)
            if not m:
                raise self.fail("bad string")
            return Pseudo(name, _plain(next(v for v in m.groups() if v is not None)))
        raise ExpressionError(f"unknown pseudo-class :{name}()")

    def pseudo_element(self, name: str) -> tuple[str, str]:
        argument = self.argument()
        if name == "text" and argument is None:
            return ("text", "")
        if name == "attr" and argument and argument.strip():
            return ("attr", argument.strip().lower())
        raise ExpressionError(f"unknown pseudo-element ::{name}")


@lru_cache(256)
def parse_css(text: str) -> tuple[Complex, ...]:
    if not isinstance(text, str) or not text.strip():
        raise SelectorSyntaxError("empty selector")
    return _Reader(text).selector_list()


# ---- matching inside one tree

def attribute_holds(t: Attribute, value: str | None) -> bool:
    if t.operator == "!=":
        return value != t.value
    if value is None:
        return False
    want, have = (t.value.lower(), value.lower()) if t.ignore_case else (t.value, value)
    match t.operator:
        case "":
            return True
        case "=":
            return have == want
        case "~=":
            return bool(want) and want in have.split()
        case "|=":
            return have == want or have.startswith(want + "-")
        case "^=":
            return bool(want) and have.startswith(want)
        case "$=":
            return bool(want) and have.endswith(want)
        case "*=":
            return bool(want) and want in have
    raise ExpressionError(f"unknown operator {t.operator}")


def _nth(step: int, offset: int, k: int) -> bool:
    return k == offset if not step else (k - offset) % step == 0 and (k - offset) // step >= 0


def _siblings(tree: Tree, i: int) -> list[int]:
    return tree.children[tree.parent[i]] if tree.parent[i] >= 0 else [i]


class Matcher:
    """Matches compounds and chains of one tree; what a chain selects is worked out once for all nodes."""

    def __init__(self, tree: Tree, scope: int = 0) -> None:
        self.tree, self.scope = tree, scope
        self.chains: dict[int, tuple[Complex, bytearray]] = {}
        self.marks: dict[int, tuple[Compound, bytearray]] = {}

    def pseudo(self, i: int, p: Pseudo) -> bool:
        tree = self.tree
        match p.name:
            case "not":
                return not any(self.ends(i, c) for c in p.argument)
            case "is":
                return any(self.ends(i, c) for c in p.argument)
            case "has":
                return any(self.has(i, c) for c in p.argument)
            case "contains":
                return p.argument in tree.string(i)
            case "lang":
                for k in (i, *tree.ancestors(i)):
                    if (lang := tree.attr(k, "lang")) is not None:
                        return lang.lower() == p.argument.lower() or lang.lower().startswith(p.argument.lower() + "-")
                return False
            case "first-child":
                return tree.place[0][i] == 1
            case "last-child":
                return tree.place[0][i] == len(_siblings(tree, i))
            case "only-child":
                return len(_siblings(tree, i)) == 1
            case "first-of-type":
                return tree.place[1][i] == 1
            case "last-of-type":
                return tree.place[1][i] == tree.of_type[i]
            case "only-of-type":
                return tree.of_type[i] == 1
            case "nth-child":
                return _nth(*p.argument, tree.place[0][i])
            case "nth-of-type":
                return _nth(*p.argument, tree.place[1][i])
            case "nth-last-child":
                return _nth(*p.argument, len(_siblings(tree, i)) + 1 - tree.place[0][i])
            case "nth-last-of-type":
                return _nth(*p.argument, tree.of_type[i] + 1 - tree.place[1][i])
            case "empty":
                return not tree.children[i] and not tree.text[i]
            case "root":
                return tree.parent[i] < 0
            case "scope":
                return i == self.scope
            case "link" | "any-link":
                return tree.tag[i] in ("a", "area", "link") and "href" in tree.names[i]
            case "checked":
                return tree.tag[i] in ("input", "option") and ("checked" in tree.names[i] or "selected" in tree.names[i])
            case "disabled" | "enabled":
                return tree.tag[i] in ("button", "input", "select", "textarea", "option", "optgroup", "fieldset") and ("disabled" in tree.names[i]) == (p.name == "disabled")
        raise ExpressionError(f"unknown pseudo-class :{p.name}")

    def compound(self, i: int, c: Compound) -> bool:
        tree = self.tree
        if tree.tag[i] == "#comment" or c.tag not in ("*", tree.tag[i]):
            return False
        return all(attribute_holds(t, tree.attr(i, t.name)) if isinstance(t, Attribute) else self.pseudo(i, t) for t in c.tests)

    def has(self, i: int, c: Complex) -> bool:
        """Whether something relative to i ends the chain."""
        tree = self.tree
        if not c.combinators or not any(isinstance(t, Pseudo) and t.name == "scope" for t in c.compounds[0].tests):
            return self.all_ends(c).find(1, i + 1, tree.end[i] + 1) >= 0
        # the first compound is the scope, i itself
        kind, rest = c.combinators[0], c.compounds[1:]
        last = tree.end[tree.parent[i]] if kind in "+~" and tree.parent[i] >= 0 else tree.end[i]
        if len(rest) > 1:  # the chain is worked out inside the part of the tree that it can reach
            return Matcher(tree, i).all_ends(c, i, last).find(1, i + 1, last + 1) >= 0
        if kind == " ":
            if id(rest[0]) not in self.marks:
                self.marks[id(rest[0])] = rest[0], self.holding(rest[0], range(len(tree)))
            return self.marks[id(rest[0])][1].find(1, i + 1, last + 1) >= 0
        if kind == ">":
            near = tree.children[i]
        else:
            place = tree.place[0][i]
            near = _siblings(tree, i)[place : place + 1 if kind == "+" else None]
        return any(self.compound(k, rest[0]) for k in near)

    def ends(self, i: int, c: Complex) -> bool:
        """Whether node i ends a chain of c's compounds."""
        return self.compound(i, c.compounds[0]) if len(c.compounds) == 1 else bool(self.all_ends(c)[i])

    def all_ends(self, c: Complex, first: int = 0, stop: int | None = None) -> bytearray:
        """Marks of the nodes that end the chain, worked out from left to right.

        Each step passes the nodes once: a mark is handed to the children, down the
        subtree, to the next sibling or to all later ones.
        """
        if id(c) in self.chains:
            return self.chains[id(c)][1]
        tree, n = self.tree, len(self.tree)
        nodes = range(first, n if stop is None else stop + 1)
        found = self.holding(c.compounds[0], nodes)
        for kind, compound in zip(c.combinators, c.compounds[1:], strict=True):
            near = bytearray(n)  # nodes that stand to a marked one as the combinator asks
            parent = tree.parent
            if kind in " >":
                for k in nodes:
                    p = parent[k]
                    if p >= 0 and (found[p] or kind == " " and near[p]):
                        near[k] = 1
            else:
                for p in dict.fromkeys(parent[k] for k in nodes if found[k]):
                    before = 0
                    for k in tree.children[p] if p >= 0 else ():
                        near[k] = before
                        before = found[k] if kind == "+" else found[k] or before
            found = self.holding(compound, nodes, near)
        self.chains[id(c)] = c, found
        return found

    def holding(self, c: Compound, nodes: range, among: bytearray | None = None) -> bytearray:
        tree, out = self.tree, bytearray(len(self.tree))
        pool = nodes if c.tag == "*" else tree.by_tag.get(c.tag, ())
        for k in pool:
            if k in nodes and (among is None or among[k]) and self.compound(k, c):
                out[k] = 1
        return out


def select_nodes(tree: Tree, selector: tuple[Complex, ...], context: int = 0) -> list[int]:
    """Nodes of the subtree of context (itself included), in document order, each once."""
    if not len(tree):
        return []
    stop, found, matcher = tree.end[context], set(), Matcher(tree, context)
    for c in selector:
        if len(c.compounds) == 1:
            tag = c.compounds[0].tag
            pool = range(context, stop + 1) if tag == "*" else (k for k in tree.by_tag.get(tag, ()) if context <= k <= stop)
            found.update(k for k in pool if matcher.compound(k, c.compounds[0]))
        else:
            ends, k = matcher.all_ends(c), context - 1
            while (k := ends.find(1, k + 1, stop + 1)) >= 0:
                found.add(k)
    return sorted(found)


def results(tree: Tree, selector: tuple[Complex, ...], context: int = 0) -> Iterator[tuple[int, str | None]]:
    """(node, string) of each result; the string is None for elements."""
    if len({c.element for c in selector}) == 1:
        groups = [selector]
    else:
        groups = [(c,) for c in selector]
    found = []
    for k, group in enumerate(groups):
        element = group[0].element
        for i in select_nodes(tree, group, context):
            if not element:
                found.append((i, -1, k, i, None))
            elif element[0] == "attr":
                value = tree.attr(i, element[1])
                if value is not None:
                    found.append((i, -1, k, i, value))
            else:
                if tree.text[i]:
                    found.append((i, 0, k, i, tree.text[i]))
                found += [(tree.end[c], 1, k, i, tree.tail[c]) for c in tree.children[i] if tree.tail[c]]
    for _, _, _, i, value in sorted(found, key=lambda x: x[:3]):
        yield i, value
