"""A subset of XPath 1.0 over one tree.

All axes but namespace; name, ``*``, ``text()``, ``node()`` and ``comment()`` tests;
predicates with the full expression grammar and the core functions; unions and
variables.  A result must be a node set: elements, attribute values or text nodes.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

from domloom.dom.tree import Tree
from domloom.selection.css import SelectorSyntaxError

_TOKEN = re.compile(r"""\s*(?:(\d+(?:\.\d*)?|\.\d+)|("[^"]*"|'[^']*')|(\.\.|::|//|!=|<=|>=|[-/@.()\[\],|+=<>*$])|([A-Za-z_][\w.-]*(?::[A-Za-z_][\w.-]*)?))""")
_AXES = frozenset("child descendant descendant-or-self self parent ancestor ancestor-or-self following-sibling preceding-sibling following preceding attribute".split())
_REVERSE = frozenset("ancestor ancestor-or-self preceding-sibling preceding parent".split())
_LEVELS = (("or",), ("and",), ("=", "!="), ("<", "<=", ">", ">="), ("+", "-"), ("*", "div", "mod"))


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, at = text, [], 0
        text = text.rstrip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise SelectorSyntaxError(f"bad XPath at {at}: {self.text!r}")
            kind = m.lastindex
            self.tokens.append(("", "num", "str", "op", "name")[kind : kind + 1] + (m[kind],))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0) -> str | None:
        i = self.at + k
        return self.tokens[i][1] if i < len(self.tokens) and self.tokens[i][0] != "str" else None

    def kind(self, k: int = 0) -> str | None:
        return self.tokens[self.at + k][0] if self.at + k < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        if self.at >= len(self.tokens) or (want and self.peek() != want):
            raise SelectorSyntaxError(f"expected {want or 'more'} in {self.text!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def parse(self):
        tree = self.binary(0)
        if self.at < len(self.tokens):
            raise SelectorSyntaxError(f"unexpected {self.tokens[self.at][1]!r} in {self.text!r}")
        return tree

    def binary(self, level: int):
        if level == len(_LEVELS):
            if self.peek() == "-":
                self.take()
                return ("neg", self.binary(level))
            return self.union()
        left = self.binary(level + 1)
        while self.peek() in _LEVELS[level]:
            left = ("op", self.take(), left, self.binary(level + 1))
        return left

    def union(self):
        parts = [self.path()]
        while self.peek() == "|":
            self.take()
            parts.append(self.path())
        return parts[0] if len(parts) == 1 else ("union", parts)

    def path(self):
        kind, word = self.kind(), self.peek()
        base = None
        if kind == "str":
            base = ("lit", self.take()[1:-1])
        elif kind == "num":
            base = ("lit", float(self.take()))
        elif word == "$":
            self.take()
            base = ("var", self.take())
        elif word == "(":
            self.take()
            base = ("group", self.binary(0))
            self.take(")")
        elif kind == "name" and self.peek(1) == "(" and word not in ("text", "node", "comment"):
            base = self.call()
        if base:
            tests = self.predicates()
            if not tests and self.peek() not in ("/", "//"):
                return base
            return ("path", ("filter", base, tests), self.steps(first=False))
        if word in ("/", "//"):
            if word == "/" and self.kind(1) is None:
                self.take()
                return ("path", "root", [])
            return ("path", "root", self.steps(first=False))
        return ("path", "here", self.steps(first=True))

    def call(self):
        name, args = self.take(), []
        self.take("(")
        while self.peek() != ")":
            args.append(self.binary(0))
            if self.peek() == ",":
                self.take()
            elif self.peek() != ")":
                raise SelectorSyntaxError(f"bad call of {name} in {self.text!r}")
        self.take(")")
        if name not in _FUNCTIONS:
            raise SelectorSyntaxError(f"unknown function {name}()")
        return ("call", name, args)

    def steps(self, first: bool) -> list:
        out = [self.step()] if first else []
        while self.peek() in ("/", "//"):
            if self.take() == "//":
                out.append(("descendant-or-self", "node()", []))
            out.append(self.step())
        return out

    def step(self):
        if self.peek() in (".", ".."):
            return ("self" if self.take() == "." else "parent", "node()", self.predicates())
        axis = "child"
        if self.peek() == "@":
            self.take()
            axis = "attribute"
        elif self.kind() == "name" and self.peek(1) == "::":
            axis = self.take()
            self.take("::")
            if axis not in _AXES:
                raise SelectorSyntaxError(f"unknown axis {axis}")
        if self.kind() not in ("name", "op") or (self.kind() == "op" and self.peek() != "*"):
            raise SelectorSyntaxError(f"bad step in {self.text!r}")
        test = self.take()
        if self.peek() == "(":
            if test not in ("text", "node", "comment"):
                raise SelectorSyntaxError(f"unknown node test {test}()")
            self.take()
            self.take(")")
            test += "()"
        return (axis, test.lower(), self.predicates())

    def predicates(self) -> list:
        out = []
        while self.peek() == "[":
            self.take()
            out.append(self.binary(0))
            self.take("]")
        return out


# Nodes: ("e", i) element, ("a", i, name, value), ("t", owner, order, value); "d" is the document.

def _order(tree: Tree, n: tuple) -> tuple:
    if n[0] == "e":
        return (n[1], -1, 0)
    if n[0] == "a":
        return (n[1], 0, tree.names[n[1]].index(n[2]))
    return n[2]


def _text_nodes(tree: Tree, i: int) -> list[tuple]:
    out = [("t", i, (i, 1, 0), tree.text[i])] if tree.text[i] and tree.tag[i] != "#comment" else []
    return out + [("t", i, (tree.end[c], 2, -tree.level[c]), tree.tail[c]) for c in _all_children(tree, i) if tree.tail[c]]


def _all_children(tree: Tree, i: int) -> list[int]:
    out, k = [], i + 1
    while k <= tree.end[i]:
        out.append(k)
        k = tree.end[k] + 1
    return out


class _Run:
    def __init__(self, tree: Tree, variables: dict) -> None:
        self.tree, self.vars = tree, variables

    # -- axes
    def axis(self, node: tuple, axis: str) -> list[tuple]:
        t = self.tree
        if node == ("d",):
            if axis == "child":
                return [("e", 0)]
            if axis in ("descendant", "descendant-or-self"):
                inside = self.axis(("e", 0), "descendant-or-self")
                return inside if axis == "descendant" else [node, *inside]
            return [node] if axis in ("self", "ancestor-or-self") else []
        if node[0] != "e":
            match axis:
                case "self" | "descendant-or-self":
                    return [node]
                case "parent":
                    return [("e", node[1])]
                case "ancestor":
                    return self.axis(("e", node[1]), "ancestor-or-self")
                case "ancestor-or-self":
                    return [node, *self.axis(("e", node[1]), "ancestor-or-self")]
            return []
        i = node[1]
        match axis:
            case "self":
                return [node]
            case "child":
                return sorted([*(("e", c) for c in _all_children(t, i)), *_text_nodes(t, i)], key=lambda n: _order(t, n))
            case "descendant" | "descendant-or-self":
                out = [] if axis == "descendant" else [node]
                for k in range(i, t.end[i] + 1):
                    out += _text_nodes(t, k) + ([("e", k)] if k != i else [])
                return sorted(out, key=lambda n: _order(t, n))
            case "parent":
                return [("e", t.parent[i])] if t.parent[i] >= 0 else [("d",)]
            case "ancestor" | "ancestor-or-self":
                return ([] if axis == "ancestor" else [node]) + [("e", a) for a in t.ancestors(i)] + [("d",)]
            case "following-sibling" | "preceding-sibling":
                kids = _all_children(t, t.parent[i]) if t.parent[i] >= 0 else [i]
                at = kids.index(i)
                return [("e", k) for k in (kids[at + 1 :] if axis[0] == "f" else kids[:at][::-1])]
            case "following":
                return [("e", k) for k in range(t.end[i] + 1, len(t))]
            case "preceding":
                return [("e", k) for k in range(i - 1, -1, -1) if t.end[k] < i]
            case "attribute":
                return [("a", i, n, v) for n, v in zip(t.names[i], t.values[i], strict=True)]
        raise SelectorSyntaxError(f"unknown axis {axis}")

    def passes(self, n: tuple, axis: str, test: str) -> bool:
        if test == "node()":
            return True
        if n == ("d",):
            return False
        if test in ("text()", "comment()"):
            return n[0] == "t" if test == "text()" else n[0] == "e" and self.tree.tag[n[1]] == "#comment"
        if axis == "attribute":
            return test in ("*", n[2])
        return n[0] == "e" and self.tree.tag[n[1]] != "#comment" and test in ("*", self.tree.tag[n[1]])

    def step(self, nodes: list[tuple], axis: str, test: str, tests: list) -> list[tuple]:
        out: dict[tuple, None] = {}
        for node in nodes:
            found = [n for n in self.axis(node, axis) if self.passes(n, axis, test)]
            for p in tests:
                found = self.keep(found, p)
            out.update(dict.fromkeys(found))
        return self.sort(list(out))

    def keep(self, nodes: list[tuple], predicate) -> list[tuple]:
        out = []
        for k, n in enumerate(nodes, 1):
            v = self.value(predicate, n, k, len(nodes))
            if v == k if isinstance(v, float) else self.boolean(v):
                out.append(n)
        return out

    def sort(self, nodes: list[tuple]) -> list[tuple]:
        return sorted(nodes, key=lambda n: (-1, 0, 0) if n == ("d",) else _order(self.tree, n))

    def path(self, e, node: tuple, k: int, size: int) -> list[tuple]:
        _, base, steps = e
        if base == "root":
            nodes = [("d",)]
        elif base == "here":
            nodes = [node]
        else:
            nodes = self.value(base[1], node, k, size)
            if not isinstance(nodes, list):
                raise SelectorSyntaxError("a path must start from nodes")
            for p in base[2]:
                nodes = self.keep(nodes, p)
        i = 0
        while i < len(steps):
            axis, test, tests = steps[i]
            if (axis, test, tests) == ("descendant-or-self", "node()", []) and i + 1 < len(steps) and steps[i + 1][0] == "child" and not any(map(_positional, steps[i + 1][2])):
                axis, (_, test, tests) = "descendant", steps[i + 1]  # //x without positions: one walk
                i += 1
            nodes = self.step(nodes, axis, test, tests)
            i += 1
        return nodes

    # -- values
    def value(self, e, node: tuple, k: int = 1, size: int = 1):
        match e[0]:
            case "lit":
                return e[1]
            case "var":
                if e[1] not in self.vars:
                    raise SelectorSyntaxError(f"no variable ${e[1]}")
                v = self.vars[e[1]]
                return float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v
            case "group":
                return self.value(e[1], node, k, size)
            case "neg":
                return -self.number(self.value(e[1], node, k, size))
            case "path":
                return self.path(e, node, k, size)
            case "union":
                return self.sort(list(dict.fromkeys(n for p in e[1] for n in self.value(p, node, k, size))))
            case "call":
                return self.call(e[1], e[2], node, k, size)
            case "op":
                return self.operate(e[1], e[2], e[3], node, k, size)
        raise SelectorSyntaxError(f"cannot evaluate {e[0]}")

    def operate(self, op: str, left, right, node: tuple, k: int, size: int):
        a = self.value(left, node, k, size)
        if op in ("or", "and"):
            return self.boolean(a) if self.boolean(a) == (op == "or") else self.boolean(self.value(right, node, k, size))
        b = self.value(right, node, k, size)
        if op in ("=", "!=", "<", "<=", ">", ">="):
            return any(self.compare(op, x, y) for x in self.atoms(a) for y in self.atoms(b))
        x, y = self.number(a), self.number(b)
        match op:
            case "+":
                return x + y
            case "-":
                return x - y
            case "*":
                return x * y
            case "div":
                return x / y if y else math.copysign(math.inf, x) if x else math.nan
        return math.fmod(x, y) if y else math.nan

    def atoms(self, v) -> list:
        return [self.string_of(n) for n in v] if isinstance(v, list) else [v]

    def compare(self, op: str, x, y) -> bool:
        if op in ("=", "!="):
            if isinstance(x, bool) or isinstance(y, bool):
                x, y = self.boolean(x), self.boolean(y)
            elif isinstance(x, float) or isinstance(y, float):
                x, y = self.number(x), self.number(y)
            return (x == y) == (op == "=")
        x, y = self.number(x), self.number(y)
        return x < y if op == "<" else x <= y if op == "<=" else x > y if op == ">" else x >= y

    def string_of(self, n: tuple) -> str:
        return self.tree.string(0) if n == ("d",) else self.tree.string(n[1]) if n[0] == "e" else n[3]

    def string(self, v) -> str:
        if isinstance(v, list):
            return self.string_of(v[0]) if v else ""
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, float):
            return "NaN" if math.isnan(v) else str(int(v)) if v == int(v) else repr(v)
        return str(v)

    def number(self, v) -> float:
        if isinstance(v, bool | float):
            return float(v)
        try:
            return float(self.string(v).strip()) if re.fullmatch(r"\s*-?(\d+\.?\d*|\.\d+)\s*", self.string(v)) else math.nan
        except ValueError:
            return math.nan

    def boolean(self, v) -> bool:
        return bool(v) and not (isinstance(v, float) and math.isnan(v))

    def call(self, name: str, args: list, node: tuple, k: int, size: int):
        if name == "position":
            return float(k)
        if name == "last":
            return float(size)
        values = [self.value(a, node, k, size) for a in args]
        if name == "count":
            return float(len(values[0]))
        if name in ("name", "local-name"):
            n = values[0][0] if values and values[0] else node if not values else None
            return "" if not n or n[0] in "td" else self.tree.tag[n[1]] if n[0] == "e" else n[2]
        if name == "sum":
            return float(sum(self.number(self.string_of(n)) for n in values[0]))
        if name in ("not", "boolean"):
            return self.boolean(values[0]) == (name == "boolean")
        if name in ("number", "floor", "ceiling", "round"):
            x = self.number(values[0]) if values else self.number(self.string_of(node))
            if math.isnan(x) or math.isinf(x) or name == "number":
                return x
            return float(math.floor(x) if name == "floor" else math.ceil(x) if name == "ceiling" else math.floor(x + 0.5))
        s = [self.string(v) for v in values] or [self.string_of(node)]
        return _FUNCTIONS[name](s, values, self)


def _substring(s: list, v: list, run: _Run) -> str:
    start = math.floor(run.number(v[1]) + 0.5)
    stop = start + math.floor(run.number(v[2]) + 0.5) if len(v) > 2 else len(s[0]) + 1
    return s[0][max(start, 1) - 1 : max(stop - 1, 0)]


def _translate(s: list, v: list, run: _Run) -> str:
    table: dict[int, str | None] = {}
    for i, c in enumerate(s[1]):
        table.setdefault(ord(c), s[2][i] if i < len(s[2]) else None)
    return s[0].translate(table)


_FUNCTIONS = dict.fromkeys("position last count name local-name sum not boolean number floor ceiling round".split()) | {
    "true": lambda s, v, r: True,
    "false": lambda s, v, r: False,
    "string": lambda s, v, r: s[0],
    "concat": lambda s, v, r: "".join(s),
    "contains": lambda s, v, r: s[1] in s[0],
    "starts-with": lambda s, v, r: s[0].startswith(s[1]),
    "substring-before": lambda s, v, r: s[0].partition(s[1])[0] if s[1] in s[0] else "",
    "substring-after": lambda s, v, r: s[0].partition(s[1])[2],
    "substring": _substring,
    "string-length": lambda s, v, r: float(len(s[0])),
    "normalize-space": lambda s, v, r: " ".join(s[0].split()),
    "translate": _translate,
}


def _positional(e) -> bool:
    """Whether a predicate can depend on positions."""
    if e[0] == "call":
        return e[1] in ("position", "last", "count", "sum", "number", "floor", "ceiling", "round", "string-length") or any(map(_positional, e[2]))
    if e[0] == "op":
        return e[1] in ("+", "-", "*", "div", "mod") or (e[1] not in ("=", "!=", "<", "<=", ">", ">=") and any(map(_positional, e[2:]))) or any(_uses_position(x) for x in e[2:])
    return e[0] in ("lit", "neg", "var", "group")


def _uses_position(e) -> bool:
    return isinstance(e, tuple) and ((e[0] == "call" and e[1] in ("position", "last")) or any(_uses_position(x) if isinstance(x, tuple) else any(_uses_position(y) for y in x if isinstance(y, tuple)) if isinstance(x, list) else False for x in e[1:]))


@lru_cache(256)
def parse_xpath(text: str):
    if not isinstance(text, str) or not text.strip():
        raise SelectorSyntaxError("empty XPath")
    return _Parser(text).parse()


def results(tree: Tree, text: str, context: int = 0, variables: dict | None = None) -> list[tuple[int, str | None]]:
    """(node, string) of each result in document order; the string is None for elements."""
    if not len(tree):
        return []
    found = _Run(tree, variables or {}).value(parse_xpath(text), ("e", context))
    if not isinstance(found, list):
        raise SelectorSyntaxError("only node sets can be selected")
    return [(n[1], None if n[0] == "e" else n[3]) for n in found if n != ("d",)]
