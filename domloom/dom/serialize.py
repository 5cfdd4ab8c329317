"""Trees back to text: outer HTML, indented HTML and Markdown.  All iterative."""

from __future__ import annotations

import re
from html import escape

from .tree import RAW, VOID, Tree


def _open(tree: Tree, i: int) -> str:
    attrs = "".join(f' {n}="{escape(v, quote=False).replace(chr(34), "&quot;")}"' for n, v in zip(tree.names[i], tree.values[i], strict=True))
    return f"<{tree.tag[i]}{attrs}>"


def _text(tree: Tree, owner: int, text: str | None) -> str:
    return "" if not text else text if tree.tag[owner] in RAW else escape(text, quote=False)


def outer_html(tree: Tree, i: int = 0, *, pretty: bool = False) -> str:
    """The element's markup without its tail; with pretty, one element a line, indented by two blanks."""
    out: list[str] = []
    open_: list[int] = []
    base = tree.level[i]

    def line(level: int) -> str:
        return "\n" + "  " * (level - base) if pretty and out else ""

    def close(k: int) -> None:
        if tree.tag[k] not in VOID and tree.tag[k] != "#comment":
            out.append((line(tree.level[k]) if pretty and tree.children[k] else "") + f"</{tree.tag[k]}>")
        if k != i:
            out.append(_text(tree, max(tree.parent[k], 0), tree.tail[k]))

    for k in range(i, tree.end[i] + 1):
        while open_ and tree.end[open_[-1]] < k:
            close(open_.pop())
        if tree.tag[k] == "#comment":
            out.append(f"<!--{tree.text[k] or ''}-->")
        else:
            out.append(line(tree.level[k]) + _open(tree, k) + _text(tree, k, tree.text[k]))
        open_.append(k)
    while open_:
        close(open_.pop())
    return "".join(out).strip()


_HEADING = {f"h{n}": n for n in range(1, 7)}
_MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "code": "`", "kbd": "`", "samp": "`"}
_BREAKS = frozenset("p div section article header footer main nav aside ul ol table blockquote pre figure form address dl h1 h2 h3 h4 h5 h6 hr".split())


def markdown(tree: Tree, i: int = 0, *, skip: frozenset[str] = frozenset(("script", "style", "head"))) -> str:
    """Markdown: underlined first- and second-level headings, ``*`` bullets, ``**`` bold, inline links and images, pipe tables."""
    blocks: list[str] = []  # finished pieces; each entry of a frame's list is text
    frames: list[tuple[int, list[str]]] = []

    def flat(s: str) -> str:
        return re.sub(r"\s+", " ", s)

    def finish(k: int, inner: str) -> str:
        tag = tree.tag[k]
        stripped = inner.strip()
        if tag in _HEADING:
            if not stripped:
                return ""
            text = flat(stripped)
            if _HEADING[tag] <= 2:
                return f"\n\n{text}\n{('=' if tag == 'h1' else '-') * len(text)}\n\n"
            return f"\n\n{'#' * _HEADING[tag]} {text}\n\n"
        if tag in _MARK and stripped:
            lead, tail = inner[: len(inner) - len(inner.lstrip())], inner[len(inner.rstrip()) :]
            return f"{lead}{_MARK[tag]}{stripped}{_MARK[tag]}{tail}"
        if tag == "a":
            href = tree.attr(k, "href")
            return f"[{stripped}]({href})" if href and stripped else inner
        if tag == "img":
            return f"![{tree.attr(k, 'alt', '')}]({tree.attr(k, 'src', '')})"
        if tag == "br":
            return "  \n"
        if tag == "hr":
            return "\n\n---\n\n"
        if tag == "pre":
            return f"\n\n```\n{inner.strip(chr(10))}\n```\n\n"
        if tag == "blockquote":
            return "\n\n" + "\n".join(f"> {x}" for x in stripped.splitlines()) + "\n\n" if stripped else ""
        if tag == "li":
            ordered = tree.parent[k] >= 0 and tree.tag[tree.parent[k]] == "ol"
            mark = f"{tree.place[1][k]}. " if ordered else "* "
            lines = stripped.splitlines() or [""]
            return mark + "\n".join([lines[0], *("  " + x if x.strip() else x for x in lines[1:])]) + "\n"
        if tag in ("ul", "ol"):
            return "\n\n" + inner.strip("\n") + "\n\n" if stripped else ""
        if tag in ("td", "th"):
            return f" {flat(stripped)} |"
        if tag == "tr":
            row = "|" + inner.rstrip() + "\n"
            first = tree.place[1][k] == 1 and (tree.tag[tree.parent[k]] in ("table", "thead") or not _has_head(tree, k))
            return row + ("|" + " --- |" * inner.count(" |") + "\n" if first else "")
        if tag == "table":
            return "\n\n" + inner.strip("\n") + "\n\n"
        return f"\n\n{inner.strip()}\n\n" if tag in _BREAKS and stripped else inner

    def text(owner: int, s: str | None) -> str:
        if not s:
            return ""
        inside_pre = any(tree.tag[a] == "pre" for a in (owner, *tree.ancestors(owner)))
        return s if inside_pre else flat(s)

    def close() -> None:
        k, parts = frames.pop()
        done = "" if tree.tag[k] in skip or tree.tag[k] == "#comment" else finish(k, "".join(parts))
        if k != i:
            done += text(max(tree.parent[k], 0), tree.tail[k])
        (frames[-1][1] if frames else blocks).append(done)

    for k in range(i, tree.end[i] + 1):
        while frames and tree.end[frames[-1][0]] < k:
            close()
        frames.append((k, [text(k, tree.text[k])]))
    while frames:
        close()
    return re.sub(r"\n{3,}", "\n\n", "".join(blocks)).strip("\n")


def _has_head(tree: Tree, row: int) -> bool:
    table = next((a for a in tree.ancestors(row) if tree.tag[a] == "table"), None)
    return table is not None and any(tree.tag[c] == "thead" for c in tree.children[table])
