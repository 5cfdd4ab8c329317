"""Pages as tables: node and text tables, fused selection, responses.

A page is parsed in one Arrow pass.  For known selectors use ``select``: it
parses and selects in the worker and nothing is shuffled.  For ad-hoc and cross-page
work use ``parse_pages``; every later join, window and aggregation keys on page_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom import schemas
from domloom.dom.tree import Tree, parse

ALL = tuple(c.split()[0] for c in schemas.NODES.replace("map<string,string>", "map").split(", "))
_TYPES = {
    "page_id": pa.int64(),
    "tag": pa.string(),
    "attrs": pa.map_(pa.string(), pa.string()),
    "attr_names": pa.list_(pa.string()),
    "attr_values": pa.list_(pa.string()),
    "text": pa.string(),
    "tail": pa.string(),
    "path": pa.list_(pa.string()),
    "anc": pa.list_(pa.int32()),
    "string": pa.string(),
    "html": pa.string(),
}
_DDL = {"path": "array<string>", "anc": "array<int>", "string": "string", "html": "string"} | dict(c.split(" ", 1) for c in schemas.NODES.split(", "))


def tree_of(html: str | bytes | None, **options) -> Tree:
    return parse(html if html is not None else "", **options)


def node_columns(tree: Tree, page_id: int, want: Iterable[str], keep: list[int]) -> dict[str, list]:
    """Columns of the nodes kept; path, anc, string and html are computed only if wanted."""
    sib, of_type = tree.place
    out: dict[str, list] = {}
    for c in want:
        match c:
            case "page_id":
                out[c] = [page_id] * len(keep)
            case "pre":
                out[c] = keep
            case "end" | "level" | "parent" | "tag" | "text" | "tail":
                held = getattr(tree, c)
                out[c] = [held[i] for i in keep]
            case "attr_names":
                out[c] = [tree.names[i] for i in keep]
            case "attr_values":
                out[c] = [tree.values[i] for i in keep]
            case "attrs":
                out[c] = [list(zip(tree.names[i], tree.values[i], strict=True)) for i in keep]
            case "sib":
                out[c] = [sib[i] for i in keep]
            case "nth_of_type":
                out[c] = [of_type[i] for i in keep]
            case "n_children":
                out[c] = [len(tree.children[i]) for i in keep]
            case "n_sib":
                out[c] = [len(tree.children[tree.parent[i]]) if tree.parent[i] >= 0 else 1 for i in keep]
            case "n_of_type":
                out[c] = [tree.of_type[i] for i in keep]
            case "path":
                out[c] = [tree.path(i) for i in keep]
            case "anc":
                out[c] = [tree.ancestors(i)[::-1] for i in keep]
            case "string":
                out[c] = [tree.string(i) for i in keep]
            case "html":
                from domloom.dom.serialize import outer_html

                out[c] = [outer_html(tree, i) for i in keep]
    return out


def parse_pages(
    pages: DataFrame, *, page_id: str = "page_id", html: str = "html", want: Iterable[str] = ALL, tags: Iterable[str] | None = None, attributes: Iterable[str] | None = None, **options
) -> DataFrame:
    """The node table of pages, one row per element.

    want: the columns (also path, anc, string, html).  tags and attributes push a
    filter into the parser: only nodes of these tags, or having one of these
    attributes, leave the worker.  Other options: encoding, keep_comments, keep_cdata.
    """
    want = list(dict.fromkeys(["page_id", "pre", *want]))
    wanted_tags, wanted_attrs = frozenset(tags or ()), frozenset(attributes or ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {c: [] for c in want}
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tree = tree_of(text.as_py(), **options)
                keep = [k for k in range(len(tree)) if not (wanted_tags or wanted_attrs) or tree.tag[k] in wanted_tags or not wanted_attrs.isdisjoint(tree.names[k])]
                for c, values in node_columns(tree, i, want, keep).items():
                    held[c] += values
                if len(held["pre"]) >= 20_000:
                    yield _batch(held)
                    held = {c: [] for c in want}
            yield _batch(held)

    return pages.select(F.col(page_id).cast("long"), F.col(html)).mapInArrow(run, ", ".join(f"{c} {_DDL[c]}" for c in want))


def _batch(held: Mapping[str, list]) -> pa.RecordBatch:
    return pa.record_batch({c: pa.array(v, _TYPES.get(c, pa.int32())) for c, v in held.items()})


def text_nodes(pages: DataFrame, *, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """The text table: every text node with its owner, in document order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(i, seq, *piece) for seq, piece in enumerate(tree_of(text.as_py()).pieces(0))]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()), strict=True)], ["page_id", "seq", "owner", "is_tail", "text"])

    return pages.select(F.col(page_id).cast("long"), F.col(html)).mapInArrow(run, schemas.TEXT_NODES)


def per_page(f: Callable[[Tree, dict], object], result: pa.DataType, ddl: str, html: str | Column = "html", **columns: str | Column) -> Column:
    """A column computed from each page's tree; further columns arrive as a dict of values."""
    names = list(columns)

    def run(texts: pa.Array, *rest: pa.Array) -> pa.Array:
        others = [r.to_pylist() for r in rest]
        return pa.array([f(tree_of(t.as_py()), dict(zip(names, x, strict=True))) for t, *x in zip(texts, *others, strict=True)], result)

    # the number of arguments must show in the signature
    call = {0: lambda a: run(a), 1: lambda a, b: run(a, b), 2: lambda a, b, c: run(a, b, c), 3: lambda a, b, c, d: run(a, b, c, d)}[len(names)]
    call.__annotations__ = dict.fromkeys(call.__code__.co_varnames[: 1 + len(names)], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(call, ddl)(html, *columns.values())


def select(html: str | Column = "html", /, **selectors) -> Column:
    """A struct of ARRAY<STRING>, one field per selector; all run over one parse.

    A value is a CSS string, ``xpath("...", **variables)``, or ``css("...")``; elements
    give their outer HTML, ``::text``, ``::attr()``, ``@x`` and ``text()`` their strings.
    """
    from domloom.selection import api

    plans = {name: api.compiled(s) for name, s in selectors.items()}
    kind = pa.struct([(n, pa.list_(pa.string())) for n in plans])
    ddl = "struct<" + ",".join(f"`{n}`:array<string>" for n in plans) + ">"
    return per_page(lambda tree, _: {n: plan.strings(tree) for n, plan in plans.items()}, kind, ddl, html)


def responses(raw: DataFrame) -> DataFrame:
    """Raw HTTP rows (url, status, body and any of the other columns) in the responses schema.

    A missing encoding is read from the content-type header, else utf-8; a missing reason is the status phrase.
    """
    from domloom.functions.http import charset_of, status_text

    have = set(raw.columns)
    col = lambda n, kind: F.col(n).cast(kind) if n in have else F.lit(None).cast(kind)
    headers = col("headers", "map<string,string>")
    kind = F.element_at(F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]), e["value"]))), "content-type")
    strings = "map<string,string>"
    return raw.select(
        F.col("url"),
        F.col("status").cast("int").alias("status"),
        F.coalesce(col("reason", "string"), status_text("status")).alias("reason"),
        (F.encode("body", "UTF-8") if dict(raw.dtypes).get("body") == "string" else col("body", "binary")).alias("body"),
        F.coalesce(col("encoding", "string"), charset_of(kind)).alias("encoding"),
        headers.alias("headers"),
        col("request_headers", strings).alias("request_headers"),
        col("cookies", strings).alias("cookies"),
        F.coalesce(col("method", "string"), F.lit("GET")).alias("method"),
        F.transform(
            F.coalesce(col("history", "array<struct<url:string,status:int,reason:string>>"), F.array().cast("array<struct<url:string,status:int,reason:string>>")),
            lambda h: F.struct(h["url"].alias("url"), F.coalesce(h["status"], F.lit(301)).alias("status"), F.coalesce(h["reason"], status_text(F.coalesce(h["status"], F.lit(301)))).alias("reason")),
        ).alias("history"),
        F.coalesce(col("meta", strings), F.create_map().cast(strings)).alias("meta"),
    )


def pages_of(responses: DataFrame) -> DataFrame:
    """(page_id, url, html) of responses, the body decoded by its encoding; ids hash the url."""

    def run(bodies: pa.Array, encodings: pa.Array) -> pa.Array:
        def one(b: bytes | None, e: str | None) -> str | None:
            if b is None:
                return None
            try:
                return b.decode(e or "utf-8", "replace")
            except LookupError:
                return b.decode("utf-8", "replace")

        return pa.array([one(b, e) for b, e in zip(bodies.to_pylist(), encodings.to_pylist(), strict=True)], pa.string())

    run.__annotations__ = {"bodies": pa.Array, "encodings": pa.Array, "return": pa.Array}
    decode = F.arrow_udf(run, "string")
    return responses.select(F.xxhash64("url").alias("page_id"), "url", decode("body", "encoding").alias("html"))
