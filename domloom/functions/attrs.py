"""Functions on attribute maps (MAP<STRING,STRING>), all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def get(attrs: ColumnLike, name: str, default: str | None = None) -> Column:
    return F.coalesce(F.element_at(_c(attrs), name), F.lit(default))


def has(attrs: ColumnLike, name: str) -> Column:
    return F.map_contains_key(_c(attrs), name)


def length(attrs: ColumnLike) -> Column:
    return F.size(_c(attrs))


def keys(attrs: ColumnLike) -> Column:
    return F.map_keys(_c(attrs))


def search_values(attrs: ColumnLike, keyword: str, *, partial: bool = False) -> Column:
    """The attributes whose value is, or contains, the keyword."""
    return F.map_filter(_c(attrs), lambda k, v: F.contains(v, F.lit(keyword)) if partial else v == keyword)


def json_string(attrs: ColumnLike) -> Column:
    return F.to_json(_c(attrs))


def get_list(attrs: ColumnLike, name: str, separator: str = " ") -> Column:
    """The value's parts, stripped, empty ones left out; empty if the attribute is missing."""
    parts = F.split(F.coalesce(F.element_at(_c(attrs), name), F.lit("")), "\\Q" + separator + "\\E")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def has_class(attrs: ColumnLike, name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(F.element_at(_c(attrs), "class"), r"\s+"), name), F.lit(False))


def key_jaccard(a: ColumnLike, b: ColumnLike) -> Column:
    """Shared attribute names over all names; null if neither has any."""
    x, y = F.map_keys(_c(a)), F.map_keys(_c(b))
    return F.try_divide(F.size(F.array_intersect(x, y)), F.nullif(F.size(F.array_union(x, y)), F.lit(0)))
