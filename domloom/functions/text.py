"""Text functions on columns.  Everything stays in the JVM unless its name is in ``PYTHON``."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

PYTHON = ("decode_entities", "normalize", "casefold", "expandtabs", "translate_map", "format_text")
ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def arrow_strings(f: Callable[[str], object], c: ColumnLike, ddl: str = "string", kind: pa.DataType | None = None) -> Column:
    """A per-value Python function, Arrow batches in and out; null stays null."""

    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if s is None else f(s) for s in a.to_pylist()], kind or pa.string())

    run.__annotations__ = {"a": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, ddl)(_c(c))


# ---- cleaning

def clean(c: ColumnLike, remove_entities: bool = False) -> Column:
    """Tab, CR and LF become blanks, runs of blanks one, ends are stripped; remove_entities decodes references."""
    out = F.trim(F.regexp_replace(F.translate(_c(c), "\t\r\n", "   "), " +", " "))
    return decode_entities(out) if remove_entities else out


def clean_spaces(c: ColumnLike) -> Column:
    """Tab becomes a blank, CR and LF go, runs of blanks become one; ends stay."""
    return F.regexp_replace(F.translate(_c(c), "\t\n\r", " "), " +", " ")


def squeeze(c: ColumnLike) -> Column:
    """Any run of white space becomes one blank; ends are stripped."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))


def decode_entities(c: ColumnLike) -> Column:
    c = _c(c)
    return F.when(F.contains(c, F.lit("&")), arrow_strings(html.unescape, c)).otherwise(c)


def normalize(c: ColumnLike, form: str = "NFKC") -> Column:
    return arrow_strings(lambda s: unicodedata.normalize(form, s), c)


# ---- regular expressions

def java_pattern(pattern: str | re.Pattern, case_sensitive: bool = True) -> str:
    """A Python pattern with the JVM's flags for Unicode classes and, if asked, for any case."""
    flags = "U"
    if isinstance(pattern, re.Pattern):
        case_sensitive = case_sensitive and not pattern.flags & re.I
        flags += ("s" if pattern.flags & re.S else "") + ("m" if pattern.flags & re.M else "") + ("x" if pattern.flags & re.X else "")
        pattern = pattern.pattern
    pattern = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
    return f"(?{flags}{'' if case_sensitive else 'iu'}){pattern}"


def re_all(c: ColumnLike, pattern: str | re.Pattern, *, replace_entities: bool = True, clean_match: bool = False, case_sensitive: bool = True) -> Column:
    """All matches; the groups of a pattern with groups, one after the other."""
    c = _c(c)
    c = clean(c, replace_entities) if clean_match else decode_entities(c) if replace_entities else c
    java, groups = F.lit(java_pattern(pattern, case_sensitive)), re.compile(pattern).groups
    if groups < 2:
        return F.regexp_extract_all(c, java, F.lit(groups))
    each = [F.regexp_extract_all(c, java, F.lit(g)) for g in range(1, groups + 1)]
    zipped = F.arrays_zip(*each)  # the strings must not appear inside the lambda: decoding is a Python function
    return F.flatten(F.transform(zipped, lambda z: F.array(*[z.getField(str(g)) for g in range(groups)])))


def re_first(c: ColumnLike, pattern: str | re.Pattern, default: str | None = None, **options) -> Column:
    return F.coalesce(F.get(re_all(c, pattern, **options), 0), F.lit(default))


def re_test(c: ColumnLike, pattern: str | re.Pattern, *, case_sensitive: bool = True) -> Column:
    return F.rlike(_c(c), F.lit(java_pattern(pattern, case_sensitive)))


def re_each(strings: ColumnLike, pattern: str | re.Pattern, **options) -> Column:
    """All matches of all strings of an array, flat."""
    options.setdefault("replace_entities", False)  # the array form stays in the JVM
    return F.flatten(F.transform(_c(strings), lambda s: re_all(s, pattern, **options)))


def re_each_first(strings: ColumnLike, pattern: str | re.Pattern, default: str | None = None, **options) -> Column:
    return F.coalesce(F.get(re_each(strings, pattern, **options), 0), F.lit(default))


# ---- numbers and JSON

def to_int(c: ColumnLike) -> Column:
    """The digits of a text (a leading minus counts), null if there are none."""
    return F.nullif(F.regexp_replace(_c(c), r"[^0-9-]", ""), F.lit("")).try_cast("bigint")


def to_float(c: ColumnLike) -> Column:
    return F.nullif(F.regexp_replace(_c(c), r"[^0-9.-]", ""), F.lit("")).try_cast("double")


def json(c: ColumnLike) -> Column:
    """The text as VARIANT; null if it is not JSON."""
    return F.try_parse_json(_c(c))


def first_json(*columns: ColumnLike) -> Column:
    """The first of the texts that is JSON (of a page: body, text, all text)."""
    return F.coalesce(*[json(c) for c in columns])


# ---- string methods

def sort_chars(c: ColumnLike) -> Column:
    return F.array_join(F.array_sort(F.split(_c(c), "")), "")


def capitalize(c: ColumnLike) -> Column:
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**30)))


def casefold(c: ColumnLike) -> Column:
    return arrow_strings(str.casefold, c)


def swapcase(c: ColumnLike) -> Column:
    return F.array_join(F.transform(F.split(_c(c), ""), lambda x: F.when(x == F.upper(x), F.lower(x)).otherwise(F.upper(x))), "")


def center(c: ColumnLike, width: int, fill: str = " ") -> Column:
    c = _c(c)
    pad = F.greatest(F.lit(width) - F.length(c), F.lit(0))
    left = F.floor((pad + (pad % 2) * F.lit(width % 2)) / 2).cast("int")  # an odd blank goes left if the width is odd
    return F.concat(F.repeat(F.lit(fill), left), c, F.repeat(F.lit(fill), (pad - left).cast("int")))


def ljust(c: ColumnLike, width: int, fill: str = " ") -> Column:
    c = _c(c)
    return F.concat(c, F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.length(c), F.lit(0))))


def rjust(c: ColumnLike, width: int, fill: str = " ") -> Column:
    c = _c(c)
    return F.concat(F.repeat(F.lit(fill), F.greatest(F.lit(width) - F.length(c), F.lit(0))), c)


def zfill(c: ColumnLike, width: int) -> Column:
    c = _c(c)
    sign = F.when(F.substring(c, 1, 1).isin("+", "-"), F.substring(c, 1, 1)).otherwise("")
    zeros = F.repeat(F.lit("0"), F.greatest(F.lit(width) - F.length(c), F.lit(0)))
    return F.concat(sign, zeros, F.substring(c, F.length(sign) + 1, F.length(c)))


def expandtabs(c: ColumnLike, size: int = 8) -> Column:
    return arrow_strings(lambda s: s.expandtabs(size), c)


def title(c: ColumnLike) -> Column:
    return F.initcap(F.lower(_c(c)))


def translate_map(c: ColumnLike, table: dict[int, str | int | None]) -> Column:
    return arrow_strings(lambda s: s.translate(table), c)


def format_text(c: ColumnLike, **values) -> Column:
    """str.format with constant values."""
    return arrow_strings(lambda s: s.format(**values), c)


def strip(c: ColumnLike, chars: str | None = None) -> Column:
    return F.btrim(_c(c), F.lit(chars)) if chars else F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def lstrip(c: ColumnLike, chars: str | None = None) -> Column:
    return F.ltrim(_c(c), F.lit(chars)) if chars else F.regexp_replace(_c(c), r"(?U)^\s+", "")


def rstrip(c: ColumnLike, chars: str | None = None) -> Column:
    return F.rtrim(_c(c), F.lit(chars)) if chars else F.regexp_replace(_c(c), r"(?U)\s+$", "")


def split(c: ColumnLike, separator: str | None = None) -> Column:
    if separator is not None:
        return F.split(_c(c), re.escape(separator))
    return F.filter(F.split(_c(c), r"(?U)\s+"), lambda s: s != "")


def replace(c: ColumnLike, old: str, new: str) -> Column:
    return F.replace(_c(c), F.lit(old), F.lit(new))


def join(separator: str, strings: ColumnLike) -> Column:
    return F.array_join(_c(strings), separator)


def contains(c: ColumnLike, text: str, *, case_sensitive: bool = True) -> Column:
    return F.contains(_c(c), F.lit(text)) if case_sensitive else F.contains(F.lower(_c(c)), F.lit(text.lower()))


# ---- lists of strings

def get(strings: ColumnLike, default: str | None = None) -> Column:
    return F.coalesce(F.get(_c(strings), 0), F.lit(default))


def last(strings: ColumnLike, default: str | None = None) -> Column:
    return F.coalesce(F.try_element_at(_c(strings), F.lit(-1)), F.lit(default))


def length(strings: ColumnLike) -> Column:
    return F.size(_c(strings))
