"""A regular expression from example strings.

Over a grouped table the examples never meet in one list: the identical case, the
common prefix and suffix and the shortest length come from min and max aggregates
(the common prefix of a set is that of its least and greatest member), and the digit
template from one example and a count of those it covers.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = "()[]{}?*+-|^$\\.&~# \t\n\r\v\f"


def common_prefix(a: str, b: str) -> str:
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[:n]


def digit_template(example: str) -> str:
    return re.sub(r"\d+", lambda m: r"\d+", re.escape(example))


def covers(template: str, example: str, strict: bool = True) -> bool:
    """strict: the template is tried on the escaped example, so only examples without special characters can pass."""
    return re.match(f"^{template}$", re.escape(example) if strict else example) is not None


def _decide(one: str, same: bool, covered: bool, prefix: str, suffix: str, shortest: int) -> str:
    if same:
        return re.escape(one)
    if covered:
        return digit_template(one)
    if prefix or suffix:
        gap = ".*?" if len(prefix) + len(suffix) < shortest else ".*"
        return f"^{re.escape(prefix)}{gap}{re.escape(suffix)}$"
    return ".*"


def induce(examples: list[str], *, strict: bool = True) -> str:
    """The expression for a list; empty for no (non-blank) example."""
    kept = [s.strip() for s in examples if s and s.strip()]
    if not kept:
        return ""
    back = [s[::-1] for s in kept]
    prefix, suffix = common_prefix(min(kept), max(kept)), common_prefix(min(back), max(back))[::-1]
    return _decide(kept[0], len(set(kept)) == 1, all(covers(digit_template(kept[0]), s, strict) for s in kept), prefix, suffix[:], min(map(len, kept)))


def induce_by(df: DataFrame, group: str, value: str, *, order: str | None = None, strict: bool = True) -> DataFrame:
    """(group, regex) for each group; order picks the example that makes the digit template (default: the least value)."""
    kept = df.select(group, F.trim(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")).alias("s"), F.col(order or value).alias("o")).where("s IS NOT NULL AND s <> ''")
    back = F.reverse("s")
    stats = kept.groupBy(group).agg(F.min_by("s", "o").alias("one"), F.min("s").alias("low"), F.max("s").alias("high"), F.min(back).alias("b_low"), F.max(back).alias("b_high"), F.min(F.length("s")).alias("shortest"))
    # the digit template in the JVM: runs of digits become one mark on both sides; special characters rule it out if strict
    mark = lambda c: F.regexp_replace(c, r"\d+", "\u0000")
    special = F.rlike("s", F.lit("[" + re.escape(SPECIAL) + "]"))
    fits = (mark("s") == mark("one")) & (~special if strict else F.lit(True))
    covered = kept.join(stats.select(group, "one"), group).groupBy(group).agg(F.min(fits).alias("covered"))

    def run(one: pa.Array, low: pa.Array, high: pa.Array, b_low: pa.Array, b_high: pa.Array, shortest: pa.Array, covered: pa.Array) -> pa.Array:
        rows = zip(*(c.to_pylist() for c in (one, low, high, b_low, b_high, shortest, covered)), strict=True)
        return pa.array([_decide(o, lo == hi, c, common_prefix(lo, hi), common_prefix(bl, bh)[::-1], n) for o, lo, hi, bl, bh, n, c in rows], pa.string())

    run.__annotations__ = dict.fromkeys(("one", "low", "high", "b_low", "b_high", "shortest", "covered"), pa.Array) | {"return": pa.Array}
    regex = F.arrow_udf(run, "string")("one", "low", "high", "b_low", "b_high", "shortest", "covered")
    return stats.join(covered, group).select(group, regex.alias("regex"))
