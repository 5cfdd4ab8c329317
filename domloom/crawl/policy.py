"""Rules over requests, responses and items, each a filter or projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domloom.functions import http
from domloom.functions import url as urls

MAX_RETRIES = 3


def allowed(reqs: DataFrame, domains: list[str]) -> DataFrame:
    """Adds ``allowed``: the domain (with port, as written) is one of the domains or below one."""
    return reqs.withColumn("allowed", urls.in_domains(urls.domain("url"), domains))


def offsite(reqs: DataFrame, domains: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of requests that callbacks gave; seeds and retries are not asked."""
    marked = allowed(reqs, domains)
    return marked.where("allowed").drop("allowed"), marked.where("NOT allowed").drop("allowed")


def retries(done: DataFrame, *, max_retries: int = MAX_RETRIES, blocked: Column | None = None) -> DataFrame:
    """New requests for blocked responses (request columns and status): one more retry, one less priority, no filter, no proxy."""
    test = http.is_blocked("status") if blocked is None else blocked
    again = done.where(test & (F.col("retry_count") < max_retries))
    meta = F.map_filter(F.coalesce("meta", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("proxy", "proxies"))
    return again.withColumns({"retry_count": F.col("retry_count") + 1, "priority": F.col("priority") - 1, "dont_filter": F.lit(True), "meta": meta})


def with_session(reqs: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests without a session id get the default one; ``known`` tells whether the session exists."""
    default = sessions.where("is_default").agg(F.min("sid")).first()[0]
    named = reqs.withColumn("sid", F.coalesce(F.nullif("sid", F.lit("")), F.lit(default)))
    return named.join(sessions.select("sid", F.lit(True).alias("known")), "sid", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def sessions(spark, rows: list[tuple[str, str]], default: str | None = None) -> DataFrame:
    """The table of sessions; the first is the default unless another is named, a name twice is an error."""
    names = [r[0] for r in rows]
    if len(set(names)) < len(names):
        raise ValueError("a session is already registered under this id")
    if default is not None and default not in names:
        raise KeyError(default)
    chosen = default if default is not None else names[0] if names else None
    return spark.createDataFrame([(sid, kind, sid == chosen) for sid, kind in rows], "sid string, kind string, is_default boolean")


def keep_items(items: DataFrame, hook: Column | None = None, column: str = "item") -> tuple[DataFrame, DataFrame]:
    """(scraped, dropped): the hook gives the item to keep; null and empty maps are dropped."""
    made = items.withColumn(column, hook) if hook is not None else items
    kind = dict(made.dtypes)[column]
    falsy = F.col(column).isNull()
    if kind.startswith("map") or kind.startswith("array"):
        falsy |= F.size(column) == 0
    elif kind == "variant":
        falsy |= F.to_json(column).isin("{}", "null")
    return made.where(~falsy), made.where(falsy)


def rotate(reqs: DataFrame, proxies: list[str], order: str = "seq") -> DataFrame:
    """Proxies in turn by order."""
    return reqs.withColumn("proxy", F.get(F.array(*[F.lit(p) for p in proxies]), F.pmod(F.col(order), F.lit(len(proxies))).cast("int")))


def proxy_state(outcomes: DataFrame, minutes: int = 5) -> DataFrame:
    """(proxy, uses, failures, quarantine_until) of a log (proxy, ts, ok): a last failure closes a proxy for some minutes."""
    last = F.max_by("ok", "ts")
    until = F.when(~last, F.max("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes)))
    return outcomes.groupBy("proxy").agg(F.count("*").alias("uses"), F.count_if(~F.col("ok")).alias("failures"), until.alias("quarantine_until"))


def active_proxies(state: DataFrame, now: Column) -> DataFrame:
    return state.where(F.col("quarantine_until").isNull() | (F.col("quarantine_until") <= now))


def least_used(state: DataFrame, now: Column) -> DataFrame:
    """One row: the open proxy with the fewest uses, by name among equals."""
    return active_proxies(state, now).orderBy("uses", "proxy").limit(1)
