"""URL functions: joining, canonical form, domains, request fingerprints."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str

# Second-level public suffixes beside the one-label ones; a documented approximation.
SUFFIXES = frozenset("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp or.jp ne.jp ac.jp co.kr or.kr co.in org.in com.br org.br com.cn net.cn org.cn com.mx com.ar com.tr com.tw com.hk com.sg co.za github.io".split())


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def join_one(base: str | None, url: str | None) -> str | None:
    if url is None:
        return None
    try:
        return urljoin(base or "", url)
    except ValueError:
        return url


def canonical(url: str, keep_fragments: bool = False) -> str:
    """Scheme and host in lower case, default port and fragment gone, query pairs sorted, escapes normalised, empty path ``/``."""
    try:
        u = urlsplit(url.strip())
        host = (u.hostname or "").encode("idna").decode() if u.hostname and not u.hostname.isascii() else (u.hostname or "")
        port = u.port
    except (ValueError, UnicodeError):
        return url.strip()
    scheme = u.scheme.lower()
    at = "" if port is None or (scheme, port) in (("http", 80), ("https", 443)) else f":{port}"
    user = u.netloc.rpartition("@")[0]
    netloc = (user + "@" if user else "") + (f"[{host}]" if ":" in host else host) + at
    path = quote(unquote(u.path), safe="/:@!$&'()*+,;=-._~%" if "%25" in u.path else "/:@!$&'()*+,;=-._~") or ("/" if netloc else "")
    query = urlencode(sorted(parse_qsl(u.query, keep_blank_values=True)))
    return urlunsplit((scheme, netloc, path, query, quote(unquote(u.fragment), safe="/:@!$&'()*+,;=-._~?") if keep_fragments else ""))


def registered_domain(url: str | None) -> str | None:
    """Lower-cased registered domain: the public suffix and one label; null if there is no such host."""
    try:
        host = (urlsplit(url or "").hostname or "").lower().rstrip(".")
    except ValueError:
        return None
    if not host or "." not in host or re.fullmatch(r"[0-9.]+", host) or ":" in host:
        return None
    labels = host.split(".")
    n = 3 if ".".join(labels[-2:]) in SUFFIXES and len(labels) > 2 else 2
    return ".".join(labels[-n:])


def _udf(f, ddl: str = "string", n: int = 1):
    def one(a: pa.Array) -> pa.Array:
        return pa.array([f(x) for x in a.to_pylist()], pa.string())

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([f(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.string())

    run = one if n == 1 else two
    run.__annotations__ = dict.fromkeys("ab"[:n], pa.Array) | {"return": pa.Array}
    return F.arrow_udf(run, ddl)


def absolute(base: ColumnLike, url: ColumnLike) -> Column:
    """url resolved against base by the rules of RFC 3986."""
    return _udf(join_one, n=2)(_c(base), _c(url))


def canonical_url(url: ColumnLike, keep_fragments: bool = False) -> Column:
    return _udf(lambda u: None if u is None else canonical(u, keep_fragments))(_c(url))


def domain(url: ColumnLike) -> Column:
    """Host with port and user information, as it stands in the url; null if the url is bad."""
    return F.try_parse_url(_c(url), F.lit("AUTHORITY"))


def site(url: ColumnLike, default: str = "default") -> Column:
    """The registered domain, else the default."""
    return F.coalesce(_udf(registered_domain)(_c(url)), F.lit(default))


def identifier_hash(identifier: ColumnLike) -> Column:
    """sha256 of the lower-cased, stripped text, an underscore and its length in bytes."""
    c = F.lower(F.trim(_c(identifier)))
    return F.concat(F.sha2(c, 256), F.lit("_"), F.octet_length(c).cast("string"))


def in_domains(url_domain: ColumnLike, allowed: list[str]) -> Column:
    """Equal to an allowed domain or below it; no allowed domains allow all."""
    d = _c(url_domain)
    if not allowed:
        return F.lit(True)
    test = F.lit(False)
    for a in allowed:
        test |= (d == a) | F.endswith(d, F.lit("." + a))
    return F.coalesce(test, F.lit(False))


def fingerprint(
    url: ColumnLike, *, sid: ColumnLike | None = None, method: ColumnLike | None = None, body: ColumnLike | None = None, headers: ColumnLike | None = None, kwargs: ColumnLike | None = None, keep_fragments: bool = False
) -> Column:
    """20 bytes: SHA-1 over compact JSON with sorted keys of body (hex), headers, kwargs, method, sid and canonical url.

    headers (MAP) and kwargs (ARRAY of names) take part only if given; both are
    lower-cased and sorted, so the result does not depend on their order.
    """
    text = lambda c, default: F.coalesce(_c(c).cast("string") if c is not None else F.lit(None).cast("string"), F.lit(default))
    raw = F.lit(b"") if body is None else F.coalesce(_c(body).cast("binary"), F.lit(b""))
    fields = [F.lower(F.hex(raw)).alias("body")]
    hexed = lambda s: F.lower(F.hex(F.encode(F.lower(s), "UTF-8")))
    if headers is not None:
        pairs = F.transform(F.map_entries(_c(headers)), lambda e: F.array(hexed(e["key"]), hexed(e["value"])))
        fields.append(F.coalesce(F.array_sort(pairs), F.array().cast("array<array<string>>")).alias("headers"))
    if kwargs is not None:
        names = F.array_sort(F.array_distinct(F.transform(F.filter(_c(kwargs), lambda k: ~F.lower(k).isin("data", "json")), hexed)))
        fields.append(F.coalesce(F.array_join(names, ""), F.lit("")).alias("kwargs"))
    fields += [text(method, "GET").alias("method"), text(sid, "").alias("sid"), F.coalesce(canonical_url(url, keep_fragments), F.lit("")).alias("url")]
    return F.unhex(F.sha1(F.to_json(F.struct(*fields))))
