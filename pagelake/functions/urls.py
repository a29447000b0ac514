"""URL functions as native expressions, and resolution of relative links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from pagelake.functions.transforms import col

#: parameters that only track a visit
TRACKING = frozenset("_ga _hsenc _hsmi dclid fbclid gbraid gclid gclsrc igshid mc_cid mc_eid mkt_tok msclkid oly_anon_id oly_enc_id ref referrer s_kwcid source twclid utm_campaign utm_content utm_id utm_medium utm_name utm_source utm_source_platform utm_term vero_id wbraid wickedid yclid ysclid".split())
PARTS = r"^(?i)(https?)://(?:[^/?#@]*@)?([^/?#:]+)(?::(\d+))?([^?#]*)(?:\?([^#]*))?"


def _part(u: Column, g: int) -> Column:
    return F.regexp_extract(u, PARTS, g)


def is_web(u) -> Column:
    return F.rlike(F.trim(col(u)), F.lit(PARTS))


def host(u) -> Column:
    return F.when(is_web(u), F.lower(_part(F.trim(col(u)), 2)))


def _named(u, make) -> Column:
    """make(scheme, host, port, path, query) of a web URL, null of another text. The parts are taken once and named, so an
    expression may use them as often as it likes."""
    parts = F.regexp_replace(F.trim(col(u)), "(?s)" + PARTS + ".*$", "$1\x01$2\x01$3\x01$4\x01$5")
    return F.transform(F.array(F.split(parts, "\x01")), lambda p: F.when(F.size(p) == 5, make(*[F.get(p, F.lit(i)) for i in range(5)])))[0]


def _base(scheme: Column, host: Column, port: Column) -> Column:
    """scheme://host, with the port where it isn't the usual one."""
    whole = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.lit(":"), port)
    return F.regexp_replace(whole, r"^(http://[^:]*):(?:80)?$|^(https://[^:]*):(?:443)?$", "$1$2")


def origin(u) -> Column:
    return _named(u, lambda scheme, host, port, path, query: _base(scheme, host, port))


def canonical(u, strip_www: bool = False, lowercase_path: bool = False, strip_params=(), keep_params=()) -> Column:
    """One spelling of a web URL: no fragment, default port, tracking parameter, doubled or trailing slash; sorted query."""
    drop = sorted((TRACKING | set(strip_params)) - set(keep_params))
    key = lambda p: F.lower(F.substring_index(p, "=", 1))

    def make(scheme, host, port, path, query):
        path = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/{2,}", "/"), "(?<!^)/$", ""), "^$", "/")
        query = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~key(p).isin(drop))), "&")
        base = _base(scheme, host, port)
        base = F.regexp_replace(base, r"://www\.", "://") if strip_www else base
        return F.concat(base, F.lower(path) if lowercase_path else path, F.regexp_replace(F.concat(F.lit("?"), query), r"^\?$", ""))

    return _named(u, make)


def path_depth(u) -> Column:
    return F.size(F.filter(F.split(_part(F.trim(col(u)), 4), "/"), lambda p: p != ""))


def shorten(u, most: int = 70) -> Column:
    c, head = col(u), int(most * 0.6)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit("..."), F.right(c, F.lit(most - head - 3))))


def same_domain(h, d) -> Column:
    a, b = (F.regexp_replace(F.lower(col(x)), "^www\\.", "") for x in (h, d))
    return (a == b) | F.endswith(a, F.concat(F.lit("."), b))


def compile_pattern(p: str) -> str:
    """A pattern of a rule as a Java regex: /regex/flags, a glob, or a regex that is taken literally if it isn't one."""
    m = re.fullmatch(r"/(.*)/([a-z]*)", p, re.S)
    if m:
        return (f"(?{m[2].replace('g', '').replace('u', '')})" if m[2].strip("gu") else "") + m[1]
    if "*" in p or "?" in p:
        return "(?i)^" + re.escape(p).replace(r"\*", ".*").replace(r"\?", ".") + "$"
    try:
        re.compile(p)
        return "(?i)" + p
    except re.error:
        return "(?i)" + re.escape(p)


def matches_any(u, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.rlike(col(u), F.lit(compile_pattern(p)))
    return found


def verdict(u, allowed_domains=(), allow=(), deny=()) -> Column:
    """Why a URL may be followed or not: ok, invalid, off-domain, denied, not-allowed."""
    h, on = host(u), F.lit(not allowed_domains)
    for d in allowed_domains:
        on = on | same_domain(h, F.lit(d))
    return (
        F.when(h.isNull(), "invalid").when(~on, "off-domain").when(matches_any(u, deny), "denied").when(~(matches_any(u, allow) if allow else F.lit(True)), "not-allowed").otherwise("ok")
    )


def resolve_text(href: str | None, base: str | None) -> str | None:
    """A link against its page's address; null for what isn't a page."""
    from urllib.parse import urljoin, urlsplit

    h = (href or "").strip()
    if not h or h[0] == "#" or re.match(r"(?i)(?:javascript|mailto|tel|data|blob|about|sms|ftp|file):", h):
        return None
    try:
        out = urljoin(base or "", h)
        return out if urlsplit(out).scheme in ("http", "https") and urlsplit(out).netloc else None
    except ValueError:
        return None


@F.pandas_udf(StringType())
def _resolve(href: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([resolve_text(h, b) for h, b in zip(href, base)])


def resolve(href, base) -> Column:
    """Absolute and rooted links natively; only the rest goes to Python."""
    h, b = F.trim(col(href)), col(base)
    rooted = F.concat(F.regexp_extract(b, r"^([a-zA-Z]+://[^/?#]+)", 1), h)
    return F.when(h.rlike(r"^(?i)https?://[^/]"), h).when(h.rlike(r"^/[^/.]*$") & is_web(base), rooted).otherwise(_resolve(h, b))
