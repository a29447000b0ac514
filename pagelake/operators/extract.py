"""Extraction: pages to typed records.

A page is parsed once, in one Arrow UDF that reads the raw strings of every field and fallback of a recipe. All that
follows (regex, transforms, fallback chain, default, type, issues) is native columns. The UDF sits in a projection, so
column pruning and filters still reach the scan.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelake.functions import dates, urls
from pagelake.functions.transforms import _each, apply_transforms
from pagelake.session import ship

RAW = "array<struct<raw:array<array<string>>,shown:array<boolean>>>"
INHERITED = ("transform", "type", "default", "required", "all", "keepEmpty", "when")
SELF = (".", "&", ":scope", "")


def by_path(value, path: str):
    """a.b, a[0].b, a.*.b; a step into a list takes its first element unless it is an index or *."""
    for step in re.findall(r"[^.\[\]]+", path):
        if value is None:
            return None
        if step == "*":
            value = list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else None
            rest = path.split("*", 1)[1].lstrip(".")
            if value is None or not rest:
                return value
            found = [by_path(v, rest) for v in value]
            return [x for f in found if f is not None for x in (f if isinstance(f, list) else [f])]
        if isinstance(value, list):
            if step.isdigit():
                value = value[int(step)] if int(step) < len(value) else None
                continue
            value = value[0] if value else None
        value = value.get(step) if isinstance(value, dict) else None
    return value


def strategies(spec) -> list[dict]:
    """A field's own source and its fallbacks; a fallback replaces the source and inherits the rest."""
    spec = {"selector": spec} if isinstance(spec, str) else dict(spec)
    out = [spec]
    backs = spec.get("fallback", [])
    for f in backs if isinstance(backs, list) else [backs]:
        f = {"selector": f} if isinstance(f, str) else dict(f)
        out.append({k: spec[k] for k in INHERITED if k in spec} | f)
    return out


def _strings(v) -> list[str | None]:
    one = lambda x: x if isinstance(x, str) or x is None else json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else str(x).lower() if isinstance(x, bool) else str(x)
    return [one(x) for x in v] if isinstance(v, list) else [one(v)]


def read_source(s: dict, page, at) -> list[str] | None:
    """The raw strings of one strategy, in the container `at`; None if there are none."""
    from pagelake.html.page import read
    from pagelake.html.xpath import Attr, is_xpath, to_string, xpath

    if "const" in s:
        return _strings(s["const"])
    if src := s.get("from"):
        if src in ("jsonld", "microdata"):
            kind = s.get("entity")
            blocks = page.json_ld if src == "jsonld" else page.microdata
            blocks = [b for b in blocks if not kind or kind.lower() in [str(x).lower() for x in (b.get("@type") if isinstance(b.get("@type"), list) else [b.get("@type", "")])]]
            found = [by_path(b, s["path"]) if s.get("path") else b for b in blocks]
            found = [f for f in found if f is not None]
            return _strings(found[0]) if found and not s.get("all") else [x for f in found for x in _strings(f)] or None
        if src == "json":
            v = page.json()
            v = by_path(v, s["path"]) if s.get("path") else v
            return None if v is None else _strings(v)
        name = s.get("name", s.get("path", ""))
        v = {"url": lambda: page.url, "meta": lambda: page.meta.get(name.lower()), "og": lambda: page.open_graph().get(name), "text": page.text, "html": lambda: page.html, "title": page.title}.get(src, lambda: None)()
        return None if v is None else [v]
    selector, attr = s.get("xpath") or s.get("selector"), s.get("attr")
    home = at if at.tag != "#document" else next(iter(at.elements()), at)
    if selector is None and attr is None:
        return None
    if selector is None or selector.strip() in SELF:
        nodes = [home]
    elif "xpath" in s or is_xpath(selector):
        v = xpath(selector, at)
        if not isinstance(v, list):
            return [to_string(v)]
        nodes = v
    else:
        nodes = page.select(selector, at)
    nodes = nodes if s.get("all") else nodes[:1]
    found = [n.value if isinstance(n, Attr) else read(n, attr) for n in nodes]
    if "fields" in s:
        found = [json.dumps({k: next((x[0] for f in strategies(sub) if (x := read_source(f, page, n)) and x[0]), None) for k, sub in s["fields"].items()}, ensure_ascii=False) for n in nodes]
    found = [f for f in found if f is not None]
    return found or None


#: Characters of HTML that are read before their results are handed on, counting some for each page
SLICE, PAGE = 1 << 20, 2000


def sliced(batches: Iterator[tuple[pd.Series, pd.Series]], make: Callable) -> Iterator:
    """make(html, url) of a few pages at a time. Spark bounds what a batch brings in, but not what is read from it."""
    for html, url in batches:
        start, size = 0, 0
        for k, h in enumerate(html):
            size += PAGE + len(h or "")
            if size >= SLICE or k == len(html) - 1:
                yield make(html.iloc[start : k + 1], url.iloc[start : k + 1])
                start, size = k + 1, 0
        if not len(html):
            yield make(html, url)


def exploded(df: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    """A row per element of a reader's column. From a plain explode, Spark infers a filter on the column's size and pushes
    it below a repartition, so that every page is read there once more, by the few tasks of the scan; the outer one has none."""
    return df.select(*keep, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def reader(spec: dict):
    """The one UDF of a recipe. `references: closed` leaves character references without a semicolon as they are."""
    plan = [(name, strategies(f)) for name, f in spec.get("fields", {}).items()]
    container, closed = spec.get("container"), spec.get("references") == "closed"

    def records(html, url):
        from pagelake.html.page import Page

        page = Page(html, url, closed)
        out = []
        for at in page.select(container) if container else [page.doc]:
            raw, shown = [], []
            for _, ways in plan:
                when = ways[0].get("when")
                on = not when or page.exists(when["selector"], at) == when.get("exists", True)
                shown.append(on)
                for s in ways:
                    try:
                        raw.append(read_source(s, page, at) if on else None)
                    except ValueError:  # a strategy that fails leaves its turn to the next
                        raw.append(None)
            out.append({"raw": raw, "shown": shown})
        return out

    @F.pandas_udf(RAW)
    def read_records(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return sliced(batches, lambda html, url: pd.Series([records(h, u) for h, u in zip(html, url)], dtype=object))

    return read_records


def _regex(c: Column, spec) -> Column:
    spec = {"pattern": spec} if isinstance(spec, str) else spec
    groups = re.compile(spec["pattern"]).groups
    group = spec.get("group", 1)
    flags = "".join(f for f in spec.get("flags", "") if f in "ims")
    pattern = f"(?{flags})" * bool(flags) + spec["pattern"]
    return F.when(F.rlike(c, F.lit(pattern)), F.regexp_extract(c, pattern, group if group <= groups else 0))


def _typed(c: Column, kind: str | None, url: Column) -> Column:
    if kind in (None, "string", "any", "object", "array"):
        return c
    if kind in ("number", "float", "integer", "int"):
        s = F.trim(c.cast("string"))
        n = F.when(s == "", F.lit(0.0)).when(s.rlike("^0[xX][0-9a-fA-F]+$"), F.conv(F.substr(s, F.lit(3)), 16, 10).try_cast("double")).when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
        return n if kind in ("number", "float") else F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("long")
    if kind in ("boolean", "bool"):
        return F.when(c.isNotNull(), c.cast("string") != "")
    if kind == "url":
        return urls.resolve(c, url)
    if kind == "email":
        v = F.lower(F.trim(c))
        return F.when(v.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), v)
    if kind == "date":
        return dates.format_ms(dates.parse_date_ms(c))
    raise ValueError(f"unknown type {kind!r}")


def _nonempty(c: Column, many: bool) -> Column:
    return F.when(F.size(c) > 0, c) if many else F.when(c.cast("string") != "", c)


def _field(spec, k: int, shown: Column, url: Column) -> tuple[Column, Column]:
    """The value of a field whose first strategy is raw[k], and its issue or null."""
    ways = strategies(spec)
    found, many = [], False
    for i, s in enumerate(ways):
        values = F.get("_r.raw", F.lit(k + i))
        many = bool(s.get("all")) and s.get("type") not in ("number", "integer")
        if "fields" in s:
            names = ", ".join(f"`{n}`: string" for n in s["fields"])
            each = F.transform(values, _each(F.from_json, [f"struct<{names}>"]))
            each = F.transform(each, _each(_nested, [s["fields"]]))
            found.append(F.when(F.size(each) > 0, each) if s.get("all") else F.get(each, F.lit(0)))
            many = None
            continue
        if s.get("all"):
            c = F.filter(F.transform(values, _each(_regex, [s["regex"]])) if "regex" in s else values, lambda v: v.isNotNull())
        else:
            c = F.get(values, F.lit(0))
            c = _regex(c, s["regex"]) if "regex" in s else c
        chain = s.get("transform", [])
        chain = chain if isinstance(chain, list) else [chain]
        if chain:
            c = apply_transforms(c, chain, array=bool(s.get("all")))
            if not s.get("all"):  # a missing value stays missing whatever a transform makes of null
                c = F.when(F.get(values, F.lit(0)).isNotNull(), c)
        found.append(_nonempty(c, bool(s.get("all")) and not any(str(x).startswith(("join", "first", "last", "nth", "count")) for x in chain)))
    value = F.coalesce(*found)
    missing = value.isNull()
    s = ways[0]
    typed = value
    if many is not None and s.get("type"):
        typed = F.transform(value, lambda v: _typed(v, s["type"], url)) if s.get("all") and not s.get("transform") else _typed(value, s["type"], url)
    issue = F.when(missing & F.lit(bool(s.get("required"))) & shown, "is required").when(~missing & typed.isNull(), f"not a {s.get('type')}")
    if "default" in s:
        typed = F.coalesce(typed, F.lit(s["default"]).cast("double") if s.get("type") == "number" else F.lit(s["default"]))
    return typed, issue


def _nested(r: Column, fields: dict) -> Column:
    return F.struct(*[_plain(r[n], f).alias(n) for n, f in fields.items()])


def _plain(c: Column, spec) -> Column:
    s = strategies(spec)[0]
    c = _regex(c, s["regex"]) if "regex" in s else c
    chain = s.get("transform", [])
    c = F.when(c.isNotNull(), apply_transforms(c, chain if isinstance(chain, list) else [chain])) if chain else c
    return _typed(c, s.get("type"), F.lit(None).cast("string"))


def extract(pages: DataFrame, spec: dict, html: str = "html", url: str = "url", keep: tuple = ("url",)) -> DataFrame:
    """The records of pages: the columns to keep, _pos (place on the page), one column per field and _extract_issues."""
    ship(pages.sparkSession)
    raw = pages.select(*keep, F.col(url).alias("_u"), F.posexplode(reader(spec)(F.col(html), F.col(url))).alias("_pos", "_r"))
    columns, notes, k = [], [], 0
    for i, (name, f) in enumerate(spec.get("fields", {}).items()):
        value, issue = _field(f, k, F.get("_r.shown", F.lit(i)), F.col("_u"))
        columns.append(value.alias(name))
        notes.append(F.when(issue.isNotNull(), F.concat(F.lit(f"{name}: "), issue)))
        k += len(strategies(f))
    return raw.select(*keep, "_pos", *columns, F.array_compact(F.array(*notes)).alias("_extract_issues"))


READERS = {
    "title": "string", "text": "string", "canonical": "string", "next_page": "string", "json_ld": "array<string>", "microdata": "array<string>", "meta": "map<string,string>", "open_graph": "map<string,string>",
    "links": "array<struct<url:string,text:string,rel:string,title:string>>",
    "tables": "array<struct<caption:string,headers:array<string>,rows:array<array<string>>,records:array<map<string,string>>>>",
}


def page_reader(kinds: tuple[str, ...], closed: bool = False):
    """A UDF over (html, url): the page is parsed once and read in every way asked for."""

    def one(h, u):
        from pagelake.html.page import Page

        p, found = Page(h, u, closed), []
        for kind in kinds:
            if kind in ("json_ld", "microdata"):
                found.append([json.dumps(b, ensure_ascii=False) for b in getattr(p, kind)])
            else:
                found.append(p.meta if kind == "meta" else getattr(p, kind)())
        return found

    @F.pandas_udf(", ".join(f"{k} {READERS[k]}" for k in kinds))
    def read_page(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def make(html, url):
            rows = [one(h, u) for h, u in zip(html, url)]
            return pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype=object) for i, k in enumerate(kinds)})

        return sliced(batches, make)

    return read_page


def read_pages(pages: DataFrame, *kinds: str, html: str = "html", url: str = "url", closed: bool = False) -> DataFrame:
    """pages with a column per reader, all from one parse of each page. closed: see parse_html."""
    ship(pages.sparkSession)
    read = pages.withColumn("_read", page_reader(kinds, closed)(F.col(html), F.col(url)))
    return read.withColumns({k: F.col("_read")[k] for k in kinds}).drop("_read")


def metadata(records: DataFrame, run_at: str, depth=None, label=None) -> DataFrame:
    """_url, _scraped_at (a literal of the run), _depth and _label."""
    return records.withColumns({"_url": F.col("url"), "_scraped_at": F.lit(run_at), "_depth": F.lit(depth).cast("int"), "_label": F.lit(label).cast("string")})


def extract_by_label(pages: DataFrame, specs: dict[str, dict], label: str = "label", **kw) -> DataFrame:
    """Each label by its own spec; columns that a spec lacks are null."""
    out = None
    for name, spec in specs.items():
        part = extract(pages.where(F.col(label) == name), spec, **kw).withColumn("_label", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
