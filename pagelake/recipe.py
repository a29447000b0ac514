"""Recipes: load, normalise, check, and run as one plan.

Sections of a recipe that steer live fetching (rates, proxies, browsers) are accepted and reported as ignored: pages come
from a table here.
"""

from __future__ import annotations

import difflib
import hashlib
import json
import os
import re
import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.functions.transforms import REGISTRY, parse_spec
from pagelake.html.css import SelectorError, compile_selector
from pagelake.html.xpath import is_xpath, validate_xpath
from pagelake.operators import records, report
from pagelake.operators.extract import extract, metadata
from pagelake.operators.links import Crawl, Follow, crawl, discover
from pagelake.operators.pagination import Counting
from pagelake.session import exists
from pagelake.sources import sinks

KNOWN = {"name", "robots", "checkpoint", "start_urls", "extract", "follow", "pagination", "limits", "filters", "dedupe", "validate", "output", "metadata", "report", "presets"}
IGNORED = {"http", "rate_limit", "concurrency", "proxy", "render", "retry", "cache", "concurrency_per_host", "authorization", "logging", "captcha", "stealth", "cookies", "headers", "user_agent"}
FIELD_KEYS = {"selector", "xpath", "from", "const", "attr", "all", "regex", "transform", "type", "default", "required", "fallback", "fields", "when", "keep_empty", "path", "entity", "name"}
TYPES = {"string", "number", "float", "integer", "int", "boolean", "bool", "url", "email", "date", "object", "array", "any"}
ALIASES = {"urls": "start_urls", "start_url": "start_urls", "outputs": "output", "items": "extract", "paginate": "pagination", "validation": "validate"}
DEFAULTS = {"limits": {"max_depth": 3, "max_pages": 1000}, "dedupe": {"key": "record"}, "validate": {"on_invalid": "quarantine"}, "metadata": True}


def _pace(rps: float, burst: int, jitter: float, workers: int, per_host: int, **more) -> dict:
    return {"rate_limit": {"requests_per_second": rps, "burst": burst, "jitter_ratio": jitter} | more, "concurrency": workers, "concurrency_per_host": per_host}


#: Pacing is for what replays or plans a crawl (`streaming.paced`, `report.pacing`); nothing here fetches.
PRESETS = {
    "owned": _pace(50, 20, 0.05, 32, 16) | {"authorization": {"basis": "owner"}},
    "fast": _pace(8, 8, 0.1, 16, 8),
    "polite": _pace(1, 1, 0.25, 4, 2),
    "careful": _pace(0.33, 1, 0.5, 2, 1, min_delay_ms=3000) | {"retry": {"max_attempts": 5, "base_delay_ms": 5000}},
    "spa": _pace(0.5, 1, 0.125, 2, 1) | {"render": {"mode": "always"}},
    "develop": {"limits": {"max_pages": 5}, "cache": {"enabled": True}},
}


class RecipeError(ValueError):
    """All that is wrong with a recipe."""


def snake(key: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), key)


def merged(a: dict, b: dict) -> dict:
    """b over a, key by key."""
    return {k: merged(a[k], b[k]) if isinstance(a.get(k), dict) and isinstance(b.get(k), dict) else b.get(k, a.get(k)) for k in [*a, *(k for k in b if k not in a)]}


def interpolated(text: str, env=None) -> str:
    """${NAME} and ${NAME:-default}."""
    env = os.environ if env is None else env

    def one(m):
        if m[1] in env:
            return env[m[1]]
        if m[2] is None:
            raise RecipeError(f"{m[1]} is not set")
        return m[2][2:]

    return re.sub(r"\$\{(\w+)(:-[^}]*)?\}", one, text)


def load(path: str, env=None) -> dict:
    with open(path, encoding="utf-8") as f:
        text = interpolated(f.read(), env)
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text)


def normalised(raw: dict) -> dict:
    """Snake-case keys, aliases, presets and defaults; field names stay as they are."""
    r = {ALIASES.get(snake(k), snake(k)): v for k, v in raw.items()}
    out = DEFAULTS
    for name in r.pop("presets", []) if isinstance(r.get("presets"), list) else []:
        out = merged(out, PRESETS.get(name, {}))
    for k in ("limits", "dedupe", "validate", "filters", "pagination"):
        if isinstance(r.get(k), dict):
            r[k] = {snake(a): b for a, b in r[k].items()}
    out = merged(out, r)
    seeds = out.get("start_urls", [])
    out["start_urls"] = [{"url": s} if isinstance(s, str) else s for s in (seeds if isinstance(seeds, list) else [seeds])]
    return out


def _closest(word: str, known) -> str:
    near = difflib.get_close_matches(word, sorted(known), 1)
    return f', did you mean "{near[0]}"?' if near else ""


def problems(recipe: dict) -> list[str]:
    out = [f'unknown section "{k}"' + _closest(k, KNOWN) for k in recipe if k not in KNOWN | IGNORED]

    def selector(s, where):
        if s in (None, "", ".", "&", ":scope"):
            return
        if is_xpath(s):
            if why := validate_xpath(s):
                out.append(f"{where}: {why}")
            return
        try:
            compile_selector(s)
        except SelectorError as e:
            out.append(f"{where}: {e}")

    def fields(spec, where, depth=0):
        if depth > 5:
            out.append(f"{where}: nested more than 5 levels deep")
            return
        for name, f in spec.items():
            at = f"{where}.{name}"
            f = {"selector": f} if isinstance(f, str) else f
            out.extend(f'{at}: unknown key "{k}"' + _closest(k, FIELD_KEYS) for k in f if snake(k) not in FIELD_KEYS)
            selector(f.get("selector"), at)
            if f.get("xpath") and (why := validate_xpath(f["xpath"])):
                out.append(f"{at}: {why}")
            if f.get("type") and f["type"] not in TYPES:
                out.append(f'{at}: unknown type "{f["type"]}"' + _closest(f["type"], TYPES))
            chain = f.get("transform", [])
            for t in chain if isinstance(chain, list) else [chain]:
                if not callable(t) and parse_spec(t)[0] not in REGISTRY:
                    out.append(f'{at}: unknown transform "{parse_spec(t)[0]}"' + _closest(parse_spec(t)[0], REGISTRY))
            if "fields" in f:
                fields(f["fields"], at, depth + 1)

    for where, spec in _specs(recipe).items():
        selector(spec.get("container"), f"{where}.container")
        fields(spec.get("fields", {}), where)
    return out


def _specs(recipe: dict) -> dict[str, dict]:
    """extract is one spec, or one per label."""
    spec = recipe.get("extract", {})
    if "fields" in spec or "container" in spec:
        return {"extract": spec}
    return {k: v for k, v in spec.items() if isinstance(v, dict)}


def compiled(raw: dict) -> dict:
    r = normalised(raw)
    if found := problems(r):
        raise RecipeError("; ".join(found))
    return r


def fingerprint(recipe: dict) -> str:
    """What a checkpoint belongs to: another recipe must not go on with it."""
    return hashlib.sha256(json.dumps({k: recipe.get(k) for k in ("start_urls", "extract", "follow", "pagination", "filters")}, sort_keys=True, default=str).encode()).hexdigest()[:16]


def check_resume(spark, folder: str, recipe: dict) -> None:
    """Claims a checkpoint folder for a recipe, on any file system; refuses one of another recipe."""
    name = f"{folder.rstrip('/')}/recipe"
    if exists(spark, f"{name}/_SUCCESS"):
        if spark.read.text(name).first().value != fingerprint(recipe):
            raise RecipeError("the checkpoint is of another recipe")
        return
    spark.createDataFrame([(fingerprint(recipe),)], "value string").coalesce(1).write.mode("overwrite").text(name)


def plan_of(recipe: dict) -> Crawl:
    lim, flt, pag = recipe["limits"], recipe.get("filters", {}), recipe.get("pagination")
    rules = recipe.get("follow", [])
    follow = tuple(Follow(**{snake(k): v for k, v in (r if isinstance(r, dict) else {"selector": r}).items() if snake(k) in Follow.__dataclass_fields__}) for r in (rules if isinstance(rules, list) else [rules]))
    page, most = None if not pag else "auto", 100
    if isinstance(pag, dict):
        pag = {snake(k): v for k, v in pag.items()}
        most = pag.get("max_pages") or most
        if pag.get("url_template") or pag.get("template") or pag.get("param"):
            listed = next((s.get("container") for s in _specs(recipe).values() if s.get("container")), None)
            page = Counting(pag.get("url_template") or pag.get("template"), pag.get("param"), pag.get("start", 1), pag.get("step", 1), pag.get("page_size"), pag.get("max_pages"), listed if pag.get("stop_when_empty", True) else None)
        elif pag.get("type") != "auto":
            page = pag.get("selector") or pag.get("xpath") or "auto"
    tup = lambda k: tuple(flt.get(k, ()))
    return Crawl(follow, page, lim["max_depth"], lim["max_pages"], most, allowed_domains=tup("allowed_domains"), allow=tup("allow"), deny=tup("deny"))


class Run:
    """What a run yields: accepted and quarantined records, the pages reached, and the report."""

    def __init__(self, recipe: dict, pages: DataFrame, run_at: str, hooks: dict | None = None, robots: DataFrame | None = None):
        """hooks: DataFrame -> DataFrame at on_response, on_item, on_links; observers on_run_start, on_run_end, on_error,
        whose results are ignored. robots: (origin, body); used in a crawl unless the recipe says robots: false.
        """
        spark, self.hooks = pages.sparkSession, hooks or {}
        hooks = self.hooks
        self.recipe = r = compiled(recipe)
        self.pages, self.run_at = pages, run_at
        self.observe("on_run_start", r)
        steered = r.get("robots", True)
        steered = steered if isinstance(steered, dict) else {"enabled": bool(steered)}
        hook = lambda name, df: df.transform(hooks[name]) if name in hooks else df
        if r.get("follow") or r.get("pagination"):
            seeds = spark.createDataFrame([(s["url"], s.get("label")) for s in r["start_urls"]], "url string, label string")
            if r.get("checkpoint"):
                check_resume(spark, r["checkpoint"], r)
            obeyed = robots if steered.get("enabled", True) else None
            self.reached = crawl(seeds, pages, plan_of(r), obeyed, steered.get("user_agent", "pagelake"), r.get("checkpoint"))
        else:
            self.reached = pages.select("url", "html").withColumns({"label": F.lit(None).cast("string"), "depth": F.lit(0), "status": F.lit(200)})
        got = self.reached.where("status = 200")
        if "content_type" in pages.columns:  # what is neither markup nor JSON isn't parsed
            kinds = pages.select(urls.canonical("url").alias("_page"), "content_type").groupBy("_page").agg(F.first("content_type").alias("_kind"))
            got = got.join(kinds, urls.canonical("url") == F.col("_page"), "left").where(parsed_kind("_kind")).drop("_page", "_kind")
        got = hook("on_response", got)
        items = None
        for label, spec in _specs(r).items():
            mine = got if label == "extract" else got.where(F.col("label") == label)
            part = extract(mine, spec, keep=("url", "depth", "label"))
            items = part if items is None else items.unionByName(part, allowMissingColumns=True)
        names = [n for s in _specs(r).values() for n in s.get("fields", {})]
        self.fields = list(dict.fromkeys(names))
        filled = [F.col(n).isNotNull() for n in self.fields]
        any_on = filled[0]
        for f in filled[1:]:
            any_on = any_on | f
        items = hook("on_item", items.where(any_on))
        if r["metadata"]:
            items = metadata(items.drop("_label"), run_at).withColumns({"_depth": F.col("depth"), "_label": F.col("label")})
        key = r["dedupe"].get("key", "record")
        ignore = (*records.IGNORED, "url", "_pos", "depth", "label", "_label", "_extract_issues")
        if r["dedupe"].get("enabled", True):
            by = F.coalesce(urls.canonical("url"), F.col("url")) if key == "url" else records.fields_key(r["dedupe"]["fields"]) if key == "fields" else records.record_key(items, ignore)
            items = records.first_of_each(items, by, "url", "_pos")
        v = r["validate"]
        checked = records.validate(items, v.get("schema", {}), v.get("on_invalid", "quarantine"), v.get("strict", False), v.get("min_filled_fields", 0))
        self.items, self.quarantined = (d.drop("_pos", "depth", "label", "_extract_issues", "url") for d in records.split(checked))
        self.raw, self.checked = items, checked
        if (most := r["limits"].get("max_items")) is not None:
            self.items = self.items.limit(int(most))

    def observe(self, name: str, *args) -> None:
        """Calls an observer; what it raises is a warning."""
        if name in self.hooks:
            try:
                self.hooks[name](*args)
            except Exception as e:
                warnings.warn(f"{name}: {e}", stacklevel=2)

    def health(self) -> DataFrame:
        return report.field_health(self.raw, self.fields)

    def links(self, pages: DataFrame | None = None) -> DataFrame:
        found = discover(self.reached.where("status = 200"), plan_of(self.recipe))
        return self.hooks["on_links"](found) if "on_links" in self.hooks else found

    def report(self) -> dict:
        """Counts, field health, validation and skip reasons of the run; its size goes with the recipe."""
        rows = lambda df: [r.asDict() for r in df.collect()]
        return {
            "name": self.recipe.get("name"), "run_at": self.run_at, "statuses": rows(self.reached.groupBy("status").agg(F.count("*").alias("pages")).orderBy("status")),
            "validation": rows(records.validation_stats(self.checked))[0], "fields": rows(self.health()), "skipped": rows(report.skip_reasons(self.links()).orderBy("reason")),
        }

    def write(self) -> dict:
        """Writes the accepted records to every output, the quarantined ones beside the first, and the report."""
        out = self.recipe.get("output", [])
        out = out if isinstance(out, list) else [out]
        try:
            said = sinks.write_all(self.items, out)
            if self.recipe["validate"].get("on_invalid", "quarantine") == "quarantine" and not self.quarantined.isEmpty():
                to = self.recipe["validate"].get("quarantine_path") or sinks.quarantine_path(out)
                sinks.write_ndjson(self.quarantined, to)
                said[to] = None
            if self.recipe.get("report"):
                sinks.write_report(self.report(), self.recipe["report"])
                said[self.recipe["report"]] = None
        except Exception as e:
            self.observe("on_error", e)
            raise
        self.observe("on_run_end", self)
        return said


def parsed_kind(content_type):
    """Whether a body of this type is parsed: markup, JSON, or of no type."""
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    return c.isNull() | (c == "") | c.rlike("(?i)html|xml|json")


def run(recipe: dict, pages: DataFrame, run_at: str = "1970-01-01T00:00:00Z", hooks: dict | None = None, robots: DataFrame | None = None) -> Run:
    return Run(recipe, pages, run_at, hooks, robots)


def run_pages(recipe: dict, pages: DataFrame) -> DataFrame:
    """Canonical addresses of the seeds among the pages."""
    return pages.where(urls.canonical("url").isin([s["url"] for s in recipe["start_urls"]]))
