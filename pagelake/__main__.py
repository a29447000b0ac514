"""Command line: run, test, profile, quick, inspect, init, validate, robots, cache, convert, transforms.

Exit codes: 0 done, 1 failed, 2 no records.
"""

from __future__ import annotations

import argparse
import json
import sys


_CARD = {"container": "div.card", "fields": {"name": "h2", "price": {"selector": ".price", "transform": "number", "type": "number"}}}
TEMPLATES = {
    "basic": {"name": "basic", "start_urls": ["https://example.com/list"], "extract": _CARD, "output": ["items.ndjson"]},
    "crawl": {
        "name": "crawl", "start_urls": ["https://example.com/list"], "follow": [{"selector": ".card a", "label": "detail"}], "pagination": {"type": "auto"},
        "extract": {"detail": {"fields": {"title": {"selector": "h1", "required": True}}}}, "limits": {"max_depth": 2}, "output": ["items.ndjson"],
    },
    "structured": {"name": "structured", "start_urls": ["https://example.com/"], "extract": {"fields": {"sku": {"from": "jsonld", "entity": "Product", "path": "sku"}}}, "output": ["items.ndjson"]},
    "api": {"name": "api", "start_urls": ["https://example.com/api?page=1"], "pagination": {"param": "page"}, "extract": {"fields": {"names": {"from": "json", "path": "items[*].name", "all": True}}}, "output": ["items.ndjson"]},
}


def _quick(spark, a) -> int:
    from pagelake.operators.extract import extract

    fields = {}
    for f in a.fields:
        name, _, way = f.partition("=")
        selector, _, attr = way.partition("@")
        fields[name] = {"selector": selector or "."} | ({"attr": attr} if attr else {})
    with open(a.html, encoding="utf-8") as f:
        page = spark.createDataFrame([(a.url, f.read())], "url string, html string")
    rows = extract(page, {"container": a.container, "fields": fields}).drop("url", "_pos", "_extract_issues").toJSON().collect()  # of one page
    print("\n".join(rows))
    return 0 if rows else 2


def _robots(spark, a) -> int:
    from pagelake.sources import robots

    with open(a.file, encoding="utf-8") as f:
        bodies = spark.createDataFrame([("x", f.read())], "origin string, body string")
    asked = spark.createDataFrame([(p, "x", a.agent, p) for p in a.paths], "url string, origin string, agent string, target string")
    found = {r.url: r.allowed for r in robots.check(asked, bodies).collect()}
    print(json.dumps(found, indent=2))
    return 0 if all(found.values()) else 1


def _cache(spark, a) -> int:
    from pagelake.sources import cache

    r = spark.read.parquet(a.responses)
    kept = cache.storable(r)
    print(json.dumps({"responses": r.count(), "storable": kept.count(), "fresh": cache.fresh(kept, a.now).count()}))
    return 0


def _convert(spark, a) -> int:
    from pagelake.sources import sinks

    sinks.convert(a.source, a.path, spark)
    return 0


OTHERS = {"quick": _quick, "robots": _robots, "cache": _cache, "convert": _convert}


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("pagelake")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "test", "profile"):
        s = sub.add_parser(name)
        s.add_argument("recipe")
        s.add_argument("pages", help="Parquet table of url and html")
    s = sub.add_parser("quick", help="records of one page by a selector, without a recipe")
    s.add_argument("html")
    s.add_argument("container")
    s.add_argument("fields", nargs="+", help="name=selector[@attribute]")
    s.add_argument("--url", default="https://example.com/")
    s = sub.add_parser("init", help="a recipe to start from")
    s.add_argument("template", choices=sorted(TEMPLATES))
    s = sub.add_parser("robots", help="whether a robots.txt lets an agent fetch paths")
    s.add_argument("file")
    s.add_argument("paths", nargs="+")
    s.add_argument("--agent", default="pagelake")
    s = sub.add_parser("cache", help="counts of a table of responses: stored, storable, fresh")
    s.add_argument("responses")
    s.add_argument("now")
    s = sub.add_parser("convert", help="a file of records in another format")
    s.add_argument("source")
    s.add_argument("path")
    s = sub.add_parser("inspect")
    s.add_argument("html")
    s.add_argument("--url", default="https://example.com/")
    sub.add_parser("validate").add_argument("recipe")
    sub.add_parser("transforms")
    a = p.parse_args(argv)
    from pagelake import recipe as R

    if a.command == "transforms":
        import pagelake.functions.dates  # noqa: F401
        from pagelake.functions.transforms import list_transforms

        print("\n".join(list_transforms()))
        return 0
    if a.command == "inspect":
        from pagelake.operators.inspect import analyze_text, generate_recipe

        with open(a.html, encoding="utf-8") as f:
            text = f.read()
        print(json.dumps({"analysis": analyze_text(text, a.url), "recipe": generate_recipe(text, a.url)}, indent=2, ensure_ascii=False))
        return 0
    if a.command == "init":
        print(json.dumps(TEMPLATES[a.template], indent=2))
        return 0
    if a.command in ("quick", "robots", "cache", "convert"):
        from pagelake.session import local_session

        return OTHERS[a.command](local_session(), a)
    try:
        spec = R.load(a.recipe)
        R.compiled(spec)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 1
    if a.command == "validate":
        print("ok")
        return 0
    from pagelake.session import local_session

    spark = local_session()
    done = R.run(spec, spark.read.parquet(a.pages))
    if a.command == "profile":
        print(json.dumps(done.report(), indent=2, default=str))
    elif a.command == "test":
        done.health().show(truncate=False)
        done.items.show(5, truncate=60)
    else:
        print(json.dumps(done.write()))
    return 2 if done.items.isEmpty() else 0


if __name__ == "__main__":
    sys.exit(main())
