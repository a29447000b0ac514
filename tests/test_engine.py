"""Transforms, records, crawl, recipe, sinks and streams through Spark."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from pagelake import recipe as R
from pagelake.functions import dates, policy, urls
from pagelake.functions import transforms as t
from pagelake.operators import records, report
from pagelake.sources import sinks


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_numbers(spark):
    want = {"$1,234.56": 1234.56, "1.234,56 €": 1234.56, "1.234": 1234.0, "0.125": 125.0, "1,234,56": 1.234, "1,2345": 1.2345, "1.234.567": 1234567.0, "$-5": 5.0, "$-15": -15.0, "-1,234": -1.234, "(1,234)": -1234.0, "12-": -12.0, "10-20": 10.0, "1 2": 12.0, "1e5": 1.0, "": None, "abc": None}
    df = spark.createDataFrame([(k,) for k in want], "s string").select("s", t.number("s").alias("n"))
    assert {r.s: r.n for r in df.collect()} == want


def test_dates(spark):
    want = {"2024-02-31": "2024-03-02", "March 5th, 2023": "2023-03-05", "5 Mar 2023": "2023-03-05", "03/04/2023": "2023-03-04", "25/12/99": "1999-12-25", "1700000000": "2023-11-14", "yesterday": "2023-12-31", "3 days ago": "2023-12-29", "in 2 weeks": "2024-01-15", "2023-01-01T23:30:00-01:00": "2023-01-02", "nonsense": None}
    df = spark.createDataFrame([(k,) for k in want], "s string").select("s", dates.date("s", "day").alias("d"))
    assert {r.s: r.d for r in df.collect()} == want


@pytest.mark.parametrize("spec,given,want", [
    ("trim", "  a ", "a"), ("capitalize", "abc", "Abc"), ("title", "hello-world 'tis", "Hello-world 'Tis"), ("stripTags", "<p>a<br>b</p><script>x</script>", "a\nb"), ("decodeEntities", "&lt;&#65;&#x42;&nope;&AMP;", "<AB&nope;&"), ("padStart:5", "42", "00042"),
    (["truncate", 3, "~"], "abcdef", "abc~"), ("slug", "Crème Brûlée!", "creme-brulee"), ("email", "x a.b@c.de y", "a.b@c.de"), ("phone", "+1 (234) 567", "+1234567"), ("digits", "none", None), ("urlPath", "http://a.b/c?d", "/c"), ("domain", "http://A.b/c", "a.b"), (["queryParam", "q"], "http://a/?q=x%20y", "x y"), (["replace", "(b)", "[$1]"], "abc", "a[b]c"), ("currencyCode", "12 EUR", "EUR"),
])
def test_transforms(spark, spec, given, want):
    assert value(spark, t.apply_transforms(F.lit(given), [spec])) == want


def test_transform_registry(spark):
    t.register_transform("shout", lambda x: F.concat(F.upper(t.col(x)), F.lit("!")))
    assert value(spark, t.apply_transforms(F.array(F.lit("a"), F.lit("b")), ["shout", "join:-"], array=True)) == "A!-B!"
    with pytest.raises(ValueError, match="unknown transform"):
        t.apply_transforms(F.lit("a"), ["nope"])
    assert "price" in t.list_transforms()


def test_urls(spark):
    want = {"HTTP://Ex.com:80//a//b/?utm_source=x&b=2&a=1#f": "http://ex.com/a/b?a=1&b=2", "https://e.com": "https://e.com/", "https://e.com/a/": "https://e.com/a", "ftp://x": None}
    df = spark.createDataFrame([(k,) for k in want], "u string").select("u", urls.canonical("u").alias("c"), urls.canonical(urls.canonical("u")).alias("cc")).collect()
    assert {r.u: r.c for r in df} == want and all(r.c == r.cc for r in df)
    assert urls.resolve_text("../x", "https://a.b/c/d") == "https://a.b/x" and urls.resolve_text("javascript:1", "https://a.b") is None


def test_block_and_rendering(spark):
    b = value(spark, policy.detect_block(F.lit("<div class='g-recaptcha'>"), F.lit(403)))
    assert b.blocked and b.vendor == "recaptcha" and "status 403" in b.signals
    assert value(spark, policy.needs_rendering(F.lit("<div id='root'></div>"))).reason == "empty app root"
    assert report.pacing(1, 0.25) == pytest.approx(0.889, abs=1e-3) and report.pacing(10, 0, min_delay_ms=2000) == 0.5


def test_records(spark):
    df = spark.createDataFrame([(1, " A  b", 5.0), (2, "a B", 5.0), (3, "c", None)], "id int, name string, price double")
    kept = records.first_of_each(df, records.record_key(df, ("id",)), "id")
    assert sorted(r.id for r in kept.collect()) == [1, 3]
    v = records.validate(df, {"price": {"required": True, "max": 4}, "name": {"minLength": 2}}, strict=True).collect()
    assert {r.id: [i.rule for i in r._issues] for r in v} == {1: ["max", "strict"], 2: ["max", "strict"], 3: ["required", "minLength", "strict"]}
    with pytest.raises(Exception):
        records.validate(df, {"price": {"required": True}}, "error").collect()


def test_bloom_has_no_false_negatives(spark):
    b = records.Bloom(1000)
    keys = spark.range(500).select(F.concat(F.lit("item-"), "id").alias("k"))
    assert b.maybe(keys, "k", b.build(keys, "k")).count() == 500
    other = spark.range(1000).select(F.concat(F.lit("other-"), "id").alias("k"))
    assert b.maybe(other, "k", b.build(keys, "k")).count() < 60


@pytest.fixture(scope="module")
def site(spark):
    rows = []
    names = [("Oak Shelf", "$10.50"), ("Pine Desk", "$25.00"), ("Elm Stool", "$5.25"), ("Ash Table", "$99.99"), ("Fir Bench", "$1.00"), ("Yew Frame", "$42.00")]
    for p in (1, 2, 3):
        cards = "".join(f"<div class=card><h2><a href='/product/{i}?utm_source=l'>{names[i - 1][0]}</a></h2><span class=price>{names[i - 1][1]}</span></div>" for i in (2 * p - 1, 2 * p))
        rows.append((f"https://s.t/list?page={p}", cards + (f"<a class=next href='/list?page={p + 1}'>next</a>" if p < 3 else "<span class='next disabled'>next</span>")))
    rows += [(f"https://s.t/product/{i}", f"<h1>{n}</h1><p class=price>{c}</p>") for i, (n, c) in enumerate(names, 1)]
    return spark.createDataFrame(rows, "url string, html string")


def test_listing_and_details(spark, site, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    spec = {
        "start_urls": ["https://s.t/list?page=1"], "follow": [{"selector": ".card a", "label": "detail"}], "pagination": {"type": "auto"},
        "extract": {"detail": {"fields": {"name": "h1", "price": {"selector": ".price", "transform": "number", "type": "number"}}}}, "validate": {"schema": {"price": {"max": 50}}},
    }
    r = R.run(spec, site)
    assert r.reached.where("status = 200").count() == 9
    assert sorted(x.name for x in r.items.collect()) == ["Elm Stool", "Fir Bench", "Oak Shelf", "Pine Desk", "Yew Frame"]
    (bad,) = r.quarantined.collect()
    assert bad.name == "Ash Table" and bad._issues[0].rule == "max"
    assert {x.field: x.fill_rate for x in r.health().collect()} == {"name": 100.0, "price": 100.0}


def test_recipe_checks(spark, tmp_path):
    with pytest.raises(R.RecipeError, match="did you mean \"trim\""):
        R.compiled({"extract": {"fields": {"a": {"selector": "h1", "transform": ["trimm"]}}}})
    assert any("extract.a" in p for p in R.problems(R.normalised({"extract": {"fields": {"a": "h1["}}})))
    assert R.interpolated("${A} ${B:-c}", {"A": "x"}) == "x c"
    one = R.normalised({"startUrls": "http://a", "extract": {"fields": {"a": "b"}}})
    assert one["start_urls"] == [{"url": "http://a"}]
    R.check_resume(spark, str(tmp_path), one)
    R.check_resume(spark, str(tmp_path), one)
    with pytest.raises(R.RecipeError):
        R.check_resume(spark, str(tmp_path), R.normalised({"startUrls": "http://b"}))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "Widget", 10.5, ["a", "b"], ("x", 1)), (2, "Gadget, Inc.", 25.0, [], None), (3, 'Say "hi"', None, ["c"], ("y", 2))], "id int, name string, price double, tags array<string>, meta struct<author:string,year:int>")
    said = sinks.write_all(df, [str(tmp_path / f"x.{k}") for k in ("json", "csv", "xlsx", "sqlite", "ndjson")] + [{"format": "null"}, {"path": "/nowhere/x.json"}])
    assert [v is None for v in said.values()] == [True] * 6 + [False]
    assert len(json.load(open(tmp_path / "x.json"))) == 3
    lines = open(tmp_path / "x.csv", encoding="utf-8-sig", newline="").read().split("\r\n")
    assert lines[0] == "id,name,price,tags,meta.author,meta.year" and lines[1] == "1,Widget,10.5,a; b,x,1" and lines[2] == '2,"Gadget, Inc.",25.0,,,' and lines[3] == '3,"Say ""hi""",,c,y,2'
    assert "Gadget, Inc." in zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet1.xml").decode()
    sinks.write_sqlite(df, str(tmp_path / "u.db"), upsert_key="id")
    sinks.write_sqlite(df.withColumn("extra", F.lit(1)), str(tmp_path / "u.db"), upsert_key="id")
    assert sqlite3.connect(tmp_path / "u.db").execute("select count(*), sum(extra) from items").fetchone() == (3, 3)
    sinks.write_json(df.limit(0), str(tmp_path / "e.json"))
    assert json.load(open(tmp_path / "e.json")) == []
