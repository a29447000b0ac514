"""Runs as a whole: quarantine, report, robots, pagination, resume, observers; streams replayed; stores, sinks, command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from pagelake import recipe as R
from pagelake.__main__ import main
from pagelake.operators import records, report
from pagelake.operators.links import Crawl, Follow, crawl
from pagelake.operators.pagination import Counting, from_template, with_param
from pagelake.sources import sinks
from pagelake.streaming import streams


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(f"https://k.t/shelf?p={p}", "".join(f"<div class=item><b>{'abc'[k]}{p}</b><i>{10 * p + k}</i></div>" for k in range(3 if p < 4 else 0)) + "<a href='/secret/1'>s</a>", "text/html") for p in range(1, 7)]
    rows += [("https://k.t/secret/1", "<div class=item><b>hidden</b><i>1</i></div>", "text/html"), ("https://k.t/file", "<div class=item><b>pdf</b></div>", "application/pdf")]
    return spark.createDataFrame(rows, "url string, html string, content_type string")


SPEC = {
    "name": "shelves", "start_urls": ["https://k.t/shelf?p=1", "https://k.t/file"], "follow": ["a"], "pagination": {"param": "p"},
    "extract": {"container": "div.item", "fields": {"name": "b", "n": {"selector": "i", "transform": "number", "type": "number"}}}, "validate": {"schema": {"n": {"max": 30}}},
}


def test_run_writes_items_quarantine_and_report(spark, shop, tmp_path):
    seen, robots = [], spark.createDataFrame([("https://k.t", "User-agent: *\nDisallow: /secret/\n")], "origin string, body string")
    spec = SPEC | {"output": [str(tmp_path / "items.ndjson")], "report": str(tmp_path / "report.json")}
    r = R.run(spec, shop, hooks={"on_run_start": lambda r: seen.append("start"), "on_run_end": lambda r: seen.append("end") or 1 / 0}, robots=robots)
    with pytest.warns(UserWarning, match="on_run_end"):
        said = r.write()
    assert seen == ["start", "end"] and all(v is None for v in said.values())
    got = {x.name for x in spark.read.json(str(tmp_path / "items.ndjson")).collect()}
    assert got == {f"{c}{p}" for p in (1, 2, 3) for c in "abc" if 10 * p + "abc".index(c) <= 30}
    bad = spark.read.json(str(tmp_path / "quarantine.ndjson")).collect()
    assert {x.name for x in bad} == {"b3", "c3"} and all(x._issues[0].rule == "max" for x in bad)
    found = json.load(open(tmp_path / "report.json"))
    assert found["validation"] == {"checked": 9, "valid": 7, "invalid": 2, "quarantined": 2, "dropped": 0}
    assert {x["status"]: x["pages"] for x in found["statuses"]} == {200: 5, 403: 1, 404: 1}  # four shelves and the file; the fifth shelf is never asked for, the file has no second page


def test_run_without_robots_and_with_limits(spark, shop):
    r = R.run(SPEC | {"robots": False, "limits": {"max_items": 4}}, shop, robots=spark.createDataFrame([("https://k.t", "User-agent: *\nDisallow: /\n")], "origin string, body string"))
    assert r.reached.where("status = 403").isEmpty() and r.items.count() == 4
    assert "hidden" in {x.name for x in R.run(SPEC | {"robots": False}, shop).items.collect()}


def test_crawl_goes_on_from_its_state(spark, tmp_path):
    chain = spark.createDataFrame([(f"https://c.t/{i}", f"<a href='/{i + 1}'>x</a>") for i in range(8)], "url string, html string")
    seeds = spark.createDataFrame([("https://c.t/0",)], "url string")
    state = str(tmp_path / "state")
    first = crawl(seeds, chain, Crawl((Follow("a"),), max_depth=3, max_next=0), state=state)
    assert first.count() == 4
    nothing = chain.where("url rlike '[4-7]$'")  # rounds that are done aren't read again
    more = crawl(seeds, nothing, Crawl((Follow("a"),), max_depth=7, max_next=0), state=state)
    whole = crawl(seeds, chain, Crawl((Follow("a"),), max_depth=3, max_next=0), state=state)
    assert more.where("round < 4 and status = 200").count() == 4 and whole.count() == 4


def test_counting_pagination(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(from_template("https://x/?p={page}&o={offset}", F.lit(3), start=0, step=2, page_size=10)) == "https://x/?p=6&o=30"
    cases = {"https://x/": "https://x/?p=3", "https://x/?a=1#f": "https://x/?a=1&p=3#f", "https://x/?p=7&a=1": "https://x/?p=8&a=1", "https://x/?p=no": None}
    for url, want in cases.items():
        assert one(with_param(F.lit(url), "p", start=2)) == want, url
    assert one(Counting(param="p", max_pages=3).after(F.lit("https://x/?p=3"), F.lit(3))) is None


def test_key_store_and_versions(spark, tmp_path):
    store = records.SeenStore(str(tmp_path / "seen"))
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    assert store.load(spark).count() == 0
    store.add(keys("a", "b", "b"))
    store.add(keys("b", "c"))
    assert sorted(x.key for x in store.load(spark).collect()) == ["a", "b", "c"]
    keys("d").withColumn("version", F.lit(1)).write.mode("append").parquet(store.path)
    with pytest.raises(ValueError, match="version"):
        store.load(spark)


def log(spark, tmp_path, n=600):
    r = random.Random(4)
    rows, at = [], 0.0
    for i in range(n):
        at += r.expovariate(1.0)
        rows.append((f"h{r.randrange(3)}", i, at, r.choice([200, 200, 200, 429, 503, 404])))
    df = spark.createDataFrame(rows, "host string, event_id long, at double, status int")
    to = str(tmp_path / "log.parquet")
    df.repartition(3).write.parquet(to)
    return rows, streams.source(spark, to)


def test_pacing_equals_its_replay(spark, tmp_path):
    rows, stream = log(spark, tmp_path)
    found = {x.event_id: x.scheduled_at for x in streams.drain(streams.paced(stream, 0.5)).collect()}
    for host in ("h0", "h1", "h2"):
        tokens, last, share, good = 1.0, 0.0, 1.0, 0
        for _, i, at, status in sorted((x for x in rows if x[0] == host), key=lambda x: (x[2], x[1])):
            now = max(at, last)
            tokens = min(1.0, tokens + (now - last) * 0.5 * share)
            if tokens < 1:
                now, tokens = now + (1 - tokens) / (0.5 * share), 1.0
            tokens, last = tokens - 1, now
            if status in (429, 503):
                share, good = max(0.05, share / 2), 0
            else:
                good += 1
                if good == 10:
                    share, good = min(1.0, share * 1.1), 0
            assert found[i] == pytest.approx(now)
    assert len(found) == len(rows)


def test_breaker_lets_nothing_through_while_open(spark, tmp_path):
    rows, stream = log(spark, tmp_path)
    found = {x.event_id: x for x in streams.drain(streams.breaker(stream, streak=3, cooldown=20.0)).collect()}
    assert len(found) == len(rows)
    states = set()
    for host in ("h0", "h1", "h2"):
        mode, fails, opened, trips, recent = "closed", 0, 0.0, 0, []
        for _, i, at, status in sorted((x for x in rows if x[0] == host), key=lambda x: (x[2], x[1])):
            if mode == "open" and at >= opened + min(900.0, 20.0 * 2 ** (trips - 1)):
                mode = "half-open"
            assert (found[i].state, found[i].allowed) == (mode, mode != "open")
            states.add(mode)
            if mode == "open":
                continue
            bad = status >= 400
            fails = fails + 1 if bad else 0
            recent = (recent + [bad])[-20:]
            if bad and (mode == "half-open" or fails >= 3 or len(recent) >= 10 and sum(recent) / len(recent) >= 0.5):
                mode, opened, trips, recent = "open", at, trips + 1, []
            elif not bad and mode == "half-open":
                mode, trips = "closed", 0
    assert states == {"closed", "open", "half-open"}


def test_late_rows_are_left_out_behind_the_watermark(spark, tmp_path):
    to = str(tmp_path / "late")
    for k, day in enumerate(("2024-01-10", "2024-01-01", "2024-01-11")):
        spark.createDataFrame([(f"k{k}", f"{day} 12:00:00")], "k string, ts string").select("k", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(to)
        stream = streams.source(spark, to)
        out = str(tmp_path / "out")
        streams.deduplicated(stream, ["k", "ts"], "ts", "1 day").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(out).awaitTermination()
    assert {x.k for x in spark.read.parquet(out).collect()} == {"k0", "k2"}


def test_sink_columns_and_bounds(spark, tmp_path):
    df = spark.createDataFrame([(1, None, "x"), (2, None, None), (3, "y", None)], "a int, b string, c string")
    assert sinks.by_frequency(df.select("b", "a", "c")).columns == ["a", "b", "c"]
    with pytest.warns(UserWarning, match="left out: b"):
        sinks.write_csv(df, str(tmp_path / "x.csv"), columns=["a", "c", "z"], bom=False)
    assert open(tmp_path / "x.csv").read().splitlines() == ["a,c,z", "1,x,", "2,,", "3,,"]
    with pytest.raises(ValueError, match="holds 2 rows"):
        sinks.write_xlsx(df, str(tmp_path / "x.xlsx"), most=2)
    assert sinks.quarantine_path([{"format": "null"}, "out/a.csv"]) == "out/quarantine.ndjson"
    df.write.json(str(tmp_path / "r.ndjson"))
    sinks.convert(str(tmp_path / "r.ndjson"), str(tmp_path / "r.json"), spark)
    assert len(json.load(open(tmp_path / "r.json"))) == 3


def test_report_lines_escape_their_labels(spark):
    m = spark.createDataFrame([("n", {"a": 'x"y\\z\nw'}, 1)], "name string, labels map<string,string>, value long")
    assert report.prometheus(m).first().line == 'n{a="x\\"y\\\\z\\nw"} 1'
    watched = report.live(spark.range(5), "five", most=F.max("id"))
    assert watched.count() == 5


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "p.html").write_text("<div class=c><b>one</b><a href=/x>l</a></div><div class=c><b>two</b></div>")
    assert main(["quick", str(tmp_path / "p.html"), "div.c", "name=b", "link=a@href"]) == 0
    assert [json.loads(x).get("name") for x in capsys.readouterr().out.splitlines()] == ["one", "two"]
    (tmp_path / "r.txt").write_text("User-agent: *\nDisallow: /no\n")
    assert main(["robots", str(tmp_path / "r.txt"), "/yes", "/no/x"]) == 1
    assert json.loads(capsys.readouterr().out) == {"/yes": True, "/no/x": False}
    for name in ("basic", "crawl", "structured", "api"):
        assert main(["init", name]) == 0
        spec = json.loads(capsys.readouterr().out)
        (tmp_path / f"{name}.json").write_text(json.dumps(spec))
        assert main(["validate", str(tmp_path / f"{name}.json")]) == 0
        capsys.readouterr()
    spark.createDataFrame([("https://example.com/list", "<div class=card><h2>a</h2><span class=price>$3</span></div>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    assert main(["profile", str(tmp_path / "basic.json"), str(tmp_path / "pages")]) == 0
    assert json.loads(capsys.readouterr().out)["validation"]["valid"] == 1
    assert main(["validate", str(tmp_path / "nowhere.json")]) == 1
