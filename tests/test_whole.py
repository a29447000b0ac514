"""Queries that once returned a part of their table, against brute force over more rows than that part."""

from collections import defaultdict
from hashlib import md5

import pytest

from pagelake.plans import native, web
from pagelake.sources import sitemap


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    pages = []
    for i in range(120):
        links = "".join(f"<a href='/p/{k}'>in {k}</a>" for k in range(i % 4)) + "<a href='https://other.test/'>out</a>" * (i % 2)
        cards = "".join(f"<div class=card><h2>Card {k} of {i}</h2><p>Some words on it</p></div>" for k in range(i % 5))
        pages.append((i, f"https://s.test/p/{i}", f"<title>{i}</title><main>{cards}</main><p>{links}</p>"))
    pages += [(120, "https://s.test/p/7?utm_source=x", "<p>another page of one canonical address</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    events = [(i, 1_700_000_000 + i, i * 7919 % 31, float(i), "view") for i in range(400)]
    e = spark.createDataFrame(events, "event_id long, t long, user_id long, value double, event_type string")
    e.selectExpr("event_id", "timestamp_seconds(t) AS ts", "user_id", "event_type", "value").write.parquet(f"{d}/events.parquet")
    return d, pages, events


def test_analyze_page_is_of_every_page(spark, sf):
    d, pages, _ = sf
    found = {r.page_id: r for r in web.analyze_page(spark, d).collect()}
    assert set(found) == {i for i, _, _ in pages}
    for i in range(120):
        r = found[i]
        assert (r.n_links, r.internal) == (i % 4 + i % 2, i % 4), i
        assert [b["count"] for b in r.blocks if b["selector"] == "div.card"] == ([i % 5] if i % 5 >= 3 else []), i


def test_seed_list_has_every_seed(spark, sf):
    d, pages, _ = sf
    found = sorted((r.url, r.sha) for r in native.seed_list(spark, d).collect())
    assert found == sorted((u, md5(h.encode()).hexdigest()) for _, u, h in pages)


def test_host_round_robin_orders_every_event(spark, sf):
    d, _, events = sf
    queues = defaultdict(list)
    for i, _, user, _, _ in events:
        queues[f"h{user % 7}"].append(([200, 404, 429, 503, 200][i % 5], i))
    want = [(turn + 1, host, q[turn][1]) for host, q in ((h, sorted(q)) for h, q in queues.items()) for turn in range(len(q))]
    assert [(r.turn, r.host, r.event_id) for r in native.host_round_robin(spark, d).collect()] == sorted(want)


def test_sitemap_has_no_cap_unless_asked(spark):
    n = 50_500
    body = "".join(f"<url><loc>http://s/{i}</loc></url>" for i in range(n))
    contents = spark.createDataFrame([("http://s/map", body)], "sitemap string, content string")
    start = contents.select("sitemap")
    assert sitemap.read(start, contents, depth=0).count() == n
    assert [r.loc for r in sitemap.read(start, contents, depth=0, most=2).collect()] == ["http://s/0", "http://s/1"]
