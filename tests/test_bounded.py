"""Steps whose memory or cost must not grow faster than their input."""

import random
import tracemalloc
from html.parser import HTMLParser

import pandas as pd

from pagelake.html import tree
from pagelake.html.tree import parse_html
from pagelake.operators import extract
from pagelake.plans import web
from pagelake.streaming import streams


def test_replay_of_a_host_holds_a_slice_of_it():
    random.seed(3)
    n = 200_000
    at = [float(random.randrange(n // 4)) for _ in range(n)]  # many requests at one time
    rows = list(zip(at, range(n), [(200, 404, 429)[i % 3] for i in range(n)]))
    random.shuffle(rows)
    parts = [pd.DataFrame(rows[k : k + 5000], columns=["at", "event_id", "status"]) for k in range(0, n, 5000)]
    want, k = sorted(rows), 0
    tracemalloc.start()
    for part in streams._in_order(iter(parts), 20_000):
        assert part == want[k : k + len(part)]
        k += len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert k == n and peak < 10e6, peak
    assert [p for p in streams._in_order(iter(parts))][0][:50] == want[:50]
    odd = pd.DataFrame({"at": [2.0, 1.0, 1.0], "event_id": [3.0, None, 2.0], "status": [200, None, 429]})
    assert [r[:2] for p in streams._in_order(iter([odd])) for r in p] == [(1.0, None), (1.0, 2), (2.0, 3)]
    assert list(streams._in_order(iter([]))) == []


def test_pages_of_a_batch_are_read_a_few_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(extract, "SLICE", 1 << 17)
    html, url = pd.Series(["<p>some words</p>" * 200] * 400 + [None]), pd.Series([f"https://a.test/{i}" for i in range(401)])
    read, left, n = extract.reader({"container": "p", "fields": {"text": {"selector": "."}}}).func, 401, 0
    tracemalloc.start()
    for part in read(iter([(html, url)])):
        n, left = n + sum(map(len, part)), left - len(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (left, n) == (0, 80_000) and peak < 20e6, peak
    assert [len(x) for x in read(iter([(html[:0], url[:0])]))] == [0]


def test_exploded_readers_parse_a_page_once(spark, tmp_path):
    part = spark.createDataFrame([(1, "n", "b", "t", 3, 2.5)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1, "https://a.test/", "<a href='/x'>x</a>"), (2, "https://a.test/", "no link")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for query, want in ((web.html_tables, [(1, "b", "3")]), (web.page_links, [(1, "https://a.test/x")])):
        df = query(spark, str(tmp_path))
        assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
        assert [tuple(r) for r in df.collect()] == want


def test_plain_tags_are_read_as_by_the_tokenizer(monkeypatch):
    texts = ["<A HREF='/x' Data-k=v b>y</A >", "<a b = 'c'>d</a>", "<a b=''>e", '<a b="x>y">f</a>', "<title>a<b>c</title>d", "<script>a<p></b></script >q", "<a\x0bb=1>k", "<a b\xa0=1>", "<p a=1 a=2/>t", "<a b='1'c>", "<a b=c&amp;d e='&lt;'>g", "<p a='", "</ p></p x>", "<br><hr/><x:y z:w=1>"]
    fast = [parse_html(x).html() for x in texts]
    monkeypatch.setattr(tree._Builder, "parse_starttag", HTMLParser.parse_starttag)
    monkeypatch.setattr(tree._Builder, "parse_endtag", HTMLParser.parse_endtag)
    assert fast == [parse_html(x).html() for x in texts]
