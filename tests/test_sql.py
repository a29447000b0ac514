"""Queries against their SQL, on rows where they once differed from it."""

from collections import Counter

import duckdb

from pagelake import queries as base
from pagelake.functions import transforms as t
from pagelake.html.page import Page
from pagelake.html.tree import parse_html


def differ(spark, d, name, **tables):
    """Rows that only the query has, and rows that only its SQL has, over these tables (DataFrames by name)."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{d}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got = base.QUERIES[name](spark, str(d))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({base.ORACLE[name]})").fetchall()
    a, b = Counter(tuple(r) for r in got.collect()), Counter(want)
    return sorted((a - b).elements(), key=str), sorted((b - a).elements(), key=str)


def test_field_health_judges_by_the_exact_rate(spark, tmp_path):
    # 1003 of 10,000 are filled: shown as 10.0, yet above the limit of broken; 4996 shown as 50.0, yet degraded
    part = spark.range(10_000).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name", "CASE WHEN id < 1003 THEN 50 WHEN id < 4996 THEN 40 ELSE 1 END AS p_size")
    assert differ(spark, tmp_path, "field_health", part=part) == ([], [])


def test_seed_list_keeps_pages_that_share_an_address(spark, tmp_path):
    rows = [(1, "https://a.test/x", "one"), (2, "https://a.test/x", "two"), (3, "https://a.test/x", "two"), (4, "https://a.test/x?utm_source=q", "three"), (5, None, "four"), (6, "https://a.test/y", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert differ(spark, tmp_path, "seed_list", pages=pages) == ([], [])


def test_capitalize_makes_one_letter_of_one(spark, tmp_path):
    texts = ["ßheit und", "ﬁnd", "ŉ x", "ᾳ b", "éa", "abc", "Abc", "1a", "", None, "e\u0301a", "ǆ", "𐐨x", "ß"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert differ(spark, tmp_path, "tx_capitalize", documents=docs) == ([], [])
    assert docs.select(t.capitalize("text")).head()[0] == "SSheit und"  # the transform of recipes is the reference's


def test_titles_and_headings_read_closed_references_only(spark, tmp_path):
    cut = ["a &amp; b &amp", "Tom &copy; &quot;x&quot; &middot; R&D", "cut &am", "end &", "a &copy b", "plain"]
    rows = [(i, f"https://a.test/{i}", f"<title>{c}</title><h1 class=x>{c}</h1><p>{c}</p><a href='/p?a=1&copy=2'>x</a><script>a &amp b</script>") for i, c in enumerate(cut)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert differ(spark, tmp_path, "page_title", pages=pages) == ([], [])
    assert differ(spark, tmp_path, "page_headings", pages=pages) == ([], [])
    page = Page(rows[0][2], closed=True)
    assert page.doc.html() == parse_html(rows[0][2].replace("&amp<", "&amp;amp<").replace("1&copy", "1&amp;copy")).html()
    assert Page(rows[0][2]).title() == "a & b &"  # HTML's own reading stays that of recipes
