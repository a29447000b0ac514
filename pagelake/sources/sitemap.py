"""Sitemaps: parsed natively; an index is followed level by level, never a page twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _tag(block, name: str):
    v = F.trim(F.regexp_replace(F.regexp_extract(block, rf"(?is)<{name}[^>]*>(.*?)</{name}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        v = F.replace(v, F.lit(entity), F.lit(char))
    return F.nullif(v, F.lit(""))


def parse(contents: DataFrame) -> DataFrame:
    """(sitemap, kind, loc, lastmod, changefreq, priority) of (sitemap, content): kind is url, sitemap or text."""
    block = lambda tag: F.regexp_extract_all("content", F.lit(rf"(?is)(<{tag}\b[^>]*>.*?</{tag}>)"), 1)
    label = lambda a, kind: F.transform(a, lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("b")))
    lines = F.filter(F.transform(F.split("content", r"\r?\n"), F.trim), lambda x: x.rlike(r"^(?i)https?://\S+$"))
    marked = F.concat(label(block("sitemap"), "sitemap"), label(block("url"), "url"))
    marked = F.when(F.size(marked) > 0, marked).otherwise(label(lines, "text"))
    rows = contents.select("sitemap", F.explode(marked).alias("r")).select("sitemap", "r.kind", "r.b")
    loc = F.when(F.col("kind") == "text", F.col("b")).otherwise(_tag(F.col("b"), "loc"))
    return rows.select("sitemap", "kind", loc.alias("loc"), _tag(F.col("b"), "lastmod").alias("lastmod"), _tag(F.col("b"), "changefreq").alias("changefreq"), _tag(F.col("b"), "priority").try_cast("double").alias("priority")).where("loc is not null")


def read(start: DataFrame, contents: DataFrame, depth: int = 3, most: int | None = None) -> DataFrame:
    """The pages of the sitemaps `start` (sitemap) and, through indexes, of their children found in `contents`.

    All of them, or the first `most` by address.
    """
    level, seen, out = start.select("sitemap").distinct(), start.select("sitemap").distinct(), None
    for _ in range(depth + 1):
        rows = parse(contents.join(level, "sitemap", "left_semi"))
        pages = rows.where("kind <> 'sitemap'")
        out = pages if out is None else out.unionByName(pages)
        level = rows.where("kind = 'sitemap'").select(F.col("loc").alias("sitemap")).distinct().join(seen, "sitemap", "left_anti")
        seen = seen.unionByName(level)
    return out if most is None else out.orderBy("loc", "sitemap").limit(most)


CONVENTIONAL = ["/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemap.txt"]


def discover(origins: DataFrame, listed: DataFrame) -> DataFrame:
    """(origin, candidates): the sitemaps that robots.txt lists, else the usual places."""
    named = listed.groupBy("origin").agg(F.sort_array(F.collect_set("sitemap")).alias("named"))
    usual = F.array(*[F.concat("origin", F.lit(p)) for p in CONVENTIONAL])
    return origins.join(named, "origin", "left").select("origin", F.coalesce("named", usual).alias("candidates"))
