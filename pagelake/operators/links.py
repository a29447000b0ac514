"""Link discovery and a bounded crawl over a table of pages.

A crawl is a loop over DataFrames: each round takes the frontier's batch (by host turn and priority), joins it to the
pages on the canonical URL, discovers links, drops those seen and goes on until the frontier is empty or a bound is met.
Every round is checkpointed to the shared folder, so lineage doesn't grow. With a `state` folder, rounds are kept there
and a run that was stopped goes on after its last whole round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelake.functions import urls
from pagelake.operators.extract import sliced
from pagelake.operators.pagination import Counting
from pagelake.session import exists, ship
from pagelake.sources import robots as robots_txt

FOUND = "array<struct<url:string,text:string,rule:int>>"


@dataclass(frozen=True)
class Follow:
    """A rule: links of a selector (or all), by pattern, with a label and priority for what they lead to."""

    selector: str = "a[href]"
    attr: str = "href"
    pattern: str | None = None
    label: str | None = None
    priority: int = 0
    on: str | None = None
    max_links: int | None = None


@dataclass(frozen=True)
class Crawl:
    follow: tuple[Follow, ...] = ()
    paginate: str | Counting | None = None  # a selector, "auto", or a counter
    max_depth: int = 3
    max_pages: int = 1000
    max_next: int = 100
    allowed_domains: tuple[str, ...] = ()
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = field(default=())


def _found(crawl: Crawl):
    def one(html, url):
        from pagelake.html.page import Page
        from pagelake.html.tree import Node

        page, out = Page(html, url), []
        for k, rule in enumerate(crawl.follow):
            for n in page.select(rule.selector):
                href = n.text().strip() if rule.attr == "text" else n.attrs.get(rule.attr)
                if href is None and isinstance(n, Node):  # a container: its first link
                    href = next((a.attrs["href"] for a in page.select("a[href]", n)), None)
                if u := page.resolve(href):
                    out.append({"url": u, "text": " ".join(n.text().split()), "rule": k})
        if isinstance(crawl.paginate, Counting):
            if crawl.paginate.items is None or page.select(crawl.paginate.items):
                out.append({"url": "", "text": "", "rule": -1})
        elif crawl.paginate and (u := page.next_page(None if crawl.paginate == "auto" else crawl.paginate)):
            out.append({"url": u, "text": "", "rule": -1})
        return out

    @F.pandas_udf(FOUND)
    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return sliced(batches, lambda html, url: pd.Series([one(h, u) for h, u in zip(html, url)], dtype=object))

    return found


def _by_rule(values: list, otherwise: Column) -> Column:
    out = otherwise
    for k, v in enumerate(values):
        if v is not None:
            out = F.when(F.col("rule") == k, F.lit(v)).otherwise(out)
    return out


def discover(pages: DataFrame, crawl: Crawl) -> DataFrame:
    """Links of pages (url, html, label, depth[, priority, page]): key, url, label, depth, priority, page, parent_url, reason.

    A next page keeps its depth and label and comes one priority earlier; a followed link is one deeper. reason says why
    a link isn't followed, ok if it is.
    """
    ship(pages.sparkSession)
    given = {"page": F.lit(1), "priority": F.lit(0)}
    pages = pages.withColumns({k: v for k, v in given.items() if k not in pages.columns})
    p = pages.select("url", "label", "depth", "priority", "page", F.posexplode(_found(crawl)("html", "url")).alias("pos", "l"))
    p = p.select("url", "label", "depth", "priority", "page", "pos", F.col("l.url").alias("to"), F.col("l.rule").alias("rule"))
    if isinstance(crawl.paginate, Counting):
        p = p.withColumn("to", F.when(F.col("rule") == -1, crawl.paginate.after("url", "page")).otherwise(F.col("to"))).where("to is not null")
    rules = crawl.follow
    on = F.lit(True)
    for k, r in enumerate(rules):
        fits = (F.col("label") == r.on if r.on else F.lit(True)) & (urls.matches_any("to", [r.pattern]) if r.pattern else F.lit(True))
        on = F.when(F.col("rule") == k, fits).otherwise(on)
    p = p.where(F.coalesce(on, F.lit(False)))
    if any(r.max_links for r in rules):
        w = Window.partitionBy("url", "rule").orderBy("pos")
        p = p.withColumn("n", F.row_number().over(w)).where(F.coalesce(F.col("n") <= _by_rule([r.max_links for r in rules], F.lit(None).cast("int")), F.lit(True)))
    nxt = F.col("rule") == -1
    deep = ~nxt & (F.col("depth") >= crawl.max_depth)
    return p.select(
        urls.canonical("to").alias("key"), F.col("to").alias("url"), F.when(nxt, F.col("label")).otherwise(_by_rule([r.label for r in rules], F.col("label"))).alias("label"),
        F.when(nxt, F.col("depth")).otherwise(F.col("depth") + 1).alias("depth"), F.when(nxt, F.col("priority") - 1).otherwise(_by_rule([r.priority for r in rules], F.lit(0))).alias("priority"),
        F.when(nxt, F.col("page") + 1).otherwise(1).alias("page"), F.col("url").alias("parent_url"), "pos", F.when(deep, "too deep").otherwise(urls.verdict("to", crawl.allowed_domains, crawl.allow, crawl.deny)).alias("reason"),
    )


def permitted(frontier: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """frontier with `allowed` by the robots bodies (origin, body)."""
    path = F.coalesce(F.nullif(F.regexp_extract("url", "^[^:]+://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    asked = frontier.select("url", urls.origin("url").alias("origin"), F.lit(agent).alias("agent"), path.alias("target")).distinct()
    return frontier.join(robots_txt.check(asked, robots).select("url", "allowed"), "url", "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


COLUMNS = ["key", "url", "label", "depth", "priority", "page", "parent_url"]


def crawl(seeds: DataFrame, pages: DataFrame, plan: Crawl, robots: DataFrame | None = None, agent: str = "pagelake", state: str | None = None) -> DataFrame:
    """The pages that a crawl from `seeds` (url[, label]) reaches: key, url, html, label, depth, parent_url, round, status.

    A URL that no page has is reported with status 404 and not followed, one that robots (origin, body) disallow with 403.
    state: a folder where each round is written, its frontier last; a later call goes on from the last whole round there.
    """
    spark = seeds.sparkSession
    label = F.col("label") if "label" in seeds.columns else F.lit(None).cast("string")
    frontier = seeds.select(urls.canonical("url").alias("key"), "url", label.alias("label"), F.lit(0).alias("depth"), F.lit(0).alias("priority"), F.lit(1).alias("page"), F.lit(None).cast("string").alias("parent_url"))
    frontier = _first(frontier.withColumn("pos", F.lit(0))).checkpoint()
    source = pages.select(urls.canonical("url").alias("key"), F.col("url").alias("at"), "html")
    source = source.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("at"))).where("n = 1").drop("n")
    seen, done, count = frontier.select("key"), None, 0
    for n in range(plan.max_depth + plan.max_next + 1):
        if state and exists(spark, f"{state}/frontier/{n}/_SUCCESS"):  # a round of an earlier call
            got, frontier = spark.read.parquet(f"{state}/done/{n}"), spark.read.parquet(f"{state}/frontier/{n}")
            count += got.count()
        else:
            batch = frontier
            if count + (size := batch.count()) > plan.max_pages:
                batch, size = in_turn(frontier).limit(plan.max_pages - count), plan.max_pages - count
            if not size:
                break
            count += size
            if robots is not None:
                batch = permitted(batch, robots, agent)
            else:
                batch = batch.withColumn("allowed", F.lit(True))
            status = F.when(~F.col("allowed"), 403).when(F.col("html").isNull(), 404).otherwise(200)
            got = batch.join(source.drop("at"), "key", "left").withColumn("round", F.lit(n)).withColumn("status", status).drop("allowed")
            got = _kept(got, state, "done", n)
            links = discover(got.where("status = 200"), plan).where("reason = 'ok'")
            frontier = _kept(_first(links).join(seen, "key", "left_anti").select(*COLUMNS), state, "frontier", n)
        done = got if done is None else done.unionByName(got)
        seen = seen.unionByName(frontier.select("key"))
    return done if done is not None else frontier.withColumns({"html": F.lit(None).cast("string"), "round": F.lit(0), "status": F.lit(0)})


def _kept(df: DataFrame, state: str | None, name: str, n: int) -> DataFrame:
    """df cut off from its lineage: in the state folder, or as a checkpoint."""
    if not state:
        return df.checkpoint()
    df.write.mode("overwrite").parquet(f"{state}/{name}/{n}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{state}/{name}/{n}")


def _first(links: DataFrame) -> DataFrame:
    w = Window.partitionBy("key").orderBy("priority", "parent_url", "pos", "url")
    return links.where("key is not null").withColumn("n", F.row_number().over(w)).where("n = 1").select(*COLUMNS)


def in_turn(frontier: DataFrame) -> DataFrame:
    """One of each host in turn, the best priority first."""
    w = Window.partitionBy(urls.host("url")).orderBy("priority", "key")
    return frontier.withColumn("_turn", F.row_number().over(w)).orderBy("_turn", "key").drop("_turn")
