"""robots.txt as tables: parsed with window functions, applied by an equi-join on origin with a regex residual."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse(bodies: DataFrame) -> DataFrame:
    """(origin, line, field, value, gid) of bodies (origin, body); gid counts groups: a run of user-agent lines opens one."""
    lines = bodies.select("origin", F.posexplode(F.split("body", "\r?\n|\r")).alias("line", "raw"))
    lines = lines.select("origin", "line", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("raw")).where(F.contains("raw", F.lit(":")))
    field = F.lower(F.trim(F.substring_index("raw", ":", 1)))
    rows = lines.select("origin", "line", field.alias("field"), F.trim(F.regexp_replace("raw", "^[^:]*:", "")).alias("value")).where("field <> 'sitemap'")
    w = Window.partitionBy("origin").orderBy("line")
    opens = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    return rows.withColumn("opens", opens.cast("int")).withColumn("gid", F.sum("opens").over(w)).drop("opens")


def sitemaps(bodies: DataFrame) -> DataFrame:
    """(origin, sitemap) of the Sitemap lines."""
    found = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap\s*:\s*(\S+)"), 1)
    return bodies.select("origin", F.explode(found).alias("sitemap"))


def rules(parsed: DataFrame) -> DataFrame:
    """(origin, gid, allow, len, re): path patterns as anchored regexes; length without * and $ is their specificity."""
    r = parsed.where(F.col("field").isin("allow", "disallow") & (F.col("value") != ""))
    path = F.when(F.col("value").rlike(r"^[/*]"), F.col("value")).otherwise(F.concat(F.lit("/"), F.col("value")))
    ends = F.endswith(path, F.lit("$"))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\$$", ""), r"([.+?^$(){}|\[\]\\])", r"\\$1"), r"\*+", ".*")
    return r.select("origin", "gid", (F.col("field") == "allow").alias("allow"), F.length(F.regexp_replace(path, "[*$]", "")).alias("len"), F.concat(F.lit("^"), body, F.when(ends, "$").otherwise("")).alias("re"))


def groups(parsed: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (origin, agent, ...) with the gid that rules them: the longest token within the agent, else *, the first of equals."""
    agents = parsed.where("field = 'user-agent'").select("origin", F.lower("value").alias("token"), F.col("gid").alias("g"))
    pairs = requests.select("origin", "agent").distinct().join(agents, "origin").where((F.col("token") == "*") | F.contains(F.lower("agent"), F.col("token")))
    order = F.struct((F.col("token") != "*").alias("named"), F.length("token").alias("n"), (-F.col("g")).alias("first"))
    best = pairs.groupBy("origin", "agent").agg(F.max_by("g", order).alias("gid"))
    return requests.join(best, ["origin", "agent"], "left")


def check(requests: DataFrame, bodies: DataFrame) -> DataFrame:
    """requests (url, origin, agent, target) with `allowed`: the most specific rule decides, allow wins ties, none allows."""
    parsed = parse(bodies)
    led = groups(parsed, requests)
    hits = led.join(rules(parsed), ["origin", "gid"]).where(F.rlike("target", F.col("re")))
    verdict = hits.groupBy("url", "agent").agg(F.max_by("allow", F.struct("len", "allow")).alias("v"))
    return led.join(verdict, ["url", "agent"], "left").withColumn("allowed", F.coalesce("v", F.lit(True))).drop("v")


def crawl_delay(parsed: DataFrame) -> DataFrame:
    """(origin, gid, delay): seconds, from crawl-delay or a request rate n/m."""
    v = F.col("value")
    rate = F.regexp_extract(v, r"^(\d+)/(\d+)", 2).try_cast("double") / F.regexp_extract(v, r"^(\d+)/(\d+)", 1).try_cast("double")
    delay = F.when(F.col("field") == "crawl-delay", v.try_cast("double")).when(F.col("field") == "request-rate", rate)
    return parsed.select("origin", "gid", delay.alias("delay")).where("delay is not null").groupBy("origin", "gid").agg(F.max("delay").alias("delay"))


def status_policy(status, on_error_allow: bool = False):
    """What a robots.txt response means: rules, allow-all or deny-all."""
    s = F.col(status) if isinstance(status, str) else status
    return F.when(s.between(200, 299), "rules").when(s.between(400, 499), "allow-all").otherwise("allow-all" if on_error_allow else "deny-all")
