"""Run-quality aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate(part, whole, digits: int = 1):
    return F.round(part.cast("double") * 100 / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def counters(events: DataFrame, name: str, value=None) -> DataFrame:
    return events.groupBy(name).agg((F.count("*") if value is None else F.sum(value)).alias("total"))


def gauges(events: DataFrame, name: str, value: str, at: str) -> DataFrame:
    return events.groupBy(name).agg(F.max_by(value, at).alias("last"))


def histogram(events: DataFrame, name: str, value: str) -> DataFrame:
    """count, sum, mean, min, max and nearest-rank percentiles."""
    ranks = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})").alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)]
    return events.groupBy(name).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), *ranks)


def host_rollup(log: DataFrame) -> DataFrame:
    """Per host of a log (host, status, bytes, ms): requests, ok, failed, blocked, bytes, mean time, success rate."""
    ok = F.col("status").between(200, 299)
    return log.groupBy("host").agg(
        F.count("*").alias("requests"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_if(F.col("status").isin(403, 429)).alias("blocked"),
        F.sum("bytes").alias("bytes"), F.sum("ms").alias("total_ms"), rate(F.count_if(ok), F.count("*")).alias("success_rate"),
    )


def field_health(records: DataFrame, fields: list[str], label: str | None = None) -> DataFrame:
    """Per field: attempts, filled, fill_rate and status, the worst first."""
    filled = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f).isNotNull() & (F.col(f).cast("string") != "")).alias("on")) for f in fields])
    keys = [label] if label else []
    long = records.select(*keys, F.explode(filled).alias("f")).select(*keys, "f.field", "f.on")
    out = long.groupBy(*keys, "field").agg(F.count("*").alias("attempts"), F.count_if("on").alias("filled"))
    exact = F.col("filled").cast("double") * 100 / F.nullif(F.col("attempts"), F.lit(0))  # the shown rate is rounded, the limits aren't
    status = F.when(F.col("attempts") < 5, "unknown").when(exact <= 10, "broken").when(exact < 50, "degraded").otherwise("ok")
    return out.withColumn("fill_rate", rate(F.col("filled"), F.col("attempts"))).withColumn("status", status).orderBy("fill_rate", "field")


def failure_groups(log: DataFrame, reason: str, example: str, most: int = 3) -> DataFrame:
    """Per reason: count and the first few examples; a window limit keeps only those rows."""
    w = Window.partitionBy(reason).orderBy(example)
    few = log.select(reason, example).distinct().withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    few = few.groupBy(reason).agg(F.array_sort(F.collect_list(example)).alias("examples"))
    return log.groupBy(reason).agg(F.count("*").alias("total")).join(few, reason, "left").orderBy(F.desc("total"), reason)


def time_shares(log: DataFrame, bucket: str, ms: str) -> DataFrame:
    """Share of each bucket in the whole time."""
    return log.groupBy(bucket).agg(F.sum(ms).alias("ms")).withColumn("share", F.col("ms") / F.sum("ms").over(Window.partitionBy()))


def key_frequency(maps: DataFrame, column: str, seq: str) -> DataFrame:
    """Keys of a map column by frequency, then first seen: the column order of a table sink."""
    keys = maps.select(seq, F.explode(F.map_keys(column)).alias("key"))
    return keys.groupBy("key").agg(F.count("*").alias("n"), F.min(seq).alias("first_seen")).orderBy(F.desc("n"), "first_seen", "key")


def achieved_rps(log: DataFrame, host: str, ts: str) -> DataFrame:
    span = F.max(F.unix_seconds(F.col(ts).cast("timestamp"))) - F.min(F.unix_seconds(F.col(ts).cast("timestamp")))
    return log.groupBy(host).agg(((F.count("*") - 1).cast("double") / F.nullif(span, F.lit(0).cast("long"))).alias("rps"))


def pacing(rps: float, jitter: float = 0.0, cap_ms: float = float("inf"), min_delay_ms: float = 0.0) -> float:
    """Requests a second to expect: the nominal gap plus half the jitter."""
    nominal = max(1000 / rps, min_delay_ms)
    return 1000 / (nominal + min(nominal * jitter, cap_ms) / 2)


def skip_reasons(links: DataFrame) -> DataFrame:
    """(reason, n): why links weren't followed."""
    return links.where("reason <> 'ok'").groupBy("reason").agg(F.count("*").alias("n"))


def efficiency(log: DataFrame) -> DataFrame:
    """Ratios of a log with a row per request (status, items, written, cached, rendered), in one row."""
    ok = F.count_if(F.col("status").between(200, 299))
    share = lambda c: F.round(F.count_if(c).cast("double") * 100 / F.nullif(F.count("*"), F.lit(0)), 1)
    ratio = lambda a, b: F.round(a.cast("double") / F.nullif(b, F.lit(0)), 2)
    return log.agg(
        ratio(F.count("*"), F.sum("written")).alias("requests_per_record"), ratio(F.sum("items"), ok).alias("records_per_page"),
        share(F.col("cached")).alias("cache_hit_rate"), share(F.col("rendered")).alias("render_rate"),
    )


def live(df: DataFrame, name: str, **totals) -> DataFrame:
    """df whose progress can be watched while it runs: `observe` counts its rows, and each total given, under a name."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in totals.items()])


def sketch(events: DataFrame, name: str, value: str, accuracy: int = 10_000) -> DataFrame:
    """As histogram(), with percentiles of bounded memory: their ranks are off by at most n / accuracy."""
    at = F.percentile_approx(value, [0.5, 0.9, 0.99], accuracy)
    found = events.groupBy(name).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), at.alias("p"))
    return found.select(name, "n", "least", "most", *[F.col("p")[i].alias(k) for i, k in enumerate(("p50", "p90", "p99"))])


def prometheus(metrics: DataFrame) -> DataFrame:
    """Exposition lines of (name, labels map, value)."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.when(labels == "", "").otherwise(F.concat(F.lit("{"), labels, F.lit("}"))), F.lit(" "), F.col("value").cast("string")).alias("line"))
