"""A cache of responses as a table: keyed, aged and pruned by relational operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHEABLE = [200, 203, 300, 301, 404, 410]
LIMIT = 10 * 1024 * 1024


def key(method="method", url="url", body="body"):
    return F.sha1(F.concat_ws("\x00", F.upper(F.coalesce(F.col(method), F.lit("GET"))), F.col(url), F.coalesce(F.col(body), F.lit(""))))


def storable(responses: DataFrame) -> DataFrame:
    """Responses (status, cache_control, html) that may be kept."""
    allowed = ~F.coalesce(F.lower("cache_control"), F.lit("")).rlike("no-store|private")
    return responses.where(F.col("status").isin(CACHEABLE) & allowed & (F.octet_length("html") <= LIMIT))


def fresh(cache: DataFrame, now: str, ttl_hours: float = 24, rendered: bool = False) -> DataFrame:
    """Entries young enough at `now`, made the way this run makes pages."""
    age = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis(F.col("cached_at").cast("timestamp"))
    return cache.where((age <= ttl_hours * 3_600_000) & (F.col("rendered") == rendered))


def lookup(requests: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached response, misses) of keyed requests."""
    return requests.join(cache, "key"), requests.join(cache.select("key"), "key", "left_anti")
