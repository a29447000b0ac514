"""Connected components of an edge list by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _stars(e: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a > b). Nothing collects a neighbourhood: it is a min per node and a join."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if large:
        new = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = joined.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return new.where("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node in an edge; root is the smallest node that can be reached.

    Each round is written to the checkpoint folder, so a lost executor costs one round. The rounds end when a pair of
    rounds changes nothing, which is known from the number of edges and a sum of their hashes, not from collected edges.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct().checkpoint()
    seen = None
    while True:
        e = _stars(_stars(e, large=True), large=False).checkpoint()
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = now
