"""Orders and windows over a frontier or a request log: host turns, outcome windows, streaks, top rows of each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def placed(rows: DataFrame, host: str, *order, name: str = "place") -> DataFrame:
    """rows with their place within the host's queue."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(host).orderBy(*order)))


def round_robin(rows: DataFrame, host: str, *order) -> DataFrame:
    """All rows, one of each host in turn, each host's in its own order. The sort is a range sort: no task holds it all."""
    return placed(rows, host, *order, name="turn").orderBy("turn", host)


def rolling_rate(rows: DataFrame, host: str, order: str, bad: Column, last: int = 20) -> DataFrame:
    """rows with the share of `bad` ones among the host's last so many."""
    w = Window.partitionBy(host).orderBy(order).rowsBetween(1 - last, 0)
    return rows.withColumn("rate", F.avg(bad.cast("double")).over(w))


def longest_streak(rows: DataFrame, host: str, order: str, bad: Column) -> DataFrame:
    """(host, longest): the longest run of consecutive bad rows of each host that has any."""
    log = rows.select(host, order, bad.alias("_bad"))
    run = F.row_number().over(Window.partitionBy(host).orderBy(order)) - F.row_number().over(Window.partitionBy(host, "_bad").orderBy(order))
    return log.withColumn("_run", run).where("_bad").groupBy(host, "_run").agg(F.count("*").alias("n")).groupBy(host).agg(F.max("n").alias("longest"))


def top_of_each(rows: DataFrame, host: str, n: int, *order) -> DataFrame:
    """The first n rows of each host; a window limit keeps only those in the shuffle."""
    return placed(rows, host, *order, name="_n").where(F.col("_n") <= n).drop("_n")
