"""Search and click telemetry from an event log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import urls
from quern.functions.text import log_form

RING, KEPT = 512, 512


def searches(log: DataFrame) -> DataFrame:
    """ts, query (as logged), results, elapsed_ms."""
    return log.select("ts", log_form(F.col("query")).alias("query"), "results", "elapsed_ms")


def clicks(log: DataFrame) -> DataFrame:
    """ts, query, url of clicks on safe urls, cut at 2048 characters."""
    return log.where(urls.is_safe(F.col("url"))).select("ts", log_form(F.col("query")).alias("query"), F.substring("url", 1, 2048).alias("url"))


def totals(search_log: DataFrame, click_log: DataFrame) -> DataFrame:
    """One row: searches, clicks, zero_rate, avg_ms."""
    s = search_log.agg(F.count("*").alias("searches"), F.coalesce(F.avg((F.col("results") == 0).cast("double")), F.lit(0.0)).alias("zero_rate"), F.coalesce(F.avg("elapsed_ms"), F.lit(0.0)).alias("avg_ms"))
    return s.crossJoin(F.broadcast(click_log.agg(F.count("*").alias("clicks"))))  # a row each


def p95(log: DataFrame, order: list[str], value: str, ring: int = RING) -> DataFrame:
    """One row: p95 of the latest ``ring`` values, the one at place (n - 1) * 95 / 100 of their order."""
    latest = log.orderBy(*(F.desc(c) for c in order)).limit(ring).agg(F.array_sort(F.collect_list(value)).alias("v"))
    return latest.select(F.get("v", F.floor((F.size("v") - 1) * 95 / 100).cast("int")).alias("p95"))


def per_query(search_log: DataFrame, most: int = KEPT) -> DataFrame:
    """query, count, zero, avg_results, avg_ms, last_seen: the ``most`` frequent, then recent."""
    rows = search_log.groupBy("query").agg(F.count("*").alias("count"), F.count_if(F.col("results") == 0).alias("zero"), F.avg("results").alias("avg_results"), F.avg("elapsed_ms").alias("avg_ms"), F.max("ts").alias("last_seen"))
    return rows.orderBy(F.desc("count"), F.desc("last_seen"), "query").limit(most)


def per_url(click_log: DataFrame, most: int = KEPT) -> DataFrame:
    """url, clicks, last_query, last_seen."""
    rows = click_log.groupBy("url").agg(F.count("*").alias("clicks"), F.max_by("query", F.struct("ts", "query")).alias("last_query"), F.max("ts").alias("last_seen"))
    return rows.orderBy(F.desc("clicks"), F.desc("last_seen"), "url").limit(most)


def lulls(events: DataFrame, gap_seconds: int = 30, key: list[str] | None = None) -> DataFrame:
    """start, stop, n of the bursts of events that a quiet period of ``gap_seconds`` ends, by ``key`` (columns)."""
    key = key or []
    by = Window.partitionBy(*key).orderBy("ts")
    new = F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(by)) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    burst = events.withColumn("_new", new).withColumn("_b", F.sum("_new").over(by))
    return burst.groupBy(*key, "_b").agg(F.min("ts").alias("start"), F.max("ts").alias("stop"), F.count("*").alias("n")).drop("_b")
