"""Percentiles of merged latency buckets (E4–E6) and of raw durations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.latency import bucket_index, bucket_ms
from ..plans.window import TimeWindow
from .filters import Scope

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def percentiles_from_counts(counts: DataFrame, *keys: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Per key, the midpoint of the first bucket whose running count reaches the quantile of the total.

    ``counts`` is added up per bucket first, so that a key's window holds about a thousand rows at most, whatever the input.
    """
    quantiles = quantiles or QUANTILES
    merged = counts.groupBy(*keys, "bucket_index").agg(F.sum("count").alias("n"))
    # Without keys the window has one partition, of buckets only.
    span = Window.partitionBy(*keys)
    running = merged.withColumn("running", F.sum("n").over(span.orderBy("bucket_index"))).withColumn("whole", F.sum("n").over(span))
    found = [F.min(F.when(F.col("running") >= F.lit(q) * F.col("whole"), F.col("bucket_index"))).alias(f"_{name}") for name, q in quantiles.items()]
    return running.groupBy(*keys).agg(*found, F.max("whole").alias("sampled")).select(*keys, *[bucket_ms(F.col(f"_{name}")).alias(name) for name in quantiles], "sampled")


def merged_counts(histogram: DataFrame, transactions: DataFrame, window: TimeWindow, scope: Scope = Scope()) -> DataFrame:
    """E5, H1: bucket counts of the rollup's whole hours before the end's hour, and of the raw rows from there on."""
    hour = F.col("hour_bucket")
    rolled = scope.apply(histogram, rollup=True).filter((hour >= F.lit(window.first_hour)) & (hour < F.lit(window.last_hour)))
    begin = max(window.begin, window.last_hour)
    raw = scope.apply(transactions).filter((F.col("timestamp") >= F.lit(begin)) & (F.col("timestamp") < F.lit(window.end)))
    columns = ["project_id", "transaction_name", "bucket_index", "count"]
    return rolled.select(*columns).unionByName(raw.select("project_id", "transaction_name", bucket_index(F.col("duration")).alias("bucket_index"), F.lit(1).cast("long").alias("count")))


def merged_percentiles(histogram: DataFrame, transactions: DataFrame, window: TimeWindow, scope: Scope = Scope(), by_name: bool = False) -> DataFrame:
    """E5 for the whole scope, E6 by endpoint: the same plan under one more key, so both agree."""
    return percentiles_from_counts(merged_counts(histogram, transactions, window, scope), *(["transaction_name"] if by_name else []))


def nearest_rank(transactions: DataFrame, *keys: str, quantiles: dict[str, float] | None = None) -> DataFrame:
    """Raw count, mean, extremes and the value at place floor(n q) of each key.

    Rows are counted by duration before they move, so that a key's window holds its distinct milliseconds, not its rows.
    """
    quantiles = quantiles or {"p50": 0.5, "p95": 0.95}
    counts = transactions.groupBy(*keys, "duration").agg(F.count("*").alias("_n"))
    span = Window.partitionBy(*keys)
    placed = counts.withColumn("_upto", F.sum("_n").over(span.orderBy("duration"))).withColumn("_all", F.sum("_n").over(span))
    at = lambda q: F.least(F.floor(F.col("_all") * F.lit(q)), F.col("_all") - 1)
    picks = [F.min(F.when(F.col("_upto") > at(q), F.col("duration"))).alias(name) for name, q in quantiles.items()]
    return placed.groupBy(*keys).agg(F.sum("_n").alias("count"), (F.sum(F.col("duration") * F.col("_n")) / F.sum("_n")).alias("avg_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), *picks)
