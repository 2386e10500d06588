"""Endpoint analytics over rollups and raw rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.latency import bucket_index
from ..functions.scalars import percent_change
from ..plans.window import TimeWindow
from . import rollup
from .filters import Scope, SlowFilter, inclusive, whole_hours
from .percentiles import merged_percentiles, nearest_rank, percentiles_from_counts


def mean(total: str, n: str, places: int = 1) -> Column:
    return F.when(F.col(n) > 0, F.round(F.col(total) / F.col(n), places))


def window_summary(hourly: DataFrame, window: TimeWindow, scope: Scope = Scope(), *keys: str) -> DataFrame:
    """The 13 measures over the window's whole hours, in all or by ``keys``."""
    rows = scope.apply(hourly, rollup=True).filter(whole_hours(window))
    return rollup.merge_stats(rows, *keys) if keys else rollup.merge_stats(rows.withColumn("_all", F.lit(1)), "_all").drop("_all")


def percentiles_block(hourly: DataFrame, histogram: DataFrame, transactions: DataFrame, window: TimeWindow, scope: Scope = Scope()) -> DataFrame:
    """Averages, extremes and percentiles of a project, or of an endpoint when the scope names one; one row."""
    summary = window_summary(hourly, window, scope).select(
        "count", mean("sum_duration", "count").alias("avg_duration"), "min_duration", "max_duration", mean("sum_db_time", "db_time_count").alias("avg_db_time"),
        mean("sum_view_time", "view_time_count").alias("avg_view_time"), "error_count", F.lit(1).alias("_one"))
    quantiles = merged_percentiles(histogram, transactions, window, scope).drop("sampled").withColumn("_one", F.lit(1))
    return summary.join(quantiles, "_one", "left").drop("_one")


def release_block(transactions: DataFrame, window: TimeWindow, scope: Scope) -> DataFrame:
    """The same from raw rows, which alone know releases; percentiles rounded."""
    rows = scope.apply(transactions).filter(inclusive(window))
    summary = rows.agg(F.count("*").alias("count"), F.round(F.avg("duration"), 1).alias("avg_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"),
                       F.round(F.avg("db_time"), 1).alias("avg_db_time"), F.round(F.avg("view_time"), 1).alias("avg_view_time")).withColumn("_one", F.lit(1))
    counts = rows.groupBy(bucket_index(F.col("duration")).alias("bucket_index")).agg(F.count("*").alias("count"))
    quantiles = percentiles_from_counts(counts).select(*[F.round(q).cast("long").alias(q) for q in ("p50", "p95", "p99")], F.lit(1).alias("_one"))
    return summary.join(quantiles, "_one", "left").drop("_one")


def endpoint_impact(hourly: DataFrame, histogram: DataFrame, transactions: DataFrame, window: TimeWindow, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """Endpoints by time spent, the winners alone with percentiles; ties by name."""
    ranked = window_summary(hourly, window, scope, "transaction_name").select(
        "transaction_name", "count", mean("sum_duration", "count").alias("avg_duration"), F.col("sum_duration").alias("time_spent"), "max_duration", mean("sum_query_count", "count").alias("avg_queries"),
        "max_query_count", "n_plus_one_count", "error_count").orderBy(F.desc("time_spent"), "transaction_name").limit(limit)
    # At most ``limit`` rows: the winners prune the histogram before its aggregation.
    top = F.broadcast(ranked)
    only = lambda df: df.join(F.broadcast(ranked.select("transaction_name")), "transaction_name", "left_semi")
    quantiles = merged_percentiles(only(histogram), only(transactions), window, scope, by_name=True).drop("sampled")
    return quantiles.join(top, "transaction_name", "right").select(*ranked.columns, "p50", "p95", "p99").orderBy(F.desc("time_spent"), "transaction_name")


def n_plus_one_worklist(hourly: DataFrame, window: TimeWindow, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """Endpoints with repeated queries by wasted time, then by how often; waste of untimed rows is 0."""
    rows = window_summary(hourly, window, scope, "transaction_name").filter("n_plus_one_count > 0")
    return rows.select("transaction_name", "count", "n_plus_one_count", F.round(F.col("n_plus_one_count") / F.col("count") * 100, 1).alias("n_plus_one_pct"), F.col("sum_n_plus_one_time").alias("wasted_ms"),
                       F.round(F.col("sum_n_plus_one_time") / F.col("n_plus_one_count"), 1).alias("avg_wasted_ms"), "max_query_count").orderBy(F.desc("wasted_ms"), F.desc("n_plus_one_count"), "transaction_name").limit(limit)


def error_rate(hourly: DataFrame, window: TimeWindow, scope: Scope = Scope()) -> DataFrame:
    """Totals, errors and their per cent, 0 for an empty window."""
    return window_summary(hourly, window, scope).select(
        F.col("count").alias("total"), F.col("error_count").alias("errors"), F.when(F.col("count") > 0, F.round(F.col("error_count") / F.col("count") * 100, 2)).otherwise(F.lit(0.0)).alias("error_rate"))


def count_in_range(hourly: DataFrame, transactions: DataFrame, window: TimeWindow | None, scope: Scope = Scope()) -> DataFrame:
    """From the rollup within a window, else from all raw rows."""
    return scope.apply(transactions).agg(F.count("*").alias("count")) if window is None else window_summary(hourly, window, scope).select("count")


def slow_transactions(transactions: DataFrame, window: TimeWindow, scope: Scope = Scope(), slow: SlowFilter = SlowFilter(), limit: int = 20) -> DataFrame:
    """G1: the slowest requests; ties by id."""
    return slow.apply(scope.apply(transactions)).filter(inclusive(window)).orderBy(F.desc("duration"), "id").limit(max(1, min(limit, 100)))


def recent_transactions(transactions: DataFrame, window: TimeWindow, scope: Scope = Scope(), limit: int = 20) -> DataFrame:
    """The newest requests of a scope; ties by the larger id."""
    return scope.apply(transactions).filter(inclusive(window)).orderBy(F.desc("timestamp"), F.desc("id")).limit(max(1, min(limit, 100)))


def extreme_requests(transactions: DataFrame, window: TimeWindow, *keys: str) -> DataFrame:
    """The fastest and slowest request by ``keys``; ties by the smaller id."""
    rows = transactions.filter(inclusive(window))
    return rows.groupBy(*keys).agg(F.min_by("id", F.struct("duration", "id")).alias("fastest_id"), F.min("duration").alias("fastest_ms"), F.max_by("id", F.struct(F.col("duration"), (-F.col("id")).alias("id"))).alias("slowest_id"), F.max("duration").alias("slowest_ms"))


def compare_windows(transactions: DataFrame, before: TimeWindow, after: TimeWindow, *keys: str) -> DataFrame:
    """Raw count, mean and p95 of two windows side by side, with changes in floating point."""
    sides = []
    for name, window in (("before", before), ("after", after)):
        got = nearest_rank(transactions.filter(inclusive(window)), *keys, quantiles={"p95": 0.95})
        sides.append(got.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in ("count", "avg_duration", "p95")]))
    joined = sides[0].join(sides[1], list(keys), "full")
    count = lambda side: F.coalesce(f"{side}_count", F.lit(0))
    return joined.select(*keys, count("before").alias("before_count"), count("after").alias("after_count"), F.round("before_avg_duration", 1).alias("before_avg"), F.round("after_avg_duration", 1).alias("after_avg"), "before_p95", "after_p95",
                         percent_change(F.col("before_avg_duration"), F.col("after_avg_duration")).alias("avg_change_pct"), percent_change(F.col("before_p95"), F.col("after_p95")).alias("p95_change_pct"), (count("after") - count("before")).alias("count_change"))


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page and the row after it, which tells whether there is a next one without a count."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size + 1)


def newest_by(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows of each key."""
    span = Window.partitionBy(*keys).orderBy(F.desc("timestamp"), F.desc("id"))
    return rows.withColumn("_n", F.row_number().over(span)).filter(F.col("_n") <= n).drop("_n")


#: Hours of the named scopes.
RECENT_HOURS = {"last_hour": 1, "last_24_hours": 24, "last_7_days": 168}


def recent(rows: DataFrame, as_of: datetime, name: str) -> DataFrame:
    """Rows after the named scope's begin, which does not count itself."""
    return rows.filter(F.col("timestamp") > F.lit(as_of - timedelta(hours=RECENT_HOURS[name])))


def by(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows whose columns have the given values, newest first; None asks for rows without a value."""
    for column, value in equal.items():
        rows = rows.filter(F.col(column).eqNullSafe(F.lit(value)))
    return rows.orderBy(F.desc("timestamp"), F.desc("id"))
