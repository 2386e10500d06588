"""Zero-filled time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.latency import bucket_index
from ..plans.window import Bucketing, TimeWindow
from . import rollup
from .filters import Scope, half_open, whole_hours
from .percentiles import percentiles_from_counts


def time_bucket(timestamp: Column, buckets: Bucketing) -> Column:
    """Whole seconds over the width, truncated towards zero: the hour before the origin falls into bucket 0."""
    seconds = F.unix_timestamp(timestamp) - F.unix_timestamp(F.lit(buckets.origin))
    return F.when(seconds < 0, -F.floor(-seconds / buckets.width)).otherwise(F.floor(seconds / buckets.width)).cast("int")


def every_bucket(spark: SparkSession, buckets: Bucketing) -> DataFrame:
    """All bucket indices with their starts."""
    index = F.col("id").cast("int")
    return spark.range(buckets.count).select(index.alias("bucket"), F.timestamp_seconds(F.unix_timestamp(F.lit(buckets.origin)) + index * buckets.width).alias("bucket_start"))


def fill(rows: DataFrame, buckets: Bucketing, zeros: dict[str, object], *keys: str) -> DataFrame:
    """All buckets of each key; buckets beyond the last are dropped."""
    frame = every_bucket(rows.sparkSession, buckets)
    # The frame has a row for each bucket asked for, a few hundred at most.
    grid = rows.select(*keys).distinct().withColumn("_all", F.sequence(F.lit(0), F.lit(buckets.count - 1))).select(*keys, F.explode("_all").alias("bucket")).join(F.broadcast(frame), "bucket") if keys else frame
    return grid.join(rows, [*keys, "bucket"], "left").na.fill(zeros)


def rollup_source(histogram: DataFrame, hourly: DataFrame, transactions: DataFrame, window: TimeWindow, buckets: Bucketing, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """T4: histogram and scalar rows with their time bucket, from the rollups when these tile the buckets, else from raw rows."""
    if buckets.hourly and not scope.release:
        rolled = lambda df: scope.apply(df, rollup=True).filter(whole_hours(window)).withColumn("bucket", time_bucket(F.col("hour_bucket"), buckets))
        return rolled(histogram), rolled(hourly)
    raw = scope.apply(transactions).filter(half_open(window)).withColumn("bucket", time_bucket(F.col("timestamp"), buckets))
    counts = raw.groupBy("project_id", "transaction_name", "bucket", bucket_index(F.col("duration")).alias("bucket_index")).agg(F.count("*").alias("count"))
    return counts, raw.groupBy("project_id", "transaction_name", "bucket").agg(F.count("*").alias("count"), F.sum("duration").alias("sum_duration"))


def p95_by_bucket(histogram: DataFrame, hourly: DataFrame, transactions: DataFrame, window: TimeWindow, buckets: Bucketing, scope: Scope = Scope()) -> DataFrame:
    """T5: p95 per endpoint and bucket in whole milliseconds, 0 where there is none."""
    counts, _ = rollup_source(histogram, hourly, transactions, window, buckets, scope)
    found = percentiles_from_counts(counts, "transaction_name", "bucket", quantiles={"p95": 0.95})
    return fill(found.select("transaction_name", "bucket", F.round("p95").cast("long").alias("p95")), buckets, {"p95": 0}, "transaction_name")


def volume_by_bucket(histogram: DataFrame, hourly: DataFrame, transactions: DataFrame, window: TimeWindow, buckets: Bucketing, scope: Scope = Scope()) -> DataFrame:
    """Requests per bucket."""
    _, scalars = rollup_source(histogram, hourly, transactions, window, buckets, scope)
    return fill(scalars.groupBy("bucket").agg(F.sum("count").alias("count")), buckets, {"count": 0})


def endpoint_timeseries(histogram: DataFrame, hourly: DataFrame, transactions: DataFrame, window: TimeWindow, buckets: Bucketing, scope: Scope = Scope()) -> DataFrame:
    """Count and rounded percentiles per bucket; an empty bucket has count 0 and no percentiles."""
    counts, _ = rollup_source(histogram, hourly, transactions, window, buckets, scope)
    found = percentiles_from_counts(counts, "bucket").select("bucket", F.col("sampled").alias("count"), *[F.round(q).cast("long").alias(q) for q in ("p50", "p95", "p99")])
    return fill(found, buckets, {"count": 0})


def global_timeseries(histogram: DataFrame, hourly: DataFrame, transactions: DataFrame, window: TimeWindow, buckets: Bucketing, scope: Scope = Scope()) -> DataFrame:
    """Count and mean duration per bucket, 0 where empty."""
    _, scalars = rollup_source(histogram, hourly, transactions, window, buckets, scope)
    rows = scalars.groupBy("bucket").agg(F.sum("count").alias("count"), F.round(F.sum("sum_duration") / F.sum("count"), 1).alias("avg_duration"))
    return fill(rows, buckets, {"count": 0, "avg_duration": 0.0})


def event_counts_by_bucket(events: DataFrame, window: TimeWindow, buckets: int, *keys: str) -> DataFrame:
    """Events per key and bucket; the width is rounded down, so what lies past the last whole bucket is dropped."""
    grid = Bucketing(window.begin, max(1, window.seconds // buckets), buckets)
    rows = events.filter(F.col("timestamp").between(F.lit(window.begin), F.lit(window.end))).withColumn("bucket", time_bucket(F.col("timestamp"), grid)).filter(F.col("bucket") < buckets)
    return fill(rows.groupBy(*keys, "bucket").agg(F.count("*").alias("count")), grid, {"count": 0}, *keys)


def series_summary(series: DataFrame, value: str, *keys: str) -> DataFrame:
    """Peak and its bucket, least of the buckets that are not zero, and the sum of a series."""
    return series.groupBy(*keys).agg(F.max(value).alias("peak"), F.max_by("bucket", F.struct(F.col(value), -F.col("bucket"))).alias("peak_bucket"), F.min(F.when(F.col(value) > 0, F.col(value))).alias("best"), F.sum(value).alias("total"))


def deploy_markers(releases: DataFrame, window: TimeWindow, buckets: Bucketing) -> DataFrame:
    """Releases first seen within the window, with the bucket of a series that they fall into."""
    return releases.filter(F.col("first_seen_at").between(F.lit(window.begin), F.lit(window.end))).withColumn("bucket", time_bucket(F.col("first_seen_at"), buckets))


def rebuild(transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both rollups of raw rows."""
    return rollup.latency_histogram(transactions), rollup.hourly_stats(transactions)
