"""Hourly rollups: scalar measures (E1) and latency histograms (E2), their merge (B4, B5) and recount."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.latency import bucket_index

KEYS = ["project_id", "transaction_name", "environment", "hour_bucket"]
SUMS = ["count", "sum_duration", "sum_db_time", "db_time_count", "sum_view_time", "view_time_count", "sum_query_count", "n_plus_one_count", "sum_n_plus_one_time", "error_count"]


def keyed(transactions: DataFrame) -> DataFrame:
    """A null environment becomes the blank one; the hour is the UTC hour."""
    return transactions.withColumn("environment", F.coalesce("environment", F.lit(""))).withColumn("hour_bucket", F.date_trunc("hour", "timestamp"))


def measures() -> list[Column]:
    """The 13 measures of an hour; missing times are in no count, errors are 5xx and up."""
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    status = F.col("http_status").try_cast("int")
    return [
        F.count("*").alias("count"), total("duration", "sum_duration"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"),
        total("db_time", "sum_db_time"), F.count("db_time").alias("db_time_count"), total("view_time", "sum_view_time"), F.count("view_time").alias("view_time_count"),
        total("query_count", "sum_query_count"), F.max("query_count").alias("max_query_count"), F.count_if("has_n_plus_one").alias("n_plus_one_count"),
        total("n_plus_one_time", "sum_n_plus_one_time"), F.count_if(F.coalesce(status >= 500, F.lit(False))).alias("error_count")]


def hourly_stats(transactions: DataFrame) -> DataFrame:
    """The measures by project, endpoint, environment and hour."""
    return keyed(transactions).groupBy(*KEYS).agg(*measures())


def latency_histogram(transactions: DataFrame) -> DataFrame:
    """Counts by key and latency bucket."""
    return keyed(transactions).groupBy(*KEYS, bucket_index(F.col("duration")).alias("bucket_index")).agg(F.count("*").alias("count"))


def merge_stats(parts: DataFrame, *keys: str) -> DataFrame:
    """Sums add, extremes take the extreme, nulls aside; over ``keys`` (the rollup's own by default)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return parts.groupBy(*(keys or KEYS)).agg(*[total(c) for c in SUMS], F.min("min_duration").alias("min_duration"), F.max("max_duration").alias("max_duration"), F.max("max_query_count").alias("max_query_count"))


def merge_histogram(parts: DataFrame, *keys: str) -> DataFrame:
    """Counts add."""
    return parts.groupBy(*(keys or KEYS), "bucket_index").agg(F.sum("count").alias("count"))


def recount_hours(existing: DataFrame, recounted: DataFrame) -> DataFrame:
    """Recounted keys replace the existing ones; all other keys stay, so stale ones and aged hours do too."""
    keys = KEYS + (["bucket_index"] if "bucket_index" in existing.columns else [])
    return recounted.unionByName(existing.join(recounted.select(*keys), keys, "left_anti"))


def hour_slice(transactions: DataFrame, hour: datetime) -> DataFrame:
    """The raw rows of one hour, the input of its recount."""
    return transactions.filter((F.col("timestamp") >= F.lit(hour)) & (F.col("timestamp") < F.lit(hour) + F.expr("interval 1 hour")))
