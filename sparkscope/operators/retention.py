"""Retention (B10, B12), storage figures (E24) and health."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.window import RETENTION_DAYS


def survivors(rows: DataFrame, as_of: datetime, stream: str, column: str = "timestamp", days: int | None = None) -> DataFrame:
    """Rows not older than the stream's cutoff; on tables partitioned by date this prunes whole partitions."""
    return rows.filter(F.col(column) >= F.lit(as_of - timedelta(days=RETENTION_DAYS[stream] if days is None else days)))


def retired(rows: DataFrame, as_of: datetime, stream: str, column: str = "timestamp", days: int | None = None) -> DataFrame:
    return rows.filter(F.col(column) < F.lit(as_of - timedelta(days=RETENTION_DAYS[stream] if days is None else days)))


def cascade(spans: DataFrame, gone: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Spans whose transaction stays."""
    return spans.join(gone.select(key).distinct(), key, "left_anti")


def data_span(rows: DataFrame, column: str = "timestamp") -> DataFrame:
    """Rows, first and last time and days between, one decimal."""
    days = (F.unix_timestamp(F.max(column)) - F.unix_timestamp(F.min(column))) / 86400
    return rows.agg(F.count("*").alias("row_count"), F.min(column).alias("oldest"), F.max(column).alias("newest"), F.round(days, 1).alias("days"))


def stored_bytes(rows: DataFrame) -> int:
    """Bytes of the files behind a table."""
    context = rows.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path
    conf = context._jsc.hadoopConfiguration()
    return sum(hadoop(f).getFileSystem(conf).getFileStatus(hadoop(f)).getLen() for f in rows.inputFiles())


def text_ratio(rows: DataFrame, column: str, fraction: float = 0.01, seed: int = 1) -> DataFrame:
    """Mean bytes of a text column over a sample."""
    return rows.sample(fraction=fraction, seed=seed).agg(F.count("*").alias("sampled"), F.avg(F.octet_length(column)).alias("avg_bytes"))


def health(rows: DataFrame, as_of: datetime) -> DataFrame:
    """Rows of the last minute, hour and day in one pass."""
    since = lambda s: F.count_if(F.col("timestamp") > F.lit(as_of - timedelta(seconds=s)))
    return rows.filter(F.col("timestamp") <= F.lit(as_of)).agg(since(60).alias("last_minute"), since(3600).alias("last_hour"), since(86400).alias("last_day"))


def queue_status(depth: int) -> str:
    """By the waiting jobs."""
    return "critical" if depth >= 100 else "warning" if depth >= 50 else "ok"
