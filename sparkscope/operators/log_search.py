"""Log search (C9, I10, G2), level counts and facets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.log_text import LEVELS, fts_match, level_name
from ..plans.window import TimeWindow
from .filters import inclusive


@dataclass(frozen=True)
class LogFilter:
    """Optional equalities; an unknown level is no filter."""

    project_id: int | None = None
    level: str | None = None
    logger_name: str | None = None
    trace_id: str | None = None
    environment: str | None = None
    release: str | None = None
    service: str | None = None
    source: str | None = None
    min_duration_ms: float | None = None

    def apply(self, logs: DataFrame) -> DataFrame:
        for name in ("project_id", "logger_name", "trace_id", "environment", "release", "service", "source"):
            value = getattr(self, name)
            if value is not None and value != "":
                logs = logs.filter(F.col(name) == F.lit(value))
        if self.level in LEVELS:
            logs = logs.filter(F.col("level") == LEVELS[self.level])
        return logs if self.min_duration_ms is None else logs.filter(F.col("duration_ms") >= self.min_duration_ms)


def search_logs(logs: DataFrame, query: str | None = None, window: TimeWindow | None = None, wanted: LogFilter = LogFilter(), limit: int = 50) -> DataFrame:
    """Newest first: range and equalities reach the scan, the full-text predicate runs on what they leave."""
    rows = wanted.apply(logs if window is None else logs.filter(inclusive(window)))
    columns = [F.col(c) for c in ("body", "attrs_text") if c in logs.columns]
    return rows.filter(fts_match(columns, query)).orderBy(F.desc("timestamp"), F.desc("id")).limit(max(1, min(limit, 200)))


def level_counts(logs: DataFrame, *keys: str) -> DataFrame:
    return logs.groupBy(*keys, "level").agg(F.count("*").alias("count")).withColumn("level_name", level_name(F.col("level")))
