"""Correlation by trace (D3–D9, D11) and backfills from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["project_id", "trace_id"]


def _traced(rows: DataFrame) -> DataFrame:
    return rows.filter("trim(trace_id) != ''")


def newest_transaction(transactions: DataFrame) -> DataFrame:
    """The newest transaction of each trace, ties by the larger id."""
    return _traced(transactions).groupBy(*KEYS).agg(F.max_by(F.struct("transaction_id", "transaction_name", "duration"), F.struct("timestamp", "id")).alias("t")).select(*KEYS, "t.*")


def with_transaction(rows: DataFrame, transactions: DataFrame) -> DataFrame:
    """Rows of any stream with their trace's transaction, if there is one."""
    return rows.join(newest_transaction(transactions), KEYS, "left")


def events_of_transactions(transactions: DataFrame, events: DataFrame, limit: int = 25) -> DataFrame:
    """Each transaction's newest events. They are those of its trace, so each trace is cut to its newest ones first, in its
    tasks before they meet, and a busy trace never joins as a whole."""
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("event_at"), F.desc("event_row"))
    few = _traced(events).select(*KEYS, F.col("id").alias("event_row"), F.col("timestamp").alias("event_at")).withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= limit)
    return _traced(transactions).select(*KEYS, "transaction_id").join(few, KEYS)


def log_counts(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """Rows with the number of logs of their trace; the logs are counted before the join."""
    counts = _traced(logs).groupBy(*KEYS).agg(F.count("*").alias("log_count"))
    return rows.join(counts, KEYS, "left").withColumn("log_count", F.coalesce("log_count", F.lit(0)))


def trace_logs(logs: DataFrame, trace_id: str, project_id: int | None = None, limit: int = 100) -> DataFrame:
    """A trace's logs, oldest first, of all projects unless one is named."""
    rows = logs.filter(F.col("trace_id") == trace_id)
    rows = rows if project_id is None else rows.filter(F.col("project_id") == project_id)
    return rows.orderBy("timestamp", "id").limit(max(1, min(limit, 500)))


def with_project(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """The project's name and slug; rows of unknown projects stay."""
    return rows.join(projects.select(F.col("id").alias("project_id"), F.col("name").alias("project_name"), F.col("slug").alias("project_slug")), "project_id", "left")


def resolve_projects(rows: DataFrame, projects: DataFrame, asked: str = "asked") -> DataFrame:
    """C14: rows with the ``project_id`` that a text names: by slug, then by name, both case folded, then by id; null where it names
    none or several. Each of the three is a look-up of its own in a table with a row for each project."""
    found = rows.withColumn("_asked", F.lower(F.trim(asked)))
    for n, key in enumerate((F.lower("slug"), F.lower("name"), F.col("id").cast("string"))):
        named = projects.groupBy(key.alias("_asked")).agg(F.count("*").alias(f"_many{n}"), F.min("id").alias(f"_id{n}"))
        found = found.join(named, "_asked", "left")
    told = F.lit(None).cast("int")
    for n in (2, 1, 0):
        told = F.when(F.col(f"_many{n}") == 1, F.col(f"_id{n}")).when(F.col(f"_many{n}") > 1, F.lit(None)).otherwise(told)
    return found.withColumn("project_id", F.when(F.col("_asked") != "", told).cast("int")).drop("_asked", *[f"_{c}{n}" for n in range(3) for c in ("many", "id")])


def backfill_trace(rows: DataFrame, sources: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Null trace ids from the first row of another table with the same key; ids that are there stay."""
    first = _traced(sources).groupBy(key).agg(F.min_by("trace_id", "sequence").alias("_trace"))
    return rows.join(first, key, "left").withColumn("trace_id", F.coalesce("trace_id", "_trace")).drop("_trace")


def backfill_from_payload(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """Null trace ids from the row's own stored payload; what is no JSON tells nothing."""
    told = F.try_variant_get(F.try_parse_json(payload), "$.contexts.trace.trace_id", "string")
    return rows.withColumn("trace_id", F.coalesce("trace_id", told))
