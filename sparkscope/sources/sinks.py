"""Sinks: rows that are not there yet (B1–B3), appended facts and rollup partials (B4, B5), exports."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import action_name, controller_name, other_time, share_pct
from ..functions.sql_text import REPEAT_THRESHOLD
from ..operators.spans import row_patterns


def new_rows(rows: DataFrame, stored: DataFrame | None, keys: list[str]) -> DataFrame:
    """B1, B2: one row of each key that ``stored`` does not have."""
    once = rows.dropDuplicates(keys)
    return once if stored is None else once.join(stored.select(*keys), keys, "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to ``path``, on whichever file system it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, set as the session's; a new one where a local session names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def append(rows: DataFrame, path: str, day: Column | None = None) -> None:
    """Append to a table partitioned by day where a time is given, so that windows and retention prune whole partitions."""
    if day is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.withColumn("day", F.to_date(day)).write.mode("append").partitionBy("day").parquet(path)


def insert(rows: DataFrame, path: str, keys: list[str], day: Column | None = None) -> DataFrame:
    """Append the new rows among ``rows`` to the table at ``path`` and return them; only its keys are read."""
    spark = rows.sparkSession
    fresh = new_rows(rows, spark.read.parquet(path) if exists(spark, path) else None, keys)
    # What is new must not be judged again after the append, whatever executors are lost by then: it is written first.
    shared_folder(spark)
    fresh = fresh.checkpoint()
    append(fresh, path, day)
    return fresh


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON object per row."""
    rows.write.mode("overwrite").json(path)


def export_csv(rows: DataFrame, path: str) -> None:
    """Scalar columns with a header; nested ones as JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("array", "map", "struct")) else F.col(c) for c, kind in rows.dtypes]
    rows.select(*flat).write.mode("overwrite").option("header", True).csv(path)


#: Headings of an exported request, in order.
EXPORT_HEADINGS = (
    "Transaction ID", "Timestamp", "Transaction Name", "Operation", "Duration (ms)", "DB Time (ms)", "View Time (ms)", "Environment", "Release", "Server Name", "HTTP Method", "HTTP Status", "HTTP URL",
    "Total Queries", "Unique Query Patterns", "N+1 Patterns", "DB Overhead %", "View Overhead %", "Other Time (ms)", "Controller", "Action", "Created At",
)
EXAMPLE_CHARS = 200


def export_sections(transactions: DataFrame, patterns: DataFrame | None = None, keys: Sequence[str] = ("project_id", "transaction_id")) -> DataFrame:
    """The lines of each request's export, ``keys, line, cells``: its own figures, then its query patterns, those that
    repeat too often, and its tags, each with a heading after a blank line and only where there are any.

    ``patterns`` are ``query_patterns`` of the same keys; without them, each row's own ``breadcrumbs`` and ``spans`` tell them.
    """
    flagged = F.col("count") > REPEAT_THRESHOLD
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if isinstance(c, str) else F.coalesce(c.cast("string"), F.lit(""))
    by_first = F.array_sort(F.collect_list(F.struct("pattern", "count", "example")))
    if patterns is None:
        own_patterns = F.transform(row_patterns(), lambda p: F.struct(p["pattern"].alias("pattern"), p["count"].alias("count"), p["example"].alias("example")))
        rows = transactions.withColumn("patterns", own_patterns).withColumn("n_flagged", F.size(F.filter("patterns", lambda p: p["count"] > REPEAT_THRESHOLD)))
    else:
        told = patterns.groupBy(*keys).agg(by_first.alias("patterns"), F.count_if(flagged).alias("n_flagged"))
        rows = transactions.join(told, list(keys), "left")
    d, db, view, name = F.col("duration"), F.col("db_time"), F.col("view_time"), F.col("transaction_name")
    own = [text(c) for c in ("transaction_id", "timestamp", "transaction_name", "op")] + [text(c) for c in (d, db, view)] + [text(c) for c in ("environment", "release", "server_name", "http_method", "http_status", "http_url", "query_count")]
    own += [text(F.coalesce(F.size("patterns"), F.lit(0))), text(F.coalesce("n_flagged", F.lit(0))), text(share_pct(db, d)), text(share_pct(view, d)), text(other_time(d, db, view)), text(controller_name(name)), text(action_name(name)), text("timestamp")]
    cells = "array<array<string>>"
    line = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    blank = F.array().cast("array<string>")
    section = lambda some, title, heads, lines: F.when(some, F.concat(F.array(blank, line(title), line(*heads)), lines)).otherwise(F.array().cast(cells))
    short = lambda x: F.when(F.length(x) > EXAMPLE_CHARS, F.concat(F.substring(x, 1, EXAMPLE_CHARS - 3), F.lit("..."))).otherwise(F.coalesce(x, F.lit("N/A")))
    tags = F.map_entries(F.coalesce(F.from_json("tags", "map<string,string>"), F.create_map().cast("map<string,string>")))
    many = F.filter("patterns", lambda p: p["count"] > REPEAT_THRESHOLD)
    whole = F.concat(
        F.array(line(*EXPORT_HEADINGS), F.array(*own)),
        section(F.size("patterns") > 0, "Query Patterns Details", ("Pattern", "Count", "Example Query"), F.transform("patterns", lambda p: F.array(p["pattern"], p["count"].cast("string"), short(p["example"])))),
        section(F.size(many) > 0, "N+1 Query Warnings", ("Pattern",), F.transform(many, lambda p: F.array(p["pattern"]))),
        section(F.size(tags) > 0, "Tags", ("Key", "Value"), F.transform(tags, lambda t: F.array(t["key"], t["value"]))))
    return rows.select(*keys, F.posexplode(whole).alias("line", "cells"))


def csv_line(cells: Column) -> Column:
    """One line of CSV: quoted where it must be."""
    return F.array_join(F.transform(cells, lambda c: F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(c, F.lit("")))), ",")
