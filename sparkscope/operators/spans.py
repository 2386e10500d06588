"""Span trees: order and depth (G6, D10), summaries (E20, E21, C17), timing (I5), repeated queries."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import waterfall
from ..functions.sql_text import REPEAT_THRESHOLD, is_infrastructure, once, sql_pattern, truncate_sql

SPAN_CAP = 1000
#: The category of breadcrumbs that are queries.
QUERY_CATEGORY = "sql.active_record"


def ordered_children(spans: Column) -> Column:
    """Children by start, ties by their place in the payload, the first thousand of them."""
    placed = F.transform(spans, lambda s, i: F.struct(F.coalesce(s["start_timestamp"], F.lit(0.0)).alias("at"), i.alias("place"), s.alias("span")))
    return F.transform(F.slice(F.array_sort(placed), 1, SPAN_CAP), lambda x: x["span"])


def depths(root_id: Column, children: Column) -> Column:
    """One more than the parent's depth as known when a span's turn comes; unknown and later parents count as the root.

    The order of the spans decides, so it is a walk: one look-up for each span, over batches of ids alone. A repeated id takes
    its last depth.
    """

    def walk(root: pa.Array, ids: pa.Array) -> pa.Array:
        out = []
        for own, spans in zip(root.to_pylist(), ids.to_pylist(), strict=True):
            known, found = {own or "": 0}, []
            for span in spans or []:
                depth = known.get(span["parent"] or "", 0) + 1
                if span["own"] is not None:
                    known[span["own"]] = depth
                found.append(depth)
            out.append(found)
        return pa.array(out, pa.list_(pa.int32()))

    # Made here, as workers that import this module have no session.
    walk.__annotations__ = {"root": pa.Array, "ids": pa.Array, "return": pa.Array}
    return F.arrow_udf(walk, "array<int>")(root_id, F.transform(children, lambda s: F.struct(s["span_id"].alias("own"), s["parent_span_id"].alias("parent"))))


def span_rows(transactions: DataFrame) -> DataFrame:
    """Transactions with ``spans`` arrays to one row per span, the root at sequence and depth 0, and whether spans were cut."""
    children = transactions.withColumn("_kids", ordered_children(F.col("spans"))).withColumn("_depths", depths(F.col("root_span_id"), F.col("_kids")))
    kid = lambda s, i: F.struct(s["span_id"].alias("span_id"), s["parent_span_id"].alias("parent_span_id"), s["op"].alias("op"), s["description"].alias("description"), s["start_timestamp"].alias("start_timestamp"), s["timestamp"].alias("end_timestamp"), F.get("_depths", i).alias("depth"), (i + 1).alias("sequence"))
    root = F.struct(F.col("root_span_id").alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("op").alias("op"), F.col("transaction_name").alias("description"), F.col("start_timestamp").alias("start_timestamp"), F.col("end_timestamp").alias("end_timestamp"), F.lit(0).alias("depth"), F.lit(0).alias("sequence"))
    rows = children.select("project_id", "transaction_id", (F.size("spans") > SPAN_CAP).alias("spans_truncated"), F.explode(F.concat(F.array(root), F.transform("_kids", kid))).alias("s"))
    return rows.select("project_id", "transaction_id", "spans_truncated", "s.*")


def op_summary(spans: DataFrame, *keys: str) -> DataFrame:
    """Per op count, total and mean milliseconds over all spans, whatever the list's filter."""
    return spans.groupBy(*keys, "op").agg(F.count("*").alias("count"), F.sum("duration_ms").alias("total_ms"), F.round(F.avg("duration_ms"), 1).alias("avg_ms"))


def repeated_descriptions(spans: DataFrame, *keys: str, op_prefix: str | None = None) -> DataFrame:
    """Descriptions that occur more than three times, with the op of the first."""
    rows = spans.filter("trim(description) != ''")
    rows = rows if op_prefix is None else rows.filter(F.col("op").startswith(op_prefix))
    return rows.groupBy(*keys, "description").agg(F.count("*").alias("count"), F.sum("duration_ms").alias("total_ms"), F.min_by("op", "sequence").alias("op")).filter(F.col("count") > REPEAT_THRESHOLD)


def list_spans(spans: DataFrame, op_prefix: str | None = None, limit: int = 100) -> DataFrame:
    """C17, G2."""
    rows = spans if op_prefix is None else spans.filter(F.col("op").startswith(op_prefix))
    return rows.orderBy("transaction_id", "sequence").limit(max(1, min(limit, 1000)))


def with_waterfall(spans: DataFrame) -> DataFrame:
    """Where each span lies within its transaction, whose duration is the spans' end.

    A window reads the spans once: a task sorts them, and neither tells all transactions apart in memory nor joins them again.
    """
    own = Window.partitionBy("transaction_id")
    rows = spans.withColumn("root_start", F.min("start_ms").over(own)).withColumn("root_end", F.max(F.col("start_ms") + F.col("duration_ms")).over(own))
    at = waterfall(F.col("start_ms"), F.col("duration_ms"), F.col("root_start"), F.col("root_end") - F.col("root_start"))
    return rows.withColumn("w", at).select(*spans.columns, F.round("w.offset_pct", 4).alias("offset_pct"), F.round("w.width_pct", 4).alias("width_pct"))


def timing(spans: Column, op: str) -> Column:
    """The sum of the op's rounded span times; null where there is none or it is not positive."""
    own = F.filter(spans, lambda s: s["op"] == op)
    ms = F.transform(own, lambda s: F.coalesce(F.round((s["timestamp"] - s["start_timestamp"]) * 1000).cast("long"), F.lit(0).cast("long")))
    total = F.aggregate(ms, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(total > 0, total)


def query_patterns(breadcrumbs: DataFrame, spans: DataFrame | None = None, keys: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """Patterns of a transaction's queries (``keys, pos, category, sql``) with counts, distinct texts, the first
    example, and the time of the database spans (``keys, op, description, duration_ms``) of the same shape.

    Each distinct text of a transaction is counted before its shape is taken, so repeats are neither parsed nor moved again.
    """
    queries = breadcrumbs.filter((F.col("category") == QUERY_CATEGORY) & ~is_infrastructure(F.col("sql"))).filter("trim(sql) != ''")
    texts = queries.groupBy(*keys, "sql").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    found = texts.withColumn("pattern", sql_pattern(F.col("sql"))).groupBy(*keys, "pattern").agg(
        F.sum("n").alias("count"), F.count("*").alias("distinct_count"), F.min_by("sql", F.struct("first", "sql")).alias("example")).withColumn("example", truncate_sql(F.col("example")))
    if spans is None:
        return found.withColumn("total_time_ms", F.lit(None).cast("double"))
    timed = spans.filter(F.col("op").startswith("db") & (F.trim("description") != "") & F.col("duration_ms").isNotNull())
    summed = timed.groupBy(*keys, "description").agg(F.sum("duration_ms").alias("ms"))
    times = summed.withColumn("pattern", sql_pattern(F.col("description"))).groupBy(*keys, "pattern").agg(F.round(F.sum("ms"), 1).alias("total_time_ms"))
    return found.join(times, [*keys, "pattern"], "left")


def _equal_runs(values: Column, field: str) -> Column:
    """An array that is sorted by a field of its items, as the arrays of those that are equal by it."""
    first = lambda a: F.array_compact(F.transform(a, lambda x, i: F.when((i == 0) | (F.get(a, i - 1)[field] != x[field]), i)))
    cut = lambda a, at: F.transform(at, lambda i, k: F.slice(a, i + 1, F.coalesce(F.get(at, k + 1), F.size(a)) - i))
    return once(F.sort_array(values), lambda a: once(first(a), lambda at: cut(a, at)))


def row_patterns() -> Column:
    """What ``query_patterns`` says, by the ``breadcrumbs`` and ``spans`` arrays of a transaction's own row.

    Queries and timed spans are one array, sorted by text and then by shape, so that a request is read once, nothing moves, and
    time grows with the request's length but for the sorting.
    """
    kind = "array<struct<sql:string,pos:int,ms:double>>"
    placed = F.transform("breadcrumbs", lambda b, i: F.struct(F.when((b["category"] == QUERY_CATEGORY) & (F.trim(b["data"]["sql"]) != ""), b["data"]["sql"]).alias("sql"), i.alias("pos"), F.lit(None).alias("ms")))
    ms = lambda s: (s["timestamp"] - s["start_timestamp"]) * 1000
    timed = F.transform("spans", lambda s: F.struct(F.when(s["op"].startswith("db") & (F.trim(s["description"]) != ""), s["description"]).alias("sql"), F.lit(None).alias("pos"), ms(s).alias("ms")))
    whole = F.concat(*[F.coalesce(x.cast(kind), F.array().cast(kind)) for x in (placed, timed)])
    whole = F.filter(whole, lambda x: x["sql"].isNotNull() & (x["pos"].isNotNull() | x["ms"].isNotNull()))

    count = lambda run: F.aggregate(run, F.lit(0).cast("bigint"), lambda n, x: n + x["n"])
    spent = lambda run: F.aggregate(run, F.lit(None).cast("double"), lambda a, x: F.coalesce(a + x["ms"], a, x["ms"]))

    def text(run: Column) -> Column:
        sql = F.get(run, F.lit(0))["sql"]
        asked = once(F.filter(run, lambda x: x["pos"].isNotNull()), lambda q: F.when((F.size(q) > 0) & ~is_infrastructure(sql), q))
        # Equal texts are sorted by place: the first of them was asked first.
        told = lambda q: F.struct(sql_pattern(sql).alias("pattern"), F.get(q, F.lit(0))["pos"].alias("pos"), sql.alias("sql"), F.coalesce(F.size(q), F.lit(0)).cast("bigint").alias("n"), spent(run).alias("ms"))
        return once(asked, told)

    def shape(run: Column) -> Column:
        asked = F.filter(run, lambda x: x["n"] > 0)
        return F.struct(F.get(run, F.lit(0))["pattern"].alias("pattern"), count(run).alias("count"), F.size(asked).cast("bigint").alias("distinct_count"), once(F.get(asked, F.lit(0))["sql"], truncate_sql).alias("example"), F.round(spent(run), 1).alias("total_time_ms"))

    shapes = F.transform(_equal_runs(F.transform(_equal_runs(whole, "sql"), text), "pattern"), shape)
    return F.filter(shapes, lambda x: x["count"] > 0)


def patterns_of_rows(transactions: DataFrame, keys: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """The rows of ``query_patterns``, row by row: a transaction that comes twice is told twice."""
    return transactions.select(*keys, F.explode(row_patterns()).alias("s")).select(*keys, "s.*")


def repeated_queries(breadcrumbs: DataFrame, spans: DataFrame | None = None, keys: Sequence[str] = ("transaction_id",)) -> DataFrame:
    """Per transaction all queries (blank ones too), shapes, flagged shapes, those of them that are one text again and
    again, and the time that flagged ones took (null where untimed)."""
    total = breadcrumbs.filter((F.col("category") == QUERY_CATEGORY) & ~is_infrastructure(F.col("sql"))).groupBy(*keys).agg(F.count("*").alias("total_queries"))
    flagged = F.col("count") > REPEAT_THRESHOLD
    shapes = query_patterns(breadcrumbs, spans, keys).groupBy(*keys).agg(
        F.count("*").alias("unique_patterns"), F.count_if(flagged).alias("flagged_patterns"), F.count_if(flagged & (F.col("distinct_count") == 1)).alias("identical_patterns"),
        F.round(F.sum(F.when(flagged, F.col("total_time_ms")))).cast("long").alias("wasted_ms"))
    zero = {"unique_patterns": 0, "flagged_patterns": 0, "identical_patterns": 0}
    return total.join(shapes, list(keys), "left").na.fill(zero)


def flagged_patterns(patterns: Column) -> Column:
    """Of a stored map from pattern to count, those that count as repeated."""
    return F.map_filter(patterns, lambda _, n: n > REPEAT_THRESHOLD)
