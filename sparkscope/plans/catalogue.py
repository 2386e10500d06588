"""The registered queries over the driver's tables, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import log_text, scalars
from ..operators import analytics, issues, log_search, monitors, percentiles, retention, rollup, series, spans, traces
from ..operators.filters import Scope, SlowFilter, inclusive
from ..sources import envelope, payloads, sinks, views
from . import oracle
from .oracle import MERGE, mean, query
from .window import TimeWindow, bucketing_for, resolve_window

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
#: Hours of the window that the registered queries look back from the newest event.
HOURS = 168


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def seconds(*names: str) -> list[Column]:
    return [F.unix_timestamp(n).alias(n) for n in names]


def sec(expression: str) -> str:
    return f"CAST(floor(epoch({expression})) AS BIGINT)"


def _window(spark: SparkSession, sf_dir: str, hours: float = HOURS) -> TimeWindow:
    return resolve_window(views.as_of(spark, sf_dir), hours=hours)


def _rolled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    t = views.transactions(spark, sf_dir)
    return rollup.hourly_stats(t), rollup.latency_histogram(t), t


# Rollups and endpoint analytics


@register("endpoint_impact", query(
    f"""SELECT r.transaction_name, r.count, {mean('sum_duration', 'r.count')} AS avg_duration, sum_duration AS time_spent, max_duration, {mean('sum_query_count', 'r.count')} AS avg_queries, max_query_count, n_plus_one_count, error_count,
    round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM (SELECT transaction_name, {MERGE} FROM inside GROUP BY 1 ORDER BY sum_duration DESC, 1 LIMIT 20) r LEFT JOIN pct USING (transaction_name)""",
    "inside", "merged", **oracle.percentiles("merged", "transaction_name")))
def endpoint_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.endpoint_impact(*_rolled(spark, sf_dir), _window(spark, sf_dir))
    return found.withColumns({q: F.round(q, 6) for q in ("p50", "p95", "p99")})


def _block_sql(where: str) -> str:
    body = f"""SELECT count, {mean('sum_duration', 'count')} AS avg_duration, min_duration, max_duration, {mean('sum_db_time', 'db_time_count')} AS avg_db_time, {mean('sum_view_time', 'view_time_count')} AS avg_view_time, error_count,
      round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99 FROM (SELECT {MERGE} FROM inside WHERE {where}), pct"""
    return query(body, "inside", "merged", chosen=f"SELECT * FROM merged WHERE {where}", **oracle.percentiles("chosen"))


def _block(spark: SparkSession, sf_dir: str, scope: Scope) -> DataFrame:
    found = analytics.percentiles_block(*_rolled(spark, sf_dir), _window(spark, sf_dir), scope)
    return found.withColumns({q: F.round(q, 6) for q in ("p50", "p95", "p99")})


@register("project_percentiles", _block_sql("project_id = 1"))
def project_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block(spark, sf_dir, Scope(project_id=1))


@register("endpoint_percentiles", _block_sql("transaction_name = 'click'"))
def endpoint_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block(spark, sf_dir, Scope(name="click"))


@register("endpoint_percentiles_like", _block_sql("transaction_name ILIKE '%C_i%'"))
def endpoint_percentiles_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block(spark, sf_dir, Scope(name_like="C_i"))


@register("release_percentiles", query(
    """SELECT (SELECT count(*) FROM own) AS count, (SELECT round(avg(duration), 1) FROM own) AS avg_duration, (SELECT min(duration) FROM own) AS min_duration, (SELECT max(duration) FROM own) AS max_duration,
    (SELECT round(avg(db_time), 1) FROM own) AS avg_db_time, (SELECT round(avg(view_time), 1) FROM own) AS avg_view_time, CAST(round(p50) AS BIGINT) AS p50, CAST(round(p95) AS BIGINT) AS p95, CAST(round(p99) AS BIGINT) AS p99 FROM pct""",
    "txn", "span_of_time", own="SELECT t.* FROM txn t, span_of_time WHERE timestamp BETWEEN begin_at AND as_of AND transaction_name = 'view' AND release = 'v1'",
    counted="SELECT CAST(floor(ln(greatest(duration, 1)) / ln(1.02)) AS INTEGER) AS bucket_index, count(*) AS count FROM own GROUP BY 1", **oracle.percentiles("counted")))
def release_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.release_block(views.transactions(spark, sf_dir), _window(spark, sf_dir), Scope(name="view", release="v1"))


@register("hourly_stats_rollup", query(f"SELECT * REPLACE ({sec('hour_bucket')} AS hour_bucket) FROM hourly", "hourly"))
def hourly_stats_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.hourly_stats(views.transactions(spark, sf_dir)).withColumn("hour_bucket", F.unix_timestamp("hour_bucket"))


@register("latency_histogram", query(f"SELECT * REPLACE ({sec('hour_bucket')} AS hour_bucket) FROM hist", "hist"))
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.latency_histogram(views.transactions(spark, sf_dir)).withColumn("hour_bucket", F.unix_timestamp("hour_bucket"))


@register("window_summary", query(f"SELECT transaction_name, {MERGE} FROM inside GROUP BY 1", "inside"))
def window_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.window_summary(_rolled(spark, sf_dir)[0], _window(spark, sf_dir), Scope(), "transaction_name")


@register("merged_percentiles_by_name", query("SELECT transaction_name, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, sampled FROM pct", "merged", **oracle.percentiles("merged", "transaction_name")))
def merged_percentiles_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, hist, t = _rolled(spark, sf_dir)
    found = percentiles.merged_percentiles(hist, t, _window(spark, sf_dir), by_name=True)
    return found.withColumns({q: F.round(q, 6) for q in ("p50", "p95", "p99")})


@register("rollup_recount_merge", query(
    f"""SELECT project_id, transaction_name, environment, {sec('hour_bucket')} AS hour_bucket, bucket_index, CASE WHEN hour_bucket = last_hour THEN count ELSE count * 2 END AS count FROM hist, span_of_time
    UNION ALL SELECT -1, 'stale', '', {sec('last_hour')}, 7, 9 FROM span_of_time""", "hist", "span_of_time"))  # fmt: skip
def rollup_recount_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partials appended twice, merged, and the last hour counted anew: its keys are right again, a stale key stays."""
    _, hist, t = _rolled(spark, sf_dir)
    last = _window(spark, sf_dir).last_hour
    stale = spark.createDataFrame([(-1, "stale", "", last, 7, 9)], "project_id int, transaction_name string, environment string, hour_bucket timestamp, bucket_index int, count long")
    merged = rollup.merge_histogram(hist.unionByName(hist).unionByName(stale))
    return rollup.recount_hours(merged, rollup.latency_histogram(rollup.hour_slice(t, last))).withColumn("hour_bucket", F.unix_timestamp("hour_bucket"))


@register("n_plus_one_worklist", query(
    f"""SELECT transaction_name, count, n_plus_one_count, round(n_plus_one_count / count * 100, 1) AS n_plus_one_pct, sum_n_plus_one_time AS wasted_ms, round(sum_n_plus_one_time / n_plus_one_count, 1) AS avg_wasted_ms, max_query_count
    FROM (SELECT transaction_name, {MERGE} FROM inside GROUP BY 1) WHERE n_plus_one_count > 0 ORDER BY wasted_ms DESC, n_plus_one_count DESC, 1 LIMIT 20""", "inside"))  # fmt: skip
def n_plus_one_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.n_plus_one_worklist(_rolled(spark, sf_dir)[0], _window(spark, sf_dir))


@register("error_rate", query("SELECT CAST(sum(count) AS BIGINT) AS total, CAST(sum(error_count) AS BIGINT) AS errors, round(sum(error_count) / sum(count) * 100, 2) AS error_rate FROM inside WHERE project_id = 2", "inside"))
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.error_rate(_rolled(spark, sf_dir)[0], _window(spark, sf_dir), Scope(project_id=2))


@register("count_in_range", query("SELECT CAST(sum(count) AS BIGINT) AS in_window, (SELECT count(*) FROM txn) AS ever FROM inside", "inside"))
def count_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly, _, t = _rolled(spark, sf_dir)
    inside = analytics.count_in_range(hourly, t, _window(spark, sf_dir)).withColumnRenamed("count", "in_window")
    # Two tables of one row each.
    return inside.join(analytics.count_in_range(hourly, t, None).withColumnRenamed("count", "ever"), F.lit(True))


@register("endpoint_stats", query(f"SELECT transaction_name, count, {mean('sum_duration', 'count')} AS avg_duration, max_duration FROM (SELECT transaction_name, {MERGE} FROM inside WHERE environment = 'production' GROUP BY 1) ORDER BY sum_duration DESC, 1 LIMIT 3", "inside"))
def endpoint_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.endpoint_impact(*_rolled(spark, sf_dir), _window(spark, sf_dir), Scope(environment="production"), limit=3)
    return found.select("transaction_name", "count", "avg_duration", "max_duration")


# Time series


def _series_sql(select: str, zero: str, key: str = "", **parts: str) -> str:
    """All buckets of 7 hours from the window's begin, 24 of them; the hour before the origin counts to the first."""
    grid = "SELECT CAST(range AS INTEGER) AS bucket, " + sec("begin_at") + " + range * 25200 AS bucket_start FROM range(24), span_of_time"
    by = f"(SELECT DISTINCT {key} FROM found) CROSS JOIN " if key else ""
    on = f"bucket, {key}" if key else "bucket"
    return query(f"SELECT {key + ', ' if key else ''}bucket, bucket_start, {zero} FROM ({"SELECT * FROM " + by if key else "SELECT * FROM "}grid) LEFT JOIN found USING ({on})", "inside", "hist", "span_of_time",
                 placed=f"SELECT h.*, CAST(({sec('hour_bucket')} - {sec('begin_at')}) // 25200 AS INTEGER) AS bucket FROM hist h, span_of_time WHERE hour_bucket BETWEEN first_hour AND last_hour",
                 scalars=f"SELECT h.*, CAST(({sec('hour_bucket')} - {sec('begin_at')}) // 25200 AS INTEGER) AS bucket FROM inside h, span_of_time", grid=grid, **parts, found=select)


def _series(spark: SparkSession, sf_dir: str, f: Callable[..., DataFrame]) -> DataFrame:
    hourly, hist, t = _rolled(spark, sf_dir)
    window = _window(spark, sf_dir)
    return f(hist, hourly, t, window, bucketing_for(window, 24)).withColumn("bucket_start", F.unix_timestamp("bucket_start"))


@register("p95_by_bucket", _series_sql("SELECT transaction_name, bucket, CAST(round(p95) AS BIGINT) AS p95 FROM pct", "coalesce(p95, 0) AS p95", "transaction_name", **oracle.percentiles("placed", "transaction_name", "bucket", names=("p95",))))
def p95_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, series.p95_by_bucket)


@register("volume_by_bucket", _series_sql("SELECT bucket, CAST(sum(count) AS BIGINT) AS count FROM scalars GROUP BY 1", "coalesce(count, 0) AS count"))
def volume_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, series.volume_by_bucket)


@register("endpoint_timeseries", _series_sql(
    "SELECT bucket, sampled AS count, CAST(round(p50) AS BIGINT) AS p50, CAST(round(p95) AS BIGINT) AS p95, CAST(round(p99) AS BIGINT) AS p99 FROM pct", "coalesce(count, 0) AS count, p50, p95, p99",
    chosen="SELECT * FROM placed WHERE transaction_name = 'click'", **oracle.percentiles("chosen", "bucket")))
def endpoint_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, lambda *a: series.endpoint_timeseries(*a, Scope(name="click")))


@register("global_timeseries", _series_sql("SELECT bucket, CAST(sum(count) AS BIGINT) AS count, round(sum(sum_duration) / sum(count), 1) AS avg_duration FROM scalars GROUP BY 1", "coalesce(count, 0) AS count, coalesce(avg_duration, 0.0) AS avg_duration"))
def global_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _series(spark, sf_dir, series.global_timeseries)


@register("raw_timeseries", query(
    f"""SELECT bucket, bucket_start, coalesce(count, 0) AS count FROM (SELECT CAST(range AS INTEGER) AS bucket, {sec("as_of - INTERVAL 6 HOUR")} + range * 900 AS bucket_start FROM range(24), span_of_time)
    LEFT JOIN (SELECT CAST(({sec('timestamp')} - {sec("as_of - INTERVAL 6 HOUR")}) // 900 AS INTEGER) AS bucket, count(*) AS count FROM txn, span_of_time WHERE timestamp >= as_of - INTERVAL 6 HOUR AND timestamp < as_of AND release = 'v2' GROUP BY 1) USING (bucket)""",
    "txn", "span_of_time"))
def raw_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters of an hour and one release: from raw rows, which alone can tell them."""
    hourly, hist, t = _rolled(spark, sf_dir)
    window = _window(spark, sf_dir, 6)
    return series.volume_by_bucket(hist, hourly, t, window, bucketing_for(window, 24), Scope(release="v2")).withColumn("bucket_start", F.unix_timestamp("bucket_start"))


@register("series_summary", _series_sql("SELECT bucket, CAST(sum(count) AS BIGINT) AS count FROM scalars GROUP BY 1", "coalesce(count, 0) AS count").replace("SELECT bucket, bucket_start, coalesce(count, 0) AS count", "SELECT max(coalesce(count, 0)) AS peak, arg_max(bucket, (coalesce(count, 0), -bucket)) AS peak_bucket, min(count) AS best, CAST(sum(count) AS BIGINT) AS total"))
def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_summary(_series(spark, sf_dir, series.volume_by_bucket), "count")


@register("event_counts_by_bucket", query(
    f"""SELECT fingerprint, bucket, {sec('begin_at')} + bucket * 25200 AS bucket_start, coalesce(count, 0) AS count FROM (SELECT * FROM (SELECT DISTINCT fingerprint FROM counted) CROSS JOIN (SELECT CAST(range AS INTEGER) AS bucket FROM range(24)) CROSS JOIN span_of_time)
    LEFT JOIN counted USING (fingerprint, bucket)""", "err", "span_of_time",
    counted=f"SELECT fingerprint, CAST(({sec('timestamp')} - {sec('begin_at')}) // 25200 AS INTEGER) AS bucket, count(*) AS count FROM err, span_of_time WHERE timestamp BETWEEN begin_at AND as_of AND ({sec('timestamp')} - {sec('begin_at')}) // 25200 < 24 GROUP BY ALL"))
def event_counts_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.event_counts_by_bucket(views.errors(spark, sf_dir), _window(spark, sf_dir), 24, "fingerprint").withColumn("bucket_start", F.unix_timestamp("bucket_start"))


@register("deploy_markers", query(
    f"""SELECT project_id, version, {sec('first_seen_at')} AS first_seen_at, CAST(({sec('first_seen_at')} - {sec('as_of - INTERVAL 719 HOUR')}) // 108000 AS INTEGER) AS bucket
    FROM (SELECT project_id, release AS version, min(timestamp) AS first_seen_at FROM txn GROUP BY ALL), span_of_time WHERE first_seen_at BETWEEN as_of - INTERVAL 719 HOUR AND as_of""", "txn", "span_of_time"))  # fmt: skip
def deploy_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = _window(spark, sf_dir, 719)
    found = series.deploy_markers(issues.release_sightings(views.transactions(spark, sf_dir)), window, bucketing_for(window, 24))
    return found.select("project_id", "version", *seconds("first_seen_at"), "bucket")


# Requests


_SLOW = "SELECT id, transaction_name, duration, {at} AS timestamp FROM txn, span_of_time WHERE timestamp BETWEEN begin_at AND as_of AND {where} ORDER BY duration DESC, id LIMIT 50"


@register("slow_transactions", query(_SLOW.format(at=sec("timestamp"), where="duration > 100 AND duration <= 100000 AND environment = 'staging'"), "txn", "span_of_time"))
def slow_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.slow_transactions(views.transactions(spark, sf_dir), _window(spark, sf_dir), Scope(environment="staging"), SlowFilter(100, 100000), 50)
    return found.select("id", "transaction_name", "duration", *seconds("timestamp"))


@register("slow_by_tag", query(_SLOW.format(at=sec("timestamp"), where="id % 100 = 7"), "txn", "span_of_time"))
def slow_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.slow_transactions(views.transactions(spark, sf_dir), _window(spark, sf_dir), slow=SlowFilter(tags={"k": "7"}), limit=50)
    return found.select("id", "transaction_name", "duration", *seconds("timestamp"))


@register("transactions_by_endpoint", query(f"SELECT id, transaction_id, duration, {sec('timestamp')} AS timestamp, http_status FROM txn, span_of_time WHERE timestamp BETWEEN begin_at AND as_of AND transaction_name = 'view' ORDER BY txn.timestamp DESC, id DESC LIMIT 100", "txn", "span_of_time"))
def transactions_by_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = analytics.recent_transactions(views.transactions(spark, sf_dir), _window(spark, sf_dir), Scope(name="view"), 100)
    return found.select("id", "transaction_id", "duration", *seconds("timestamp"), "http_status")


@register("page_of_transactions", query("SELECT id, duration FROM txn WHERE duration >= 50 ORDER BY duration DESC, id LIMIT 51 OFFSET 50", "txn"))
def page_of_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.page(views.transactions(spark, sf_dir).filter("duration >= 50").select("id", "duration"), [F.desc("duration"), F.col("id")], 2)


@register("extreme_requests", query("SELECT transaction_name, arg_min(id, (duration, id)) AS fastest_id, min(duration) AS fastest_ms, arg_max(id, (duration, -id)) AS slowest_id, max(duration) AS slowest_ms FROM txn, span_of_time WHERE timestamp BETWEEN begin_at AND as_of GROUP BY 1", "txn", "span_of_time"))
def extreme_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.extreme_requests(views.transactions(spark, sf_dir), _window(spark, sf_dir), "transaction_name")


@register("newest_by_endpoint", query("SELECT project_id, transaction_name, id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, transaction_name ORDER BY timestamp DESC, id DESC) AS n FROM txn) WHERE n <= 3", "txn"))
def newest_by_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.newest_by(views.transactions(spark, sf_dir), ["project_id", "transaction_name"], 3).select("project_id", "transaction_name", "id")


def _rank(q: str, rows: str) -> str:
    return f"list_sort(list(duration) FILTER ({rows}))[least(CAST(floor(count(*) FILTER ({rows}) * CAST({q} AS DOUBLE)) AS BIGINT), count(*) FILTER ({rows}) - 1) + 1]"


@register("nearest_rank_percentiles", query(f"SELECT transaction_name, count(*) AS count, round(avg(duration), 6) AS avg_duration, min(duration) AS min_duration, max(duration) AS max_duration, {_rank('0.5', 'true')} AS p50, {_rank('0.95', 'true')} AS p95 FROM txn GROUP BY 1", "txn"))
def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles.nearest_rank(views.transactions(spark, sf_dir), "transaction_name").withColumn("avg_duration", F.round("avg_duration", 6))


_B, _A = "timestamp BETWEEN as_of - INTERVAL 336 HOUR AND begin_at", "timestamp BETWEEN begin_at AND as_of"


@register("compare_before_after", query(
    """SELECT transaction_name, before_count, after_count, round(b, 1) AS before_avg, round(a, 1) AS after_avg, before_p95, after_p95, CASE WHEN b <> 0 THEN round((a - b) / b * 100, 1) END AS avg_change_pct,
    CASE WHEN before_p95 <> 0 THEN round((after_p95 - before_p95) / CAST(before_p95 AS DOUBLE) * 100, 1) END AS p95_change_pct, after_count - before_count AS count_change FROM both_sides""", "txn", "span_of_time",
    both_sides=f"""SELECT transaction_name, count(*) FILTER ({_B}) AS before_count, count(*) FILTER ({_A}) AS after_count, avg(duration) FILTER ({_B}) AS b, avg(duration) FILTER ({_A}) AS a,
    {_rank('0.95', _B)} AS before_p95, {_rank('0.95', _A)} AS after_p95 FROM txn, span_of_time WHERE timestamp >= as_of - INTERVAL 336 HOUR GROUP BY 1"""))  # fmt: skip
def compare_before_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    after = _window(spark, sf_dir)
    before = TimeWindow(after.begin - timedelta(hours=HOURS), after.begin)
    return analytics.compare_windows(views.transactions(spark, sf_dir), before, after, "transaction_name")


@register("duration_bands", query(
    """SELECT CASE WHEN duration >= 2000 THEN 'critical' WHEN duration >= 1000 THEN 'slow' WHEN duration >= 500 THEN 'moderate' ELSE 'fast' END AS band, count(*) AS count, count(*) FILTER (duration > 1000) AS slow,
    count(*) FILTER (http_status LIKE '2%') AS success, count(*) FILTER (http_status LIKE '4%' OR http_status LIKE '5%') AS http_errors FROM txn GROUP BY 1""", "txn"))  # fmt: skip
def duration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("http_status")
    return views.transactions(spark, sf_dir).groupBy(scalars.latency_band(F.col("duration")).alias("band")).agg(
        F.count("*").alias("count"), F.count_if(scalars.is_slow(F.col("duration"))).alias("slow"), F.count_if(scalars.is_success(status)).alias("success"), F.count_if(scalars.is_http_error(status)).alias("http_errors"))


@register("overhead_breakdown", query(
    """SELECT id, CASE WHEN duration > 0 AND db_time IS NOT NULL THEN round(db_time / duration * 100, 2) ELSE 0 END AS db_pct, CASE WHEN duration > 0 AND view_time IS NOT NULL THEN round(view_time / duration * 100, 2) ELSE 0 END AS view_pct,
    greatest(duration - coalesce(db_time, 0) - coalesce(view_time, 0), 0) AS other_ms, CASE WHEN duration >= 1000 THEN NULL ELSE concat(CAST(duration AS VARCHAR), 'ms') END AS short_label FROM txn""", "txn"))  # fmt: skip
def overhead_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, db, view = F.col("duration"), F.col("db_time"), F.col("view_time")
    return views.transactions(spark, sf_dir).select("id", scalars.share_pct(db, d).alias("db_pct"), scalars.share_pct(view, d).alias("view_pct"), scalars.other_time(d, db, view).alias("other_ms"), F.when(d < 1000, scalars.duration_label(d)).alias("short_label"))


@register("health_counts", query("SELECT count(*) FILTER (timestamp > as_of - INTERVAL 1 MINUTE) AS last_minute, count(*) FILTER (timestamp > as_of - INTERVAL 1 HOUR) AS last_hour, count(*) FILTER (timestamp > as_of - INTERVAL 24 HOUR) AS last_day FROM txn, span_of_time WHERE timestamp <= as_of", "txn", "span_of_time"))
def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.health(views.transactions(spark, sf_dir), views.as_of(spark, sf_dir))


@register("data_span", query(f"SELECT count(*) AS row_count, {sec('min(timestamp)')} AS oldest, {sec('max(timestamp)')} AS newest, round(({sec('max(timestamp)')} - {sec('min(timestamp)')}) / 86400, 1) AS days FROM txn", "txn"))
def data_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retention.data_span(views.transactions(spark, sf_dir)).withColumns({c: F.unix_timestamp(c) for c in ("oldest", "newest")})


# Issues


@register("issue_grouping", query(f"SELECT * REPLACE ({sec('first_seen')} AS first_seen, {sec('last_seen')} AS last_seen) FROM issues", "issues"))
def issue_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.group_issues(views.errors(spark, sf_dir)).withColumns({c: F.unix_timestamp(c) for c in ("first_seen", "last_seen")})


def _changes(found: DataFrame) -> DataFrame:
    """A change log: every issue was ignored once; those of two files were resolved or ignored later, the others reopened."""
    later = F.when(F.contains("fingerprint", F.lit("f1.rb")), issues.RESOLVED).when(F.contains("fingerprint", F.lit("f2.rb")), issues.IGNORED).otherwise(issues.OPEN)
    steps = F.explode(F.array(F.struct(F.lit(1).alias("changed_at"), F.lit(issues.IGNORED).alias("status")), F.struct(F.lit(2).alias("changed_at"), later.alias("status"))))
    return found.select("project_id", "fingerprint", steps.alias("c")).select("project_id", "fingerprint", "c.*")


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues.group_issues(views.errors(spark, sf_dir))
    return issues.current_status(found, _changes(found))


@register("issue_status_counts", query("SELECT project_id, status, count(*) AS count FROM status GROUP BY ALL", "status"))
def issue_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.status_counts(_issues(spark, sf_dir), "project_id")


@register("search_issues", query(f"SELECT project_id, fingerprint, title, count, {sec('last_seen')} AS last_seen FROM status WHERE (contains(lower(title), 'error at 1') OR contains(lower(exception_type), 'error at 1')) AND status = 0 ORDER BY status.last_seen DESC, project_id, fingerprint LIMIT 20", "status"))
def search_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.search_issues(_issues(spark, sf_dir), "Error at 1", "open").select("project_id", "fingerprint", "title", "count", *seconds("last_seen"))


@register("search_issues_escaped", query("SELECT project_id, fingerprint, replace(title, ' at ', ' %_ ') AS title FROM status WHERE contains(title, ' at 3') ORDER BY status.last_seen DESC, project_id, fingerprint LIMIT 20", "status"))
def search_issues_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles hold a per cent sign and an underscore, which stand for themselves; as wildcards they would match all digits."""
    titled = _issues(spark, sf_dir).withColumn("title", F.replace("title", F.lit(" at "), F.lit(" %_ ")))
    return issues.search_issues(titled, "%_ 3", "all").select("project_id", "fingerprint", "title")


@register("issues_by_frequency", query("SELECT project_id, fingerprint, count FROM issues ORDER BY count DESC, project_id, fingerprint LIMIT 20", "issues"))
def issues_by_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.by_frequency(issues.group_issues(views.errors(spark, sf_dir))).select("project_id", "fingerprint", "count")


@register("issue_facets_last_seen", query(f"SELECT * REPLACE ({sec('last_seen_at')} AS last_seen_at) FROM issue_facets", "issue_facets"))
def issue_facets_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.issue_facets(views.errors(spark, sf_dir)).withColumn("last_seen_at", F.unix_timestamp("last_seen_at"))


@register("issues_seen_in_env", query("SELECT project_id, fingerprint, count FROM issues i WHERE EXISTS (SELECT 1 FROM issue_facets f WHERE f.project_id = i.project_id AND f.fingerprint = i.fingerprint AND name = 'environment' AND value = 'staging') AND EXISTS (SELECT 1 FROM issue_facets f WHERE f.project_id = i.project_id AND f.fingerprint = i.fingerprint AND name = 'release' AND value = 'v1')", "issues", "issue_facets"))
def issues_seen_in_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.errors(spark, sf_dir)
    return issues.seen_in(issues.group_issues(e), issues.issue_facets(e), environment="staging", release="v1").select("project_id", "fingerprint", "count")


@register("issue_releases", query("SELECT project_id, fingerprint, string_agg(value, ',' ORDER BY value) AS releases FROM issue_facets WHERE name = 'release' GROUP BY ALL", "issue_facets"))
def issue_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = issues.values_per_issue(issues.issue_facets(views.errors(spark, sf_dir)), "release")
    return found.select("project_id", "fingerprint", F.array_join("values", ",").alias("releases"))


@register("facet_values", query("SELECT DISTINCT project_id, http_status AS value FROM txn", "txn"))
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.facet_values(issues.facets(views.transactions(spark, sf_dir), "transactions", ["environment", "http_status"]), "http_status")


@register("facets_merged", query(f"SELECT project_id, 'transactions' AS stream, 'environment' AS name, environment AS value, {sec('max(timestamp)')} AS last_seen_at FROM txn WHERE environment IS NOT NULL GROUP BY ALL", "txn"))
def facets_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.transactions(spark, sf_dir)
    halves = [issues.facets(t.filter(F.col("id") % 2 == k), "transactions", ["environment"]) for k in (0, 1)]
    return issues.merge_facets(*halves).withColumn("last_seen_at", F.unix_timestamp("last_seen_at"))


@register("release_sightings", query(f"SELECT project_id, release AS version, {sec('min(timestamp)')} AS first_seen_at, {sec('max(timestamp)')} AS last_seen_at, count(*) AS transaction_count FROM txn GROUP BY ALL", "txn"))
def release_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.release_sightings(views.transactions(spark, sf_dir)).withColumns({c: F.unix_timestamp(c) for c in ("first_seen_at", "last_seen_at")})


@register("burst_issues", query("SELECT project_id, fingerprint, rate, title FROM (SELECT project_id, fingerprint, count(*) AS rate FROM err, span_of_time WHERE timestamp > as_of - INTERVAL 1 HOUR AND timestamp <= as_of GROUP BY ALL) JOIN status USING (project_id, fingerprint) WHERE status = 0 AND rate >= 1", "status", "span_of_time"))
def burst_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues.burst_rates(views.errors(spark, sf_dir), _issues(spark, sf_dir), views.as_of(spark, sf_dir), 1)


@register("recount_issues", query("SELECT i.project_id, i.fingerprint, coalesce(n, 0) AS count FROM issues i LEFT JOIN (SELECT project_id, fingerprint, count(*) AS n FROM err, span_of_time WHERE timestamp >= begin_at GROUP BY ALL) USING (project_id, fingerprint)", "issues", "span_of_time"))
def recount_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, as_of = views.errors(spark, sf_dir), views.as_of(spark, sf_dir)
    gone = retention.retired(e, as_of, "events", days=7)
    return issues.recount(issues.group_issues(e), retention.survivors(e, as_of, "events", days=7), gone.unionByName(e)).select("project_id", "fingerprint", "count")


@register("delete_events", query("SELECT project_id, fingerprint, count(*) AS count FROM err WHERE id % 10 <> 3 GROUP BY ALL", "err"))
def delete_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = views.errors(spark, sf_dir)
    return issues.group_issues(issues.delete_events(e, e.filter("id % 10 = 3"))).select("project_id", "fingerprint", "count")


# Traces


@register("event_transaction_trace_join", query("SELECT err.id, transaction_id, transaction_name, duration FROM err LEFT JOIN newest USING (project_id, trace_id)", "err", "newest"))
def event_transaction_trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.with_transaction(views.errors(spark, sf_dir), views.transactions(spark, sf_dir)).select("id", "transaction_id", "transaction_name", "duration")


@register("transaction_events", query("SELECT transaction_id, event_row, position FROM (SELECT transaction_id, e.id AS event_row, CAST(row_number() OVER (PARTITION BY t.project_id, transaction_id ORDER BY e.timestamp DESC, e.id DESC) AS INTEGER) AS position FROM txn t JOIN err e USING (project_id, trace_id)) WHERE position <= 25", "txn", "err"))
def transaction_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.events_of_transactions(views.transactions(spark, sf_dir), views.errors(spark, sf_dir)).select("transaction_id", "event_row", "position")


@register("trace_logs", query("SELECT id, at_s FROM logs WHERE trace_id = 't11-1' ORDER BY at_s, id LIMIT 100", "logs"))
def trace_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.trace_logs(views.logs(spark, sf_dir), "t11-1").select("id", F.unix_timestamp("timestamp").alias("at_s"))


@register("conversation_trace", "SELECT turn AS sequence, role AS logger_name, CAST(length(text) AS BIGINT) AS body_chars FROM conversations WHERE conv_id = 3")
def conversation_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.conversation_logs(spark, sf_dir).filter("trace_id = 'c3'").select("sequence", "logger_name", "body_chars").orderBy("sequence")


@register("transaction_log_counts", query("SELECT id, coalesce(n, 0) AS log_count FROM txn LEFT JOIN (SELECT project_id, trace_id, count(*) AS n FROM logs GROUP BY ALL) USING (project_id, trace_id)", "txn", "logs"))
def transaction_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.log_counts(views.transactions(spark, sf_dir), views.logs(spark, sf_dir)).select("id", "log_count")


@register("project_names", query("SELECT id, concat('Project ', CAST(project_id AS VARCHAR)) AS project_name FROM err", "err"))
def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.with_project(views.errors(spark, sf_dir), views.projects(spark)).select("id", "project_name")


@register("backfill_trace", query("SELECT transaction_id, CASE WHEN id % 3 = 0 THEN coalesce(first_trace, NULL) ELSE trace_id END AS trace_id FROM txn LEFT JOIN (SELECT transaction_id, trace_id AS first_trace FROM txn) USING (transaction_id)", "txn"))
def backfill_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.transactions(spark, sf_dir)
    holes = t.withColumn("trace_id", F.when(F.col("id") % 3 != 0, F.col("trace_id")))
    sources = t.select("transaction_id", "trace_id", F.lit(1).alias("sequence")).unionByName(t.select("transaction_id", F.lit("later").alias("trace_id"), F.lit(2).alias("sequence")))
    return traces.backfill_trace(holes, sources).select("transaction_id", "trace_id")


# Spans and queries


@register("span_op_summary", query("SELECT op, count(*) AS count, CAST(sum(duration_ms) AS BIGINT) AS total_ms, round(avg(duration_ms), 1) AS avg_ms FROM spans GROUP BY 1", "spans"))
def span_op_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.op_summary(views.spans(spark, sf_dir))


@register("repeated_span_descriptions", query("SELECT transaction_id, description, count(*) AS count, CAST(sum(duration_ms) AS BIGINT) AS total_ms, arg_min(op, (sequence, duration_ms, op)) AS op FROM spans GROUP BY 1, 2 HAVING count(*) > 3", "spans"))
def repeated_span_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Line numbers repeat within an order of the driver's tables; ties go by time and op.
    rows = views.spans(spark, sf_dir).withColumn("sequence", F.struct("sequence", "duration_ms", "op"))
    return spans.repeated_descriptions(rows, "transaction_id")


@register("spans_by_op", query("SELECT transaction_id, sequence, op, duration_ms FROM spans WHERE op LIKE 'db%' AND transaction_id = (SELECT min(transaction_id) FROM spans WHERE op LIKE 'db%')", "spans"))
def spans_by_op(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.spans(spark, sf_dir)
    first = rows.filter(F.col("op").startswith("db")).agg(F.min("transaction_id").alias("transaction_id"))
    return spans.list_spans(rows.join(first, "transaction_id", "left_semi"), "db", 1000).select("transaction_id", "sequence", "op", "duration_ms")


@register("span_waterfall", query(
    """SELECT transaction_id, sequence, duration_ms, start_ms, round(least(greatest((start_ms - root_start) / whole * 100, 0), 100), 4) AS offset_pct, round(least(greatest(duration_ms / whole * 100, 0.25), 100), 4) AS width_pct
    FROM (SELECT *, min(start_ms) OVER w AS root_start, CAST(greatest(max(start_ms + duration_ms) OVER w - min(start_ms) OVER w, 1) AS DOUBLE) AS whole FROM (SELECT *, sequence * 40 AS start_ms FROM spans) WINDOW w AS (PARTITION BY transaction_id))""", "spans"))  # fmt: skip
def span_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.spans(spark, sf_dir).select("transaction_id", "sequence", "duration_ms", (F.col("sequence") * 40).alias("start_ms"))
    return spans.with_waterfall(rows)


@register("span_depth", query(
    """SELECT transaction_id, CAST(0 AS INTEGER) AS sequence, 'root' AS span_id, CAST(0 AS INTEGER) AS depth FROM (SELECT DISTINCT transaction_id FROM placed)
    UNION ALL SELECT transaction_id, CAST(place AS INTEGER), span_id, CAST(place - max(CASE WHEN below_root THEN place END) OVER (PARTITION BY transaction_id ORDER BY place) + 1 AS INTEGER) FROM placed""",
    placed="""SELECT l_orderkey AS transaction_id, concat('s', CAST(l_linenumber AS VARCHAR)) AS span_id, row_number() OVER w AS place, l_partkey % 3 = 0 OR row_number() OVER w = 1 AS below_root
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag)"""))  # fmt: skip
def span_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span hangs below its predecessor or below the root: its depth counts from the last one below the root."""
    return spans.span_rows(views.span_trees(spark, sf_dir)).select("transaction_id", "sequence", "span_id", "depth")


_SHAPED = f"SELECT transaction_id, pos, sql, {oracle.pattern_sql('sql')} AS pattern FROM crumbs WHERE trim(sql) <> '' AND NOT contains(sql, 'solid_queue_jobs')"
_SHAPES = "SELECT transaction_id, pattern, count(*) AS n, count(DISTINCT sql) AS distinct_n, arg_min(sql, (pos, sql)) AS example FROM shaped GROUP BY 1, 2"


@register("query_patterns", query("SELECT transaction_id, pattern, n AS count, distinct_n AS distinct_count, example FROM shapes", "crumbs", shaped=_SHAPED, shapes=_SHAPES))
def query_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.query_patterns(views.breadcrumbs(spark, sf_dir, gathered=True)).select("transaction_id", "pattern", "count", "distinct_count", "example")


@register("repeated_queries", query(
    """SELECT transaction_id, total_queries, coalesce(unique_patterns, 0) AS unique_patterns, coalesce(flagged_patterns, 0) AS flagged_patterns, coalesce(identical_patterns, 0) AS identical_patterns
    FROM (SELECT transaction_id, count(*) AS total_queries FROM crumbs WHERE NOT contains(sql, 'solid_queue_jobs') GROUP BY 1)
    LEFT JOIN (SELECT transaction_id, count(*) AS unique_patterns, count(*) FILTER (n > 3) AS flagged_patterns, count(*) FILTER (n > 3 AND distinct_n = 1) AS identical_patterns FROM shapes GROUP BY 1) USING (transaction_id)""",
    "crumbs", shaped=_SHAPED, shapes=_SHAPES))
def repeated_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.repeated_queries(views.breadcrumbs(spark, sf_dir, gathered=True)).select("transaction_id", "total_queries", "unique_patterns", "flagged_patterns", "identical_patterns")


@register("sql_normalize", query(f"SELECT transaction_id, pos, {oracle.normal_sql('sql')} AS normal FROM crumbs", "crumbs"))
def sql_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.sql_text import sql_normalize as normal

    return views.breadcrumbs(spark, sf_dir).select("transaction_id", "pos", normal(F.col("sql")).alias("normal"))


# Logs


@register("log_search", query("SELECT id, at_s FROM logs WHERE level = 4 AND contains(concat(' ', attrs_text, ' '), ' status 3 ') AND duration_ms >= 20 ORDER BY at_s DESC, id DESC LIMIT 200", "logs"))
def log_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = log_search.search_logs(views.logs(spark, sf_dir), "STATUS:3", wanted=log_search.LogFilter(level="error", min_duration_ms=20), limit=200)
    return found.select("id", F.unix_timestamp("timestamp").alias("at_s"))


@register("log_search_text", query("SELECT id FROM logs WHERE environment = 'en' AND regexp_matches(lower(body), '(^|[^a-z0-9])the([^a-z0-9]|$)') AND regexp_matches(lower(body), '(^|[^a-z0-9])and([^a-z0-9]|$)') ORDER BY at_s DESC, id DESC LIMIT 200", "logs"))
def log_search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_search.search_logs(views.logs(spark, sf_dir), "the And", wanted=log_search.LogFilter(environment="en"), limit=200).select("id")


@register("log_level_counts", query("SELECT service, level, count(*) AS count, ['trace', 'debug', 'info', 'warn', 'error', 'fatal'][level + 1] AS level_name FROM logs GROUP BY ALL", "logs"))
def log_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_search.level_counts(views.logs(spark, sf_dir), "service")


@register("attrs_text", query("SELECT id, concat('status ', CAST(id % 7 AS VARCHAR), ' ratio', ' trace 0123456789ab4def8123456789abcdef') AS attrs_text FROM logs", "logs"))
def attrs_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    attributes = F.create_map(F.lit("status"), (F.col("id") % 7).cast("string"), F.lit("ratio"), F.lit("0.25"), F.lit(" "), F.lit("x"), F.lit("trace"), F.lit("01234567-89ab-4def-8123-456789abcdef"))
    return views.logs(spark, sf_dir).select("id", log_text.attrs_text(attributes).alias("attrs_text"))


# Retention, monitors


@register("retention_survivors", query("SELECT transaction_id, sequence FROM spans WHERE transaction_id NOT IN (SELECT transaction_id FROM spans GROUP BY 1 HAVING min(root_ts) < (SELECT max(root_ts) - INTERVAL 90 DAY FROM spans))", "spans"))
def retention_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that stay when the transactions older than ninety days go."""
    rows = views.spans(spark, sf_dir)
    newest = rows.agg(F.max("root_ts").alias("t")).first()["t"]
    if newest is None:
        return rows.select("transaction_id", "sequence")
    return retention.cascade(rows, retention.retired(rows, newest, "transactions", "root_ts")).select("transaction_id", "sequence")


_DUE = "to_seconds(n * unit)"


@register("monitor_verdicts", query(
    f"""SELECT slug, missed, last_event = 'error' AS error, last_event = 'view' AND as_of > last_at + INTERVAL 30 MINUTE AS overrun,
    CASE WHEN missed THEN 'missed' WHEN last_event = 'error' THEN 'error' WHEN last_event = 'view' AND as_of > last_at + INTERVAL 30 MINUTE THEN 'overrun' ELSE 'ok' END AS next_state
    FROM (SELECT *, as_of > last_at + {_DUE} + to_seconds(margin) AS missed FROM monitors, span_of_time)""", "monitors", "span_of_time"))  # fmt: skip
def monitor_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = monitors.verdicts(views.monitors(spark, sf_dir), views.as_of(spark, sf_dir))
    has = lambda kind: F.array_contains("failures", kind).alias(kind)
    return judged.select("slug", has("missed"), has("error"), has("overrun"), "next_state")


_HELD = "CASE (monitor_id + place) % 4 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 2 END"


@register("monitor_issues", query(
    f"""SELECT project_id, concat('monitor:', slug, ':', kind) AS fingerprint, CASE WHEN fails THEN 0 ELSE 1 END AS status FROM (
    SELECT *, {_HELD} AS held, bool_or(fails) OVER (PARTITION BY monitor_id) AS failing FROM (
    SELECT *, unnest([0, 1, 2]) AS place, unnest(['missed', 'error', 'overrun']) AS kind, unnest([missed, last_event = 'error', last_event = 'view' AND as_of > last_at + INTERVAL 30 MINUTE]) AS fails
    FROM (SELECT *, as_of > last_at + {_DUE} + to_seconds(margin) AS missed FROM monitors, span_of_time)))
    WHERE (fails AND (held IS NULL OR held = 1)) OR (NOT failing AND monitor_id % 3 < 2 AND held = 0)""", "monitors", "span_of_time"))  # fmt: skip
def monitor_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues are held open, resolved, ignored or not at all, and two in three monitors failed when they were last judged."""
    as_of, m = views.as_of(spark, sf_dir), views.monitors(spark, sf_dir)
    m = m.withColumn("state", F.when(F.col("monitor_id") % 3 == 0, "missed").when(F.col("monitor_id") % 3 == 1, "error").otherwise("ok"))
    kinds = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("kind")) for i, k in enumerate(monitors.FAILURES)]))
    held = (F.col("monitor_id") + F.col("k.place")) % 4
    stored = m.select("project_id", "slug", "monitor_id", kinds.alias("k")).filter(held > 0).select("project_id", F.concat(F.lit("monitor:"), "slug", F.lit(":"), "k.kind").alias("fingerprint"), (held - 1).cast("int").alias("status"))
    return monitors.issue_transitions(monitors.verdicts(m, as_of), stored, as_of).select("project_id", "fingerprint", "status")


# Ingest


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.route(envelope.parse_envelopes(views.envelopes(spark, sf_dir)))


_SINKS = """SELECT sink, error, count(*) AS count FROM (
  SELECT 'dropped' AS sink, true AS error FROM events WHERE event_id % 37 = 0
  UNION ALL SELECT CASE WHEN event_id % 31 = 0 THEN 'dropped' ELSE 'transactions' END, false FROM events WHERE event_id % 37 <> 0
  UNION ALL SELECT 'events', false FROM events WHERE event_id % 37 <> 0 AND event_id % 4 = 0
  UNION ALL SELECT 'dropped', false FROM events WHERE event_id % 37 <> 0 AND event_id % 5 = 0) GROUP BY 1, 2"""


@register("envelope_routing", _SINKS)
def envelope_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).groupBy("sink", F.col("error").isNotNull().alias("error")).agg(F.count("*").alias("count"))


#: What the breadcrumbs and spans of the envelopes' transactions come to.
_ANALYSED = """SELECT t.* REPLACE (
      CASE WHEN id % 10 = 2 THEN CASE WHEN id % 7 > 0 THEN CAST(id % 7 * 250 AS INTEGER) END ELSE db_time END AS db_time, CASE WHEN id % 10 = 2 THEN 125 ELSE view_time END AS view_time,
      CAST(id % 7 + CASE WHEN id % 3 = 0 THEN 5 ELSE 0 END AS INTEGER) AS query_count, id % 7 > 3 OR id % 3 = 0 AS has_n_plus_one,
      CASE WHEN id % 2 = 0 AND id % 7 > 3 OR id % 6 = 0 THEN CAST(CASE WHEN id % 2 = 0 AND id % 7 > 3 THEN id % 7 * 250 ELSE 0 END + CASE WHEN id % 6 = 0 THEN 500 ELSE 0 END AS INTEGER) END AS n_plus_one_time,
      timestamp + to_milliseconds(duration) AS timestamp) FROM txn t WHERE id % 37 <> 0 AND id % 31 <> 0"""


@register("ingest_transactions", query("SELECT transaction_id, transaction_name, environment, release, trace_id, http_status, duration, db_time, view_time, query_count, has_n_plus_one, n_plus_one_time FROM analysed", "txn", analysed=_ANALYSED))
def ingest_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.with_query_analysis(payloads.transaction_rows(_routed(spark, sf_dir).filter("sink = 'transactions'")))
    return rows.select("transaction_id", "transaction_name", "environment", "release", "trace_id", "http_status", "duration", "db_time", "view_time", "query_count", "has_n_plus_one", "n_plus_one_time")


@register("ingest_events", query(
    """SELECT concat('e', transaction_id) AS event_id, transaction_name AS exception_type, concat('value ', CAST(id % 9 AS VARCHAR)) AS exception_value, environment,
    concat(transaction_name, '::f', CAST(id % 7 AS VARCHAR), '.rb::', CAST(id % 3 AS VARCHAR)) AS fingerprint, 'error' AS level FROM txn WHERE id % 37 <> 0 AND id % 4 = 0""", "txn"))  # fmt: skip
def ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.event_rows(_routed(spark, sf_dir).filter("sink = 'events'"))
    return rows.select("event_id", "exception_type", "exception_value", "environment", "fingerprint", "level")


@register("ingest_logs", query(f"SELECT trace_id, at_s, level, md5(coalesce(body, '')) AS body_md5, service, environment, duration_ms FROM logs", "logs"))
def ingest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.name_services(payloads.log_rows(views.log_items(spark, sf_dir)), views.projects(spark))
    return rows.select("trace_id", F.unix_timestamp("timestamp").alias("at_s"), "level", F.md5("body").alias("body_md5"), "service", "environment", "duration_ms")


@register("ingest_otlp_logs", query("SELECT md5(trace_id) AS trace_id, at_s, level, md5(coalesce(body, '')) AS body_md5, service, environment, 'scope' AS logger_name, duration_ms FROM logs", "logs"))
def ingest_otlp_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = payloads.otlp_rows(views.otlp_items(spark, sf_dir))
    return rows.select("trace_id", F.unix_timestamp("timestamp").alias("at_s"), "level", F.md5("body").alias("body_md5"), "service", "environment", "logger_name", "duration_ms")


@register("insert_if_absent", query("SELECT transaction_id, duration FROM txn", "txn"))
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows are stored; all of them arrive again, twice, with other values: what is there stays."""
    t = views.transactions(spark, sf_dir)
    stored = t.filter("id % 2 = 0")
    again = t.withColumn("duration", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("duration")))
    return stored.unionByName(sinks.new_rows(again.unionByName(again), stored, ["project_id", "transaction_id"])).select("transaction_id", "duration")


# The other parts register theirs where they stand.
from . import catalogue_ingest, catalogue_streams, catalogue_texts  # noqa: E402, F401
