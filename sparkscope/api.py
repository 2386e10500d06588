"""The query surface (§2.13): one method for each tool, each a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import scalars
from .operators import analytics, issues, log_search, monitors, retention, rollup, series, spans, traces
from .operators.filters import Scope, SlowFilter, inclusive
from .plans.window import TimeWindow, bucketing_for, resolve_window
from .sources.payloads import display_attributes, event_details


class ProjectError(ValueError):
    """A project that can't be told: blank, unknown, or a name that several have."""


@dataclass
class Tables:
    """What the engine reads. Rollups, issues (without status) and their facets are rebuilt from raw rows where none are given;
    ``Ingest`` stores them."""

    transactions: DataFrame
    events: DataFrame
    logs: DataFrame
    projects: DataFrame
    spans: DataFrame | None = None
    monitors: DataFrame | None = None
    changes: DataFrame | None = None
    hourly: DataFrame | None = None
    histogram: DataFrame | None = None
    issues: DataFrame | None = None
    issue_facets: DataFrame | None = None


class Engine:
    def __init__(self, tables: Tables, as_of: datetime) -> None:
        self.tables, self.as_of = tables, as_of
        self.hourly = rollup.hourly_stats(tables.transactions) if tables.hourly is None else tables.hourly
        self.histogram = rollup.latency_histogram(tables.transactions) if tables.histogram is None else tables.histogram

    def project_id(self, project: str | int | None) -> int | None:
        """C14: by slug, then by name, both case folded, then by id; None is all projects."""
        if project is None:
            return None
        text = str(project).strip()
        if not text:
            raise ProjectError("the project is blank")
        rows = self.tables.projects.filter((F.lower("slug") == text.lower()) | (F.lower("name") == text.lower()) | (F.col("id").cast("string") == text)).select("id", "slug", "name").limit(100).collect()
        for found in ([r for r in rows if r["slug"].lower() == text.lower()], [r for r in rows if r["name"].lower() == text.lower()], rows):
            if len(found) > 1:
                raise ProjectError(f"{len(found)} projects are named {text!r}")
            if found:
                return found[0]["id"]
        raise ProjectError(f"no project {text!r}")

    def window(self, hours: float | None = None, start: datetime | None = None, end: datetime | None = None, stream: str = "histograms") -> TimeWindow:
        return resolve_window(self.as_of, hours, start, end, stream)

    def _scope(self, project: str | int | None, **more: str | None) -> Scope:
        return Scope(project_id=self.project_id(project), **more)

    def _issues(self) -> DataFrame:
        found = issues.group_issues(self.tables.events) if self.tables.issues is None else self.tables.issues
        return found.withColumn("status", F.lit(issues.OPEN)) if self.tables.changes is None else issues.current_status(found, self.tables.changes)

    def _named(self, rows: DataFrame) -> DataFrame:
        return traces.with_project(rows, self.tables.projects)

    def get_status(self) -> DataFrame:
        parts = [retention.data_span(rows).select(F.lit(name).alias("table"), "*") for name, rows in (("transactions", self.tables.transactions), ("events", self.tables.events), ("logs", self.tables.logs))]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def list_monitors(self, state: str = "all", project: str | int | None = None) -> DataFrame:
        rows = monitors.verdicts(self.tables.monitors, self.as_of)
        rows = rows if project is None else rows.filter(F.col("project_id") == self.project_id(project))
        return self._named(rows if state == "all" else rows.filter(F.col("next_state") == state)).orderBy("project_id", "slug")

    def list_recent_issues(self, status: str = "open", limit: int = 20, project: str | int | None = None, environment: str | None = None, release: str | None = None) -> DataFrame:
        return self.search_issues(None, status, limit, project, environment, release)

    def search_issues(self, query: str | None = None, status: str | None = None, limit: int = 20, project: str | int | None = None, environment: str | None = None, release: str | None = None) -> DataFrame:
        rows = self._issues()
        rows = rows if project is None else rows.filter(F.col("project_id") == self.project_id(project))
        wanted = {k: v for k, v in (("environment", environment), ("release", release)) if v}
        if wanted:
            rows = issues.seen_in(rows, issues.issue_facets(self.tables.events) if self.tables.issue_facets is None else self.tables.issue_facets, **wanted)
        return self._named(issues.search_issues(rows, query, status, limit))

    def get_issue(self, project_id: int, fingerprint: str) -> DataFrame:
        of = (F.col("project_id") == project_id) & (F.col("fingerprint") == fingerprint)
        last = self.tables.events.filter(of).groupBy("project_id", "fingerprint").agg(F.max_by("event_id", F.struct("timestamp", "id")).alias("last_event_id"))
        return self._issues().filter(of).join(last, ["project_id", "fingerprint"], "left")

    def get_issue_events(self, project_id: int, fingerprint: str, limit: int = 10) -> DataFrame:
        rows = self.tables.events.filter((F.col("project_id") == project_id) & (F.col("fingerprint") == fingerprint))
        return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(max(1, min(limit, 50)))

    def get_event(self, event_id: str) -> DataFrame:
        """The event with its trace's transaction, and what its payload tells where it is stored."""
        rows = traces.with_transaction(self.tables.events.filter(F.col("event_id") == event_id), self.tables.transactions)
        return rows.join(event_details(rows.select("project_id", "event_id", "payload")), ["project_id", "event_id"]) if "payload" in rows.columns else rows

    def get_transaction_stats(self, hours: float = 24, project: str | int | None = None, endpoint: str | None = None, environment: str | None = None, limit: int = 10) -> DataFrame:
        """One row: ``total_count`` with averages, percentiles and extremes, of one endpoint where it is named, and the ranking as
        ``top_endpoints``, which an endpoint never narrows. Both are of the same hours of the rollups."""
        window, scope = self.window(hours), self._scope(project, environment=environment)
        block = analytics.percentiles_block(self.hourly, self.histogram, self.tables.transactions, window, scope if endpoint is None else self._scope(project, name=endpoint, environment=environment))
        ranking = analytics.endpoint_impact(self.hourly, self.histogram, self.tables.transactions, window, scope, max(1, min(limit, 50)))
        # At most fifty structs, by time spent and name.
        top = ranking.agg(F.array_sort(F.collect_list(F.struct((-F.col("time_spent")).alias("place"), *ranking.columns))).alias("top_endpoints"))
        listed = top.select(F.transform("top_endpoints", lambda x: x.dropFields("place")).alias("top_endpoints"))
        return block.withColumnRenamed("count", "total_count").join(F.broadcast(listed), F.lit(True), "left")

    def find_n_plus_one_endpoints(self, hours: float = 24, project: str | int | None = None, limit: int = 20) -> DataFrame:
        return analytics.n_plus_one_worklist(self.hourly, self.window(hours), self._scope(project), max(1, min(limit, 100)))

    def get_endpoint_timeseries(self, endpoint: str, hours: float = 24, buckets: int = 24, project: str | int | None = None, release: str | None = None) -> DataFrame:
        window = self.window(hours)
        return series.endpoint_timeseries(self.histogram, self.hourly, self.tables.transactions, window, bucketing_for(window, max(4, min(buckets, 168))), self._scope(project, name=endpoint, release=release)).orderBy("bucket")

    def search_slow_transactions(self, hours: float = 24, min_duration: int = 1000, max_duration: int | None = None, tags: dict[str, str] | None = None, project: str | int | None = None, endpoint: str | None = None, environment: str | None = None, limit: int = 20) -> DataFrame:
        scope = self._scope(project, name_like=endpoint, environment=environment)
        return self._named(analytics.slow_transactions(self.tables.transactions, self.window(hours, stream="transactions"), scope, SlowFilter(min_duration, max_duration, tags or {}), limit))

    def get_transaction(self, transaction_id: str) -> DataFrame:
        """The request with its shares of time and how many events and logs its trace has."""
        rows = self.tables.transactions.filter(F.col("transaction_id") == transaction_id)
        d, db, view = F.col("duration"), F.col("db_time"), F.col("view_time")
        shared = rows.withColumns({"db_pct": scalars.share_pct(db, d), "view_pct": scalars.share_pct(view, d), "other_ms": scalars.other_time(d, db, view), "controller": scalars.controller_name(F.col("transaction_name")), "action": scalars.action_name(F.col("transaction_name"))})
        counted = traces.log_counts(traces.log_counts(shared, self.tables.events).withColumnRenamed("log_count", "event_count"), self.tables.logs)
        return counted.withColumn("query_params", scalars.query_params(F.col("http_url"))) if "http_url" in rows.columns else counted

    def get_transaction_events(self, transaction_id: str, limit: int = 10) -> DataFrame:
        return traces.events_of_transactions(self.tables.transactions.filter(F.col("transaction_id") == transaction_id), self.tables.events, limit)

    def get_transaction_spans(self, transaction_id: object, op: str | None = None, limit: int = 100) -> DataFrame:
        return spans.list_spans(self.tables.spans.filter(F.col("transaction_id") == transaction_id), op, limit)

    def get_transaction_span_ops(self, transaction_id: object) -> DataFrame:
        return spans.op_summary(self.tables.spans.filter(F.col("transaction_id") == transaction_id)).orderBy(F.desc("total_ms"), "op")

    def get_transaction_repeats(self, transaction_id: object, op: str | None = None) -> DataFrame:
        return spans.repeated_descriptions(self.tables.spans.filter(F.col("transaction_id") == transaction_id), op_prefix=op).orderBy(F.desc("count"), "description").limit(15)

    def get_endpoint_summary(self, endpoint: str, hours: float = 24, project: str | int | None = None, environment: str | None = None, release: str | None = None) -> DataFrame:
        """Averages and percentiles with the fastest and slowest request; one row."""
        window, scope = self.window(hours), self._scope(project, name=endpoint, environment=environment, release=release)
        block = analytics.release_block(self.tables.transactions, window, scope) if release else analytics.percentiles_block(self.hourly, self.histogram, self.tables.transactions, window, scope)
        extremes = analytics.extreme_requests(scope.apply(self.tables.transactions), window, "transaction_name")
        return block.withColumn("transaction_name", F.lit(endpoint)).join(extremes, "transaction_name", "left")

    def get_transactions_by_endpoint(self, endpoint: str, hours: float = 24, limit: int = 20, project: str | int | None = None, status: str | None = None, method: str | None = None) -> DataFrame:
        scope = self._scope(project, name=endpoint, status=status, method=method)
        return analytics.recent_transactions(self.tables.transactions, self.window(hours, stream="transactions"), scope, limit)

    def compare_endpoint_performance(self, endpoint: str, before: TimeWindow, after: TimeWindow, project: str | int | None = None) -> DataFrame:
        return analytics.compare_windows(self._scope(project, name=endpoint).apply(self.tables.transactions), before, after, "transaction_name")

    def _change(self, project_id: int, fingerprint: str, status: int) -> DataFrame:
        """The change to append to the log of changes."""
        spark = self.tables.events.sparkSession
        return spark.createDataFrame([(project_id, fingerprint, self.as_of, status)], "project_id int, fingerprint string, changed_at timestamp, status int")

    def resolve_issue(self, project_id: int, fingerprint: str) -> DataFrame:
        return self._change(project_id, fingerprint, issues.RESOLVED)

    def ignore_issue(self, project_id: int, fingerprint: str) -> DataFrame:
        return self._change(project_id, fingerprint, issues.IGNORED)

    def reopen_issue(self, project_id: int, fingerprint: str) -> DataFrame:
        return self._change(project_id, fingerprint, issues.OPEN)

    def search_logs(self, query: str | None = None, hours: float = 24, limit: int = 50, project: str | int | None = None, **wanted: object) -> DataFrame:
        found = log_search.search_logs(self.tables.logs, query, self.window(hours, stream="logs"), log_search.LogFilter(project_id=self.project_id(project), **wanted), limit)
        return self._named(found)

    def get_log(self, log_id: object) -> DataFrame:
        """The log, with its attributes as a flat map where its payload is stored."""
        rows = self.tables.logs.filter(F.col("id") == log_id)
        return rows.withColumn("attributes", display_attributes(F.col("payload"))) if "payload" in rows.columns else rows

    def get_trace_logs(self, trace_id: str, limit: int = 100, project: str | int | None = None) -> DataFrame:
        return traces.trace_logs(self.tables.logs, trace_id, self.project_id(project), limit)

    def project_overview(self, project: str | int, hours: float = 24, buckets: int = 24) -> DataFrame:
        """The dashboard's series: requests and their mean time for each bucket, and the project's events there."""
        window, scope = self.window(hours), self._scope(project)
        grid = bucketing_for(window, buckets)
        requests = series.global_timeseries(self.histogram, self.hourly, self.tables.transactions, window, grid, scope)
        failed = self.tables.events.filter((F.col("project_id") == scope.project_id) & inclusive(window)).groupBy(series.time_bucket(F.col("timestamp"), grid).alias("bucket")).agg(F.count("*").alias("events"))
        return requests.join(failed, "bucket", "left").na.fill({"events": 0}).orderBy("bucket")

    def project_index(self) -> DataFrame:
        """Each project's open issues, their newest sighting, and its newest request."""
        found = self._issues().filter(F.col("status") == issues.OPEN).groupBy("project_id").agg(F.count("*").alias("open_issues"), F.max("last_seen").alias("last_seen"))
        newest = self.tables.transactions.groupBy("project_id").agg(F.max("timestamp").alias("last_transaction_at"))
        rows = self.tables.projects.select(F.col("id").alias("project_id"), "slug", "name").join(found, "project_id", "left").join(newest, "project_id", "left")
        return rows.na.fill({"open_issues": 0}).orderBy("project_id")
