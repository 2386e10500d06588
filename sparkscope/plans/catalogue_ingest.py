"""Registered queries over what is ingested: rollups of ingested rows, streams, chunks, check-ins, retirement, exports."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, issues, log_index, log_search, monitors, retention, rollup, traces
from ..sources import envelope, payloads, sinks, views
from ..streaming import keys
from ..streaming.ingest import Ingest
from .catalogue import _ANALYSED, _routed, register, sec
from .oracle import VIEWS, query
from .window import expired

_HOURLY = VIEWS["hourly"].replace("FROM txn", "FROM analysed")


@register("ingest_rollup", query(f"SELECT * REPLACE ({sec('hour_bucket')} AS hour_bucket) FROM hourly", "txn", analysed=_ANALYSED, hourly=_HOURLY))
def ingest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of what envelopes bring, with the query analysis of their breadcrumbs and spans."""
    rows = payloads.with_query_analysis(payloads.transaction_rows(_routed(spark, sf_dir).filter("sink = 'transactions'")))
    return rollup.hourly_stats(rows).withColumn("hour_bucket", F.unix_timestamp("hour_bucket"))


@register("ingest_stream", query(f"SELECT * REPLACE ({sec('hour_bucket')} AS hour_bucket) FROM hourly", "txn", analysed=_ANALYSED, hourly=_HOURLY))
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is delivered twice counts once in the partials. Two batches of envelopes, the second with a part of the first delivered again, and a compaction between them."""
    pipeline, source = Ingest(spark, f"{sinks.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"), views.envelopes(spark, sf_dir)
    early = F.col("received_at") < F.lit(views.as_of(spark, sf_dir) - timedelta(days=15))
    pipeline.process(source.filter(early), 0)
    pipeline.compact(0)
    pipeline.process(source.filter(~early | (F.second("received_at") < 30)), 1)
    return pipeline.hourly().withColumn("hour_bucket", F.unix_timestamp("hour_bucket"))


@register("ingest_recount", query(
    f"""SELECT project_id, transaction_name, environment, {sec('hour_bucket')} AS hour_bucket, bucket_index, count(*) AS count FROM
    (SELECT *, coalesce(environment, '') AS env, date_trunc('hour', timestamp) AS hour_bucket, CAST(floor(ln(greatest(duration, 1)) / ln(1.02)) AS INTEGER) AS bucket_index FROM analysed) GROUP BY project_id, transaction_name, environment, hour_bucket, bucket_index""",
    "txn", analysed="SELECT * REPLACE (coalesce(environment, '') AS environment) FROM (" + _ANALYSED + ")"))
def ingest_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hour of the ingested requests is counted anew; what was right stays right."""
    pipeline = Ingest(spark, f"{sinks.shared_folder(spark)}/ingest-{uuid.uuid4().hex}")
    pipeline.process(views.envelopes(spark, sf_dir), 0)
    newest = pipeline.read("transactions").agg(F.max(F.date_trunc("hour", "timestamp")).alias("h")).first()["h"]
    histogram = pipeline.histogram() if newest is None else pipeline.recounted(newest)[1]
    return histogram.withColumn("hour_bucket", F.unix_timestamp("hour_bucket"))


#: Stores that queries of one session only read, by session and tables.
_STORES: dict[tuple[str, str], Ingest] = {}


def _stored(spark: SparkSession, sf_dir: str) -> Ingest:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORES:
        _STORES[key] = _delivered_twice(spark, sf_dir)
    return _STORES[key]


def _delivered_twice(spark: SparkSession, sf_dir: str) -> Ingest:
    """Two batches of envelopes with logs among them, a compaction between them, and in the second a part of the first again."""
    pipeline, logs = Ingest(spark, f"{sinks.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"), views.log_items(spark, sf_dir)
    body = F.concat_ws("\n", F.lit("{}"), F.lit('{"type":"log"}'), "payload")
    early = F.col("received_at") < F.lit(views.as_of(spark, sf_dir) - timedelta(days=15))
    source = views.envelopes(spark, sf_dir)
    pipeline.process(source.filter(early).unionByName(logs.select("project_id", "received_at", body.alias("body"))), 0)
    pipeline.compact(0)
    pipeline.vacuum()
    pipeline.process(source.filter(~early | (F.second("received_at") < 30)), 1)
    return pipeline


_THROWN = f"""SELECT project_id, concat(transaction_name, '::f', CAST(id % 7 AS VARCHAR), '.rb::', CAST(id % 3 AS VARCHAR)) AS fingerprint, {sec('timestamp')} AS at_s, timestamp, concat('e', transaction_id) AS event_id,
  concat('value ', CAST(id % 9 AS VARCHAR)) AS title, transaction_name AS exception_type, environment, release FROM txn WHERE id % 37 <> 0 AND id % 4 = 0"""


@register("ingest_issues", query(
    """SELECT project_id, fingerprint, count(*) AS count, min(at_s) AS first_seen, max(at_s) AS last_seen, arg_min(title, (timestamp, event_id)) AS title, arg_min(exception_type, (timestamp, event_id)) AS exception_type
    FROM thrown GROUP BY ALL""", "txn", thrown=_THROWN))  # fmt: skip
def ingest_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E25 at ingest: stored issues after a compaction and a redelivery."""
    return _stored(spark, sf_dir).issues().withColumns({c: F.unix_timestamp(c) for c in ("first_seen", "last_seen")})


@register("ingest_facets", query(
    f"""SELECT stream, project_id, name, value, max(at_s) AS last_seen_at FROM (
      SELECT 'transactions' AS stream, project_id, 'environment' AS name, environment AS value, {sec('timestamp')} AS at_s FROM analysed UNION ALL
      SELECT 'logs', 0, 'environment', environment, at_s FROM logs UNION ALL SELECT 'logs', 0, 'service', service, at_s FROM logs UNION ALL SELECT 'logs', 0, 'source', 'sentry', at_s FROM logs UNION ALL
      SELECT concat('issue ', fingerprint), project_id, 'environment', environment, at_s FROM thrown UNION ALL SELECT concat('issue ', fingerprint), project_id, 'release', release, at_s FROM thrown)
    WHERE trim(value) <> '' GROUP BY ALL""", "txn", "logs", analysed=_ANALYSED, thrown=_THROWN))  # fmt: skip
def ingest_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B7, B8 at ingest: stored facets of requests, logs and issues after a compaction and a redelivery."""
    pipeline = _stored(spark, sf_dir)
    of_issues = pipeline.partial("issue_facets").select(F.concat(F.lit("issue "), "fingerprint").alias("stream"), "project_id", "name", "value", "last_seen_at")
    # An issue's releases and environments may be shared by issues of one fingerprint in several projects, which the key tells apart.
    return pipeline.facets().select(*of_issues.columns).unionByName(of_issues).withColumn("last_seen_at", F.unix_timestamp("last_seen_at"))


@register("ingest_releases", query(
    f"SELECT project_id, release AS version, {sec('min(timestamp)')} AS first_seen_at, {sec('max(timestamp)')} AS last_seen_at, count(*) AS transaction_count FROM analysed GROUP BY ALL", "txn", analysed=_ANALYSED))
def ingest_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B9 at ingest: stored sightings after a compaction and a redelivery."""
    return _stored(spark, sf_dir).partial("releases").withColumns({c: F.unix_timestamp(c) for c in ("first_seen_at", "last_seen_at")})


@register("retention_at_rest", query(
    f"""SELECT 'transactions' AS kind, CAST(project_id AS VARCHAR) AS name, count(*) AS rows FROM analysed, days WHERE CAST(timestamp AS DATE) >= t GROUP BY ALL
    UNION ALL SELECT 'spans', CAST(project_id AS VARCHAR), sum(id % 7 + (id % 6 = 0)::INTEGER + 1) FROM analysed, days WHERE CAST(timestamp AS DATE) >= s AND id % 2 = 0 GROUP BY ALL
    UNION ALL SELECT 'issue', concat(CAST(project_id AS VARCHAR), ' ', fingerprint), count(*) FILTER (CAST(timestamp AS DATE) >= e) FROM thrown, days GROUP BY ALL
    UNION ALL SELECT 'facet', concat(CAST(project_id AS VARCHAR), ' ', fingerprint, ' ', environment), 1 FROM thrown, days WHERE environment IS NOT NULL GROUP BY project_id, fingerprint, environment, e HAVING CAST(max(timestamp) AS DATE) >= e
    UNION ALL SELECT 'hourly', CAST(project_id AS VARCHAR), count(*) FROM analysed, days WHERE CAST(timestamp AS DATE) >= h GROUP BY ALL""",
    "txn", "span_of_time", analysed=_ANALYSED, thrown=_THROWN,
    days="SELECT CAST(as_of - INTERVAL 9 DAY AS DATE) AS t, CAST(as_of - INTERVAL 5 DAY AS DATE) AS s, CAST(as_of - INTERVAL 12 DAY AS DATE) AS e, CAST(as_of - INTERVAL 15 DAY AS DATE) AS h FROM span_of_time"))
def retention_at_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two retirements, the second by shorter clocks, with a compaction between, and the removal of files after each."""
    pipeline, as_of = _delivered_twice(spark, sf_dir), views.as_of(spark, sf_dir)
    pipeline.retire(as_of, 0, {"transactions": 11, "spans": 10, "events": 14, "histograms": 15})
    pipeline.vacuum()
    pipeline.compact(1)
    pipeline.vacuum()
    pipeline.retire(as_of, 1, {"transactions": 9, "spans": 5, "events": 12, "histograms": 15})
    pipeline.vacuum()
    t, name = pipeline.read("transactions"), F.col("project_id").cast("string")
    total = lambda kind, rows, label, n: rows.groupBy(F.lit(kind).alias("kind"), label.alias("name")).agg(n.alias("rows"))
    seen = F.concat_ws(" ", name, "fingerprint", "value")
    parts = [
        total("transactions", t, name, F.count("*")), total("spans", t.filter(F.size("spans") > 0), name, F.sum(F.size("spans")).cast("long")), total("issue", pipeline.issues(), F.concat_ws(" ", name, "fingerprint"), F.sum("count")),
        total("facet", pipeline.partial("issue_facets").filter("name = 'environment'"), seen, F.count("*")), total("hourly", pipeline.hourly(), name, F.sum("count"))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@register("keys_among_stored", query("SELECT transaction_id, id % 3 = 0 AS stored FROM txn", "txn"))
def keys_among_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keys three parts of a key table hold, by way of their filters."""
    folder, wanted = f"{sinks.shared_folder(spark)}/keys-{uuid.uuid4().hex}", ["project_id", "transaction_id"]
    t = views.transactions(spark, sf_dir).select("id", *wanted)
    parts = {f"part_{k}": f"{folder}/{k}" for k in range(3)}
    for k, path in enumerate(parts.values()):
        keys.write(t.filter((F.col("id") % 3 == 0) & (F.col("id") % 9 == 3 * k)), wanted, path)
    held, _ = keys.stored_among(t, wanted, parts)
    return t.join(held.select(*wanted, F.lit(True).alias("stored")), wanted, "left").select("transaction_id", F.coalesce("stored", F.lit(False)).alias("stored"))


@register("otlp_chunking", query(
    """SELECT count(*) AS records, count(DISTINCT (id // 100, service, environment)) AS chunks, count(*) AS small_chunks, count(*) AS rejected, 0 AS rejected_whole FROM logs""", "logs"))  # fmt: skip
def otlp_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads cut by a limit that nothing reaches and by one that every record exceeds."""
    items = views.otlp_items(spark, sf_dir)
    count = lambda limit: envelope.otlp_chunk_rows(items, limit).agg(F.sum("record_count").alias("records"), F.count("*").alias("chunks"), F.count_if("rejected").alias("rejected"))
    whole, cut = count(1 << 30), count(10)
    return whole.select("records", "chunks", F.col("rejected").alias("rejected_whole")).join(cut.select(F.col("chunks").alias("small_chunks"), "rejected"), F.lit(True))


def _check_ins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a check-in of its user's job: views start it, clicks end it well, errors badly; other types are none."""
    status = F.create_map(*[F.lit(x) for x in ("view", "in_progress", "click", "ok", "error", "error")])
    event, user = F.col("event_id"), F.col("user_id")
    config = F.when(event % 5 == 0, F.struct(F.struct(F.lit("interval").alias("type"), (event % 4 + 1).alias("value"), F.lit("hour").alias("unit")).alias("schedule"), (event % 10).alias("checkin_margin"), F.lit(30).alias("max_runtime")))
    payload = F.to_json(F.struct(F.concat(F.lit(" job-"), user.cast("string")).alias("monitor_slug"), F.coalesce(F.try_element_at(status, "event_type"), F.col("event_type")).alias("status"), F.when(event % 3 == 0, (event % 100).cast("double")).alias("duration"), F.when(event % 2 == 0, "production").alias("environment"), config.alias("monitor_config")))
    items = views.table(spark, sf_dir, "events").select((user % 5).cast("int").alias("project_id"), F.col("ts").cast("timestamp").alias("received_at"), event.cast("int").alias("item_index"), payload.alias("payload"))
    return payloads.check_in_rows(items)


@register("check_in_fold", query(
    f"""SELECT project_id, slug, arg_max(status, o) AS last_status, {sec('max(ts)')} AS last_checkin_at, {sec("max(ts) FILTER (status = 'ok')")} AS last_ok_at, CASE WHEN arg_max(status, o) = 'in_progress' THEN {sec('max(ts)')} END AS in_progress_since,
    arg_max(CAST(event_id % 100 AS DOUBLE), o) FILTER (event_id % 3 = 0 AND status <> 'in_progress') AS last_duration, arg_max('production', o) FILTER (event_id % 2 = 0) AS environment,
    arg_max(CAST(event_id % 4 + 1 AS VARCHAR), o) FILTER (event_id % 5 = 0) AS schedule_value, CAST(arg_max(event_id % 10, o) FILTER (event_id % 5 = 0) AS INTEGER) AS checkin_margin FROM checked GROUP BY 1, 2""",
    checked="""SELECT CAST(user_id % 5 AS INTEGER) AS project_id, concat('job-', CAST(user_id AS VARCHAR)) AS slug, event_id, ts, (ts, event_id) AS o,
    CASE event_type WHEN 'view' THEN 'in_progress' WHEN 'click' THEN 'ok' WHEN 'error' THEN 'error' END AS status FROM events WHERE event_type IN ('view', 'click', 'error')"""))  # fmt: skip
def check_in_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12."""
    found = monitors.fold_check_ins(_check_ins(spark, sf_dir))
    times = {c: F.unix_timestamp(c) for c in ("last_checkin_at", "last_ok_at", "in_progress_since")}
    return found.select("project_id", "slug", "last_status", "last_checkin_at", "last_ok_at", "in_progress_since", "last_duration", "environment", "schedule_value", "checkin_margin").withColumns(times)


@register("monitor_crontabs", query(
    f"""SELECT slug, {sec('due')} AS next_expected_at, as_of > due + to_seconds(margin) AS missed FROM (SELECT slug, margin, CASE n % 3 WHEN 0 THEN date_trunc('hour', last_at) + INTERVAL 1 HOUR WHEN 1 THEN date_trunc('day', last_at) + INTERVAL 1 DAY
    ELSE time_bucket(INTERVAL 15 MINUTE, last_at) + INTERVAL 15 MINUTE END AS due FROM monitors), span_of_time""", "monitors", "span_of_time"))  # fmt: skip
def monitor_crontabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly, daily and quarter-hourly crontabs."""
    n = F.col("schedule_value").cast("int") % 3
    crontab = F.when(n == 0, "0 * * * *").when(n == 1, "@daily").otherwise("*/15 * * * *")
    judged = monitors.verdicts(views.monitors(spark, sf_dir).withColumn("schedule_value", crontab).withColumn("schedule_type", F.lit("crontab")), views.as_of(spark, sf_dir))
    return judged.select("slug", F.unix_timestamp("next_expected_at").alias("next_expected_at"), F.array_contains("failures", "missed").alias("missed"))


@register("insert_events", query("SELECT event_id, exception_type FROM err", "err"))
def insert_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2: events that are stored stay as they are when they come again."""
    e = views.errors(spark, sf_dir)
    stored = e.filter("id % 3 = 0")
    again = e.withColumn("exception_type", F.when(F.col("id") % 3 == 0, "other").otherwise(F.col("exception_type")))
    return stored.unionByName(sinks.new_rows(again.unionByName(again), stored, ["project_id", "event_id"])).select("event_id", "exception_type")


@register("facet_retirement", query(
    """SELECT stream, project_id, value FROM (
      SELECT 'transactions' AS stream, project_id, http_status AS value, max(timestamp) AS seen FROM txn GROUP BY ALL UNION ALL SELECT 'logs', project_id, trace_id, max(timestamp) FROM txn GROUP BY ALL UNION ALL SELECT 'events', project_id, value, last_seen_at FROM issue_facets), span_of_time
    WHERE seen >= as_of - CASE stream WHEN 'transactions' THEN INTERVAL 90 DAY WHEN 'logs' THEN INTERVAL 14 DAY ELSE INTERVAL 30 DAY END""", "txn", "issue_facets", "span_of_time"))  # fmt: skip
def facet_retirement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets of requests, of logs (here the requests' traces) and of issues retire by their own streams' clocks."""
    t, as_of = views.transactions(spark, sf_dir), views.as_of(spark, sf_dir)
    parts = {"transactions": issues.facets(t, "transactions", ["http_status"]), "logs": issues.facets(t, "logs", ["trace_id"]), "events": issues.issue_facets(views.errors(spark, sf_dir))}
    kept = [retention.survivors(f, as_of, stream, "last_seen_at").select(F.lit(stream).alias("stream"), "project_id", "value") for stream, f in parts.items()]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


_LINE = lambda *cells: "array_to_string([" + ", ".join(f"CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END" for c in cells) + "], ',')"
_HEADINGS = "'" + ",".join(sinks.EXPORT_HEADINGS) + "'"
_CELL = lambda c: f"coalesce(CAST({c} AS VARCHAR), '')"
_SHARE = lambda c: f"CAST(CASE WHEN duration > 0 AND {c} IS NOT NULL THEN round({c} / duration * 100, 2) ELSE 0.0 END AS DOUBLE)"


@register("transaction_export", query(
    f"""SELECT transaction_id, line, csv FROM (SELECT transaction_id, CAST(0 AS INTEGER) AS line, {_HEADINGS} AS csv FROM analysed
    UNION ALL SELECT transaction_id, 1, {_LINE(*map(_CELL, ("transaction_id", "timestamp", "transaction_name", "'http.server'", "duration", "db_time", "view_time", "environment", "release", "''", "''", "http_status", "''", "query_count", "(id % 7 > 0)::INTEGER + (id % 3 = 0)::INTEGER", "(id % 7 > 3)::INTEGER + (id % 3 = 0)::INTEGER", _SHARE("db_time"), _SHARE("view_time"), "greatest(duration - coalesce(db_time, 0) - coalesce(view_time, 0), 0)", "''", "''", "timestamp")))} FROM analysed
    UNION ALL SELECT transaction_id, CAST(2 + unnest(range(len(more))) AS INTEGER), unnest(more) FROM (SELECT *, CASE WHEN query_count > 0 THEN list_concat(['', 'Query Patterns Details', 'Pattern,Count,Example Query'],
      CASE WHEN id % 7 > 0 THEN [concat('SELECT * FROM parts WHERE id = ?,', CAST(id % 7 AS VARCHAR), ',SELECT * FROM parts WHERE id = ', CAST(id + 1 AS VARCHAR))] ELSE [] END, CASE WHEN id % 3 = 0 THEN ['SELECT name FROM users WHERE name = ?,5,SELECT name FROM users WHERE name = ''x'''] ELSE [] END,
      CASE WHEN has_n_plus_one THEN ['', 'N+1 Query Warnings', 'Pattern'] ELSE [] END, CASE WHEN id % 7 > 3 THEN ['SELECT * FROM parts WHERE id = ?'] ELSE [] END, CASE WHEN id % 3 = 0 THEN ['SELECT name FROM users WHERE name = ?'] ELSE [] END) ELSE [] END AS more FROM analysed))""",
    "txn", analysed=f"SELECT * REPLACE (date_trunc('minute', timestamp) AS timestamp) FROM ({_ANALYSED})"))
def transaction_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of every ingested request, section by section."""
    rows = payloads.transaction_rows(_routed(spark, sf_dir).filter("sink = 'transactions'"))
    # Times of payloads are floating point: to the minute they are the same on every engine.
    lines = sinks.export_sections(payloads.with_query_analysis(rows).withColumn("timestamp", F.date_trunc("minute", "timestamp")))
    return lines.select("transaction_id", "line", sinks.csv_line(F.col("cells")).alias("csv"))


@register("recent_scopes", query(
    """SELECT scope, environment, count(*) AS count FROM (SELECT 'last_hour' AS scope, environment FROM txn, span_of_time WHERE timestamp > as_of - INTERVAL 1 HOUR UNION ALL SELECT 'last_24_hours', environment FROM txn, span_of_time WHERE timestamp > as_of - INTERVAL 24 HOUR
    UNION ALL SELECT 'last_7_days', environment FROM txn, span_of_time WHERE timestamp > as_of - INTERVAL 168 HOUR) GROUP BY ALL""", "txn", "span_of_time"))  # fmt: skip
def recent_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10."""
    t, as_of = views.transactions(spark, sf_dir), views.as_of(spark, sf_dir)
    parts = [analytics.recent(t, as_of, name).groupBy(F.lit(name).alias("scope"), "environment").agg(F.count("*").alias("count")) for name in analytics.RECENT_HOURS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("rows_by_value", query("SELECT id FROM txn WHERE environment IS NULL AND http_status = '404' AND transaction_name = 'view'", "txn"))
def rows_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of one endpoint, status and no environment."""
    return analytics.by(views.transactions(spark, sf_dir), environment=None, http_status="404", transaction_name="view").select("id")


@register("project_resolution", query(
    "SELECT transaction_id, CASE WHEN id % 7 < 5 THEN project_id END AS project_id FROM txn", "txn"))
def project_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: each request's project by its slug, its name or its id, as someone may write them; some name none."""
    n, t = F.col("project_id").cast("string"), views.transactions(spark, sf_dir)
    k = F.col("id") % 7
    asked = F.when(k == 0, F.concat(F.lit(" PROJECT-"), n)).when(k == 1, F.concat(F.lit("project "), n)).when(k == 2, n).when(k < 5, F.concat(F.lit("Project-"), n)).when(k == 5, " ")
    rows = t.select("transaction_id", F.when(k == 6, F.concat(F.lit("other-"), n)).otherwise(asked).alias("asked"))
    return traces.resolve_projects(rows, views.projects(spark)).select("transaction_id", "project_id")


@register("raw_expiry", query(
    "SELECT id, begun_at < as_of - INTERVAL 90 DAY AS expired, begun_at < as_of - INTERVAL 14 DAY AS logs_expired FROM (SELECT id, timestamp - to_days(CAST(id % 120 AS INTEGER)) AS begun_at FROM txn), span_of_time", "txn", "span_of_time"))
def raw_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: whether a window of up to 120 days before each request begins before raw rows and logs do."""
    as_of = views.as_of(spark, sf_dir)
    begun = views.transactions(spark, sf_dir).select("id", (F.col("timestamp") - F.make_dt_interval((F.col("id") % 120).cast("int"))).alias("begin"))
    return begun.select("id", expired(F.col("begin"), as_of).alias("expired"), expired(F.col("begin"), as_of, "logs").alias("logs_expired"))


@register("log_transactions", query("SELECT logs.id, transaction_id, duration FROM logs LEFT JOIN newest USING (project_id, trace_id)", "logs", "newest"))
def log_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D5."""
    found = traces.with_transaction(views.logs(spark, sf_dir).select("id", "project_id", "trace_id"), views.transactions(spark, sf_dir))
    return found.select("id", "transaction_id", "duration")


@register("issue_events", query("SELECT e.id, i.count AS issue_count, i.title AS issue_title FROM issues i JOIN err e USING (project_id, fingerprint)", "issues"))
def issue_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D9."""
    e = views.errors(spark, sf_dir)
    return issues.events_of(issues.group_issues(e), e).select("id", "issue_count", "issue_title")


@register("text_ratio", "SELECT count(*) AS sampled, round(avg(strlen(text)), 6) AS avg_bytes FROM documents")
def text_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample is the whole table here."""
    return retention.text_ratio(views.table(spark, sf_dir, "documents"), "text", 1.0).withColumn("avg_bytes", F.round("avg_bytes", 6))


@register("payload_backfill", query("SELECT concat('e', transaction_id) AS event_id, CASE WHEN id % 3 = 0 THEN trace_id END AS trace_id FROM txn WHERE id % 37 <> 0 AND id % 4 = 0", "txn"))
def payload_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without a trace id take it from their stored payload, where it has one."""
    rows = payloads.event_rows(_routed(spark, sf_dir).filter("sink = 'events'"))
    holes = rows.withColumn("trace_id", F.lit(None).cast("string"))
    return traces.backfill_from_payload(holes).select("event_id", "trace_id")


@register("log_search_indexed", query(
    """(SELECT 'words' AS asked, id FROM logs WHERE environment = 'en' AND regexp_matches(lower(body), '(^|[^a-z0-9])the([^a-z0-9]|$)') AND regexp_matches(lower(body), '(^|[^a-z0-9])and([^a-z0-9]|$)') ORDER BY at_s DESC, id DESC LIMIT 200)
    UNION ALL (SELECT 'phrase', id FROM logs WHERE contains(concat(' ', attrs_text, ' '), ' status 3 ') ORDER BY at_s DESC, id DESC LIMIT 200)""", "logs"))  # fmt: skip
def log_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in any column and a phrase in one, by postings instead of a scan of the bodies."""
    path, logs = f"{sinks.shared_folder(spark)}/postings-{uuid.uuid4().hex}", views.logs(spark, sf_dir)
    log_index.write(logs, path)
    words = log_index.search(logs, path, "the And", wanted=log_search.LogFilter(environment="en"), limit=200)
    phrase = log_index.search(logs, path, "STATUS:3", limit=200)
    return words.select(F.lit("words").alias("asked"), "id").unionByName(phrase.select(F.lit("phrase").alias("asked"), "id"))
