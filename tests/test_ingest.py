"""Envelopes, payloads, sinks, streaming and the engine."""

import gzip
import json
import zlib
from datetime import datetime, timedelta

import pytest
import zstandard
from pyspark.sql import functions as F

from sparkscope import api
from sparkscope.operators import rollup
from sparkscope.plans.window import TimeWindow
from sparkscope.sources import envelope, payloads, sinks, views
from sparkscope.streaming import bursts, ingest

T = datetime(2024, 5, 1, 10)


def body(*items, head="{}"):
    return "\n".join([head, *(part for item in items for part in item)])


def parsed(spark, *bodies):
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "n int, body string")
    return envelope.parse_envelopes(rows).orderBy("n", "item_index").collect()


def test_envelopes(spark):
    text = '{"a":"ü\n}'
    got = parsed(spark, body(('{"type":"event","length":%d}' % len(text.encode()), text), ('{"type":"session"}', "{}")))
    assert [(r["item_type"], r["payload"], r["error"]) for r in got] == [("event", text, None), ("session", "{}", None)]


@pytest.mark.parametrize("bad", ["", "\n\n", "no json", "[]", "{}", "{}\n{}\n{}", '{}\n{"type":"event"}', '{}\n{"type":"event","length":0}\n{}', '{}\n{"type":"event","length":"x"}\n{}', '{"sent_at":"yesterday"}\n{"type":"event"}\n{}', None])
def test_invalid_envelopes_are_dropped_whole(spark, bad):
    got = parsed(spark, bad)
    assert len(got) == 1 and got[0]["error"] and got[0]["payload"] is None


def test_routing(spark):
    items = [
        ("event", '{"event_id":"e1"}', "events"), ("event", "{}", "dropped"), ("transaction", '{"event_id":"t1","transaction":"a"}', "transactions"), ("transaction", '{"event_id":"t2","transaction":"SolidCable::X"}', "dropped"),
        ("log", '{"items":[]}', "logs"), ("otel_log", "{}", "logs"), ("check_in", '{"monitor_slug":"m"}', "check_ins"), ("check_in", '{"monitor_slug":" "}', "dropped"), ("session", '{"event_id":"s"}', "dropped"), ("attachment", '{"event_id":"s"}', "dropped"),
    ]
    rows = spark.createDataFrame([(body((json.dumps({"type": t}), p)),) for t, p, _ in items], "body string")
    got = envelope.route(envelope.parse_envelopes(rows), store_logs=True).select("item_type", "payload", "sink").collect()
    assert sorted(map(tuple, got)) == sorted(items)
    off = envelope.route(envelope.parse_envelopes(rows), store_events=False, store_transactions=False, store_logs=False)
    assert {r["sink"] for r in off.select("sink").distinct().collect()} == {"dropped", "check_ins"}


def test_the_envelope_gives_a_missing_id(spark):
    rows = spark.createDataFrame([(body(('{"type":"event"}', "{}"), head='{"event_id":"from-head"}'),)], "body string")
    assert envelope.route(envelope.parse_envelopes(rows)).select("event_id", "sink").collect() == [("from-head", "events")]


def test_decompression(spark):
    raw = "{}\n".encode()
    rows = spark.createDataFrame([(0, raw), (1, gzip.compress(raw)), (2, zlib.compress(raw)), (3, zstandard.compress(raw)), (4, b"\x1f\x8bbroken"), (5, None)], "i int, b binary")
    assert [r[0] for r in rows.orderBy("i").select(envelope.decompress(F.col("b"))).collect()] == ["{}\n"] * 4 + [None, None]


def test_otlp_chunks():
    record = lambda n: {"body": {"stringValue": "x" * n}}
    payload = {"resourceLogs": [{"resource": {"a": 1}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [record(400), record(400), record(3000), record(10)]}]}]}
    chunks = list(envelope.otlp_chunks(payload, 1000))
    assert [[len(r["body"]["stringValue"]) for r in c["resourceLogs"][0]["scopeLogs"][0]["logRecords"]] for c in chunks] == [[400, 400], [3000], [10]]
    assert all(c["resourceLogs"][0]["resource"] == {"a": 1} for c in chunks)


def items(spark, *payload):
    return spark.createDataFrame([(1, f"id{i}", json.dumps(p) if not isinstance(p, str) else p, T, i) for i, p in enumerate(payload)], "project_id int, event_id string, payload string, received_at timestamp, item_index int")


def test_events(spark):
    frames = [{"filename": "lib.rb", "lineno": 1}, {"filename": "app.rb", "lineno": 7}]
    got = payloads.event_rows(items(spark,
        {"timestamp": "2024-05-01T09:00:00Z", "exception": {"values": [{"type": "E", "value": "v", "stacktrace": {"frames": frames}}]}, "level": "fatal", "contexts": {"trace": {"trace_id": "x"}}},
        {"timestamp": 1714554000.5, "message": {"formatted": "hello"}}, {"timestamp": "never", "message": "plain", "fingerprint": ["a", "b"]})).orderBy("event_id").collect()
    assert (got[0]["timestamp"], got[0]["fingerprint"], got[0]["level"], got[0]["trace_id"]) == (datetime(2024, 5, 1, 9), "E::app.rb::7", "fatal", "x")
    assert (got[1]["timestamp"], got[1]["message"], got[1]["level"]) == (datetime(2024, 5, 1, 9, 0, 0, 500000), "hello", "error")
    assert (got[2]["timestamp"], got[2]["message"], got[2]["fingerprint"]) == (T, "plain", "a::b")


def test_event_details(spark):
    crumb = [{"category": "c", "message": str(i)} for i in range(15)]
    e = payloads.event_rows(items(spark, {"tags": {"k": "v"}, "breadcrumbs": {"values": crumb}, "exception": {"values": [{"stacktrace": {"frames": [{"filename": "a"}, {"filename": "b"}]}}]}}))
    row = payloads.event_details(e).collect()[0]
    assert row["tags"] == {"k": "v"} and [b["message"] for b in row["breadcrumbs"]] == [str(i) for i in range(5, 15)] and [f["filename"] for f in row["frames"]] == ["b", "a"]


def test_transactions(spark):
    span = lambda op, ms: {"op": op, "start_timestamp": 1.0, "timestamp": 1.0 + ms / 1000}
    got = payloads.transaction_rows(items(spark,
        {"transaction": "a", "start_timestamp": 1714554000.0, "timestamp": 1714554000.25, "measurements": {"db": {"value": 12.0}, "lcp": {"value": 3.0}}, "contexts": {"response": {"status_code": 503}}},
        {"transaction": "b", "start_timestamp": "x", "timestamp": 1714554001.0, "spans": [span("db.sql.active_record", 4), span("db.sql.active_record", 5), span("other", 9)]})).orderBy("transaction_id").collect()
    assert (got[0]["duration"], got[0]["db_time"], got[0]["view_time"], got[0]["http_status"], set(got[0]["measurements"])) == (250, 12, None, "503", {"lcp"})
    assert (got[1]["duration"], got[1]["db_time"], got[1]["view_time"]) == (0, 9, None)


def test_sentry_logs(spark):
    record = {"timestamp": 1714554000.0, "level": "warning", "body": "b", "attributes": {"logger.name": {"value": "L"}, "sentry.trace.trace_id": {"value": "x"}, "duration_ms": {"value": 1.5}, "service.name": "bare"}}
    got = payloads.log_rows(items(spark, {"items": [record, "no object"]}, "[]", "nonsense")).collect()
    assert len(got) == 1
    assert (got[0]["level"], got[0]["logger_name"], got[0]["trace_id"], got[0]["duration_ms"], got[0]["service"], got[0]["source"]) == (3, "L", "x", 1.5, "bare", "sentry")


def test_otlp_logs(spark):
    pair = lambda k, v: {"key": k, "value": {"stringValue": v}}
    comment = "SELECT 1 /*traceparent='00-" + "a" * 32 + "-" + "b" * 16 + "-01'*/"
    payload = {"resourceLogs": [{"resource": {"attributes": [pair("service.name", "S"), pair("deployment.environment", "prod")]}, "scopeLogs": [{"scope": {"name": "scope"}, "logRecords": [
        {"timeUnixNano": "1714554000123456789", "severityNumber": 17, "body": {"stringValue": "b"}, "traceId": "C" * 32, "attributes": [pair("deployment.environment", "own"), pair("log.logger", "L")]},
        {"severityText": "Warning", "body": {"stringValue": comment}, "traceId": "short"}]}]}]}
    got = payloads.otlp_rows(items(spark, payload, {})).orderBy("position").collect()
    assert (got[0]["timestamp"], got[0]["level"], got[0]["environment"], got[0]["trace_id"], got[0]["logger_name"], got[0]["server_name"]) == (datetime(2024, 5, 1, 9, 0, 0, 123456), 4, "prod", "c" * 32, "L", "S")
    assert (got[1]["level"], got[1]["trace_id"], got[1]["span_id"], got[1]["logger_name"], got[1]["timestamp"]) == (3, "a" * 32, "b" * 16, "scope", T)


def test_check_ins(spark):
    got = payloads.check_in_rows(items(spark, {"monitor_slug": "m", "status": "ok", "duration": 2.5, "monitor_config": {"schedule": {"type": "interval", "value": 5, "unit": "minute"}, "checkin_margin": 3}}, {"monitor_slug": "m", "status": "error"})).orderBy("sequence").collect()
    assert (got[0]["schedule_value"], got[0]["checkin_margin"], got[0]["duration"], got[0]["has_config"], got[1]["has_config"]) == ("5", 3, 2.5, True, False)


def test_insert_is_done_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", T), (1, "a", T), (2, "b", T + timedelta(days=1))], "project_id int, transaction_id string, timestamp timestamp")
    assert sinks.insert(rows, path, ["project_id", "transaction_id"], F.col("timestamp")).count() == 2
    assert sinks.insert(rows, path, ["project_id", "transaction_id"], F.col("timestamp")).count() == 0
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and stored.select("day").distinct().count() == 2
    sinks.export_csv(stored.withColumn("list", F.array(F.lit(1))), str(tmp_path / "c"))
    sinks.export_json(stored, str(tmp_path / "j"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == spark.read.json(str(tmp_path / "j")).count() == 2


def test_streaming_ingest_takes_everything_once(spark, tmp_path):
    source = views.envelopes(spark, "/root/testdata/sf0.001")
    for part in range(2):
        source.write.parquet(str(tmp_path / "in" / f"part={part}"))  # every envelope is delivered twice
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    pipeline = ingest.Ingest(spark, str(tmp_path / "out"))
    query = pipeline.start(stream, str(tmp_path / "ckpt"), available_now=True)
    query.awaitTermination(300)
    assert query.exception() is None and ingest.progress(query)["rows"] >= 0
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stored = pipeline.read("transactions")
    wanted = events.filter("event_id % 37 != 0 AND event_id % 31 != 0")
    assert stored.count() == wanted.count()
    assert pipeline.read("events").count() == events.filter("event_id % 37 != 0 AND event_id % 4 = 0").count()
    assert pipeline.read("quarantine").count() == 2 * events.filter("event_id % 37 = 0").count()
    hours = pipeline.hourly().agg(F.sum("count"), F.sum("sum_duration")).collect()[0]
    assert tuple(hours) == tuple(stored.agg(F.count("*"), F.sum("duration")).collect()[0])
    assert pipeline.histogram().agg(F.sum("count")).collect()[0][0] == stored.count()
    # A batch that runs again replaces what it wrote.
    pipeline.process(source, 0)
    assert pipeline.read("transactions").count() == wanted.count()


def test_live_hours(spark, tmp_path):
    t = views.transactions(spark, "/root/testdata/sf0.001")
    t.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = ingest.live_hourly(stream).writeStream.outputMode("complete").format("memory").queryName("live_hours").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = spark.table("live_hours")
    full = views.transactions(spark, "/root/testdata/sf0.001")
    assert sorted(map(str, got.collect())) == sorted(map(str, rollup.hourly_stats(full).select(*got.columns).collect()))


def test_burst_alerts_come_once_an_hour(spark, tmp_path):
    minutes = [0] * 5 + [10] * 5 + [20] * 5 + [71] * 5 + [75] * 6
    rows = spark.createDataFrame([(1, "f", T + timedelta(minutes=m)) for m in minutes] + [(1, "g", T)], "project_id int, fingerprint string, timestamp timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = bursts.burst_alerts(stream, 10).writeStream.format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = sorted((r["fingerprint"], r["alert_at"], r["rate"]) for r in spark.table("alerts").collect())
    assert got == [("f", T + timedelta(minutes=10), 10), ("f", T + timedelta(minutes=71), 10)]


@pytest.fixture(scope="module")
def engine(spark):
    sf = "/root/testdata/sf0.001"
    as_of = views.as_of(spark, sf)
    tables = api.Tables(views.transactions(spark, sf), views.errors(spark, sf), views.logs(spark, sf).withColumn("timestamp", F.lit(as_of)), views.projects(spark), views.spans(spark, sf), views.monitors(spark, sf))
    return api.Engine(tables, as_of)


def test_projects_are_told_by_slug_name_or_id(engine):
    assert [engine.project_id(x) for x in (None, "PROJECT-2", "project 3", "4", 1)] == [None, 2, 3, 4, 1]
    for bad in (" ", "unknown"):
        with pytest.raises(api.ProjectError):
            engine.project_id(bad)


def test_engine_answers(engine, spark):
    day = 24 * 20
    after = engine.window(day)
    before = TimeWindow(after.begin - timedelta(days=5), after.begin)
    issue = engine.list_recent_issues(limit=1).collect()[0]
    one = engine.tables.transactions.orderBy("id").first()
    event = engine.tables.events.orderBy("id").first()
    answers = {
        "status": engine.get_status(), "monitors": engine.list_monitors(), "issues": engine.search_issues("error", "all", 5, "project-1"), "seen": engine.list_recent_issues(environment="staging", release="v1"),
        "issue": engine.get_issue(issue["project_id"], issue["fingerprint"]), "issue events": engine.get_issue_events(issue["project_id"], issue["fingerprint"]), "event": engine.get_event(event["event_id"]),
        "stats": engine.get_transaction_stats(day), "n+1": engine.find_n_plus_one_endpoints(day), "series": engine.get_endpoint_timeseries("view", day), "slow": engine.search_slow_transactions(day, 10), "tagged": engine.search_slow_transactions(day, 0, tags={"k": "7"}),
        "transaction": engine.get_transaction(one["transaction_id"]), "spans": engine.get_transaction_spans(1), "ops": engine.get_transaction_span_ops(1), "summary": engine.get_endpoint_summary("view", day, environment="production"),
        "release": engine.get_endpoint_summary("view", day, release="v1"), "by endpoint": engine.get_transactions_by_endpoint("view", day), "compare": engine.compare_endpoint_performance("view", before, after),
        "logs": engine.search_logs(None, 24), "log": engine.get_log(3), "trace logs": engine.get_trace_logs("t3-0"), "overview": engine.project_overview(1, day), "index": engine.project_index(),
    }
    assert {k: n for k, n in ((k, df.count()) for k, df in answers.items()) if not n} == {}
    assert engine.get_transaction_events(one["transaction_id"]).count() >= 0 and engine.get_transaction_repeats(1).count() >= 0
    for change, status in ((engine.resolve_issue, 1), (engine.ignore_issue, 2), (engine.reopen_issue, 0)):
        engine.tables.changes = change(issue["project_id"], issue["fingerprint"])
        assert engine.get_issue(issue["project_id"], issue["fingerprint"]).collect()[0]["status"] == status
    engine.tables.changes = None


def test_query_analysis_on_ingest(spark):
    """Six queries of two shapes, one of them often enough; the infrastructure's do not count."""
    crumb = lambda sql, category="sql.active_record": {"category": category, "data": {"sql": sql}}
    crumbs = [crumb(f"SELECT * FROM a WHERE id = {i}") for i in range(5)] + [crumb("SELECT 1 FROM b"), crumb("SELECT * FROM solid_queue_jobs"), crumb("x", "http")]
    span = lambda sql, begin, end, op="db.sql.active_record": {"op": op, "description": sql, "start_timestamp": begin, "timestamp": end}
    spans = [span("SELECT * FROM a WHERE id = 9", 1.0, 1.5), span("SELECT * FROM a WHERE id = 8", 2.0, 2.25), span("SELECT 1 FROM b", 3.0, 3.5), span("SELECT * FROM a WHERE id = 7", None, 1.0)]
    items = [
        (1, "t1", {"breadcrumbs": {"values": crumbs}, "spans": spans}), (2, "t1", {"breadcrumbs": {"values": crumbs}}), (1, "t2", {"breadcrumbs": {"values": []}, "spans": spans}),
        (1, "t3", {}), (1, "t4", {"breadcrumbs": "broken", "measurements": {"db": {"value": 7}}}),
    ]
    rows = spark.createDataFrame([(p, T, t, json.dumps(body)) for p, t, body in items], "project_id int, received_at timestamp, event_id string, payload string")
    got = payloads.with_query_analysis(payloads.transaction_rows(rows)).select("project_id", "transaction_id", "query_count", "has_n_plus_one", "n_plus_one_time", "db_time").collect()
    assert sorted(map(tuple, got), key=str) == [(1, "t1", 6, True, 750, 1250), (1, "t2", 0, False, None, 1250), (1, "t3", 0, False, None, None), (1, "t4", 0, False, None, 7), (2, "t1", 6, True, None, None)]


def test_compaction_keeps_what_is_stored(spark, tmp_path):
    pipeline, source = ingest.Ingest(spark, str(tmp_path / "t")), views.envelopes(spark, "/root/testdata/sf0.001")
    first = source.filter("day(received_at) < 10")
    pipeline.process(first, 0)
    before = (sorted(map(str, pipeline.hourly().collect())), sorted(map(str, pipeline.histogram().collect())))
    hour = pipeline.read("transactions").agg(F.max(F.date_trunc("hour", "timestamp"))).first()[0]
    pipeline.compact(0, [hour])
    assert before == (sorted(map(str, pipeline.hourly().collect())), sorted(map(str, pipeline.histogram().collect())))
    pipeline.process(first, 1)  # all of it again, in a later batch, after the keys were compacted
    assert before[0] == sorted(map(str, pipeline.hourly().collect())) and pipeline.read("logs").count() == 0
    pipeline.process(source, 2)
    pipeline.compact(2)
    whole = ingest.Ingest(spark, str(tmp_path / "w"))
    whole.process(source, 0)
    assert sorted(map(str, pipeline.hourly().collect())) == sorted(map(str, whole.hourly().collect()))
    assert sorted(map(str, whole.recounted(hour)[0].select(*whole.hourly().columns).collect())) == sorted(map(str, whole.hourly().collect()))
    days = {r["day"] for r in whole.read("transactions").select("day").distinct().collect()}
    assert len(days) > 5 and "PartitionFilters: [isnotnull(day" in whole.read("transactions").filter(F.col("day") == F.lit(min(days)))._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_rejected_otlp_records_are_counted(spark, tmp_path):
    record = lambda n: {"body": {"stringValue": "x" * n}}
    payload = json.dumps({"resourceLogs": [{"resource": {}, "scopeLogs": [{"scope": {}, "logRecords": [record(5), record(500), record(6), record(700)]}]}]})
    envelopes = spark.createDataFrame([(3, T, body(('{"type":"otel_log"}', payload))), (3, T, body(('{"type":"otel_log"}', "no json")))], "project_id int, received_at timestamp, body string")
    pipeline = ingest.Ingest(spark, str(tmp_path / "t"), otlp_limit=200)
    pipeline.process(envelopes, 0)
    assert pipeline.read("logs_otlp").count() == 2
    assert pipeline.read("rejected").select("project_id", "rejected_records").collect() == [(3, 2)]
