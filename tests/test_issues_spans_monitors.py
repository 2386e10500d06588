"""Issues, traces, spans, retention and monitors on rows made by hand."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkscope.operators import issues, log_search, monitors, retention, spans, traces
from sparkscope.plans import catalogue
from sparkscope.sources import envelope, payloads, views

T = datetime(2024, 5, 1, 10)
EVENT = "id long, event_id string, project_id int, timestamp timestamp, exception_type string, exception_value string, fingerprint string, environment string, release string, trace_id string"


def events(spark, rows):
    names = [c.split()[0] for c in EVENT.split(", ")]
    base = {"project_id": 1, "timestamp": T, "exception_type": "E", "exception_value": "v", "fingerprint": "f"}
    return spark.createDataFrame([tuple({**base, "id": i, "event_id": str(i), **r}.get(n) for n in names) for i, r in enumerate(rows)], EVENT)


def test_fingerprints(spark):
    rows = spark.createDataFrame([(["a", None, "b"], "T", "f.rb", "3", "m"), (None, "T", "f.rb", "3", "m"), (None, "T", None, None, "m"), (None, None, None, None, "m"), ([], " ", None, None, None)], "d array<string>, k string, f string, l string, m string")
    got = [r[0] for r in rows.select(issues.fingerprint(*[F.col(c) for c in "dkflm"])).collect()]
    import hashlib

    assert got == ["a::::b", "T::f.rb::3", "T::::", hashlib.md5(b"m").hexdigest(), hashlib.md5(b"Unknown Error").hexdigest()]


def test_issue_takes_title_of_the_first_event(spark):
    e = events(spark, [{"exception_value": "later text", "id": 9, "timestamp": T}, {"exception_value": "first text", "id": 2, "timestamp": T + timedelta(hours=1)}, {"exception_value": " ", "fingerprint": "g"}])
    rows = {r["fingerprint"]: r for r in issues.group_issues(e).collect()}
    assert (rows["f"]["title"], rows["f"]["count"], rows["f"]["first_seen"], rows["f"]["last_seen"]) == ("first text", 2, T, T + timedelta(hours=1))
    assert rows["g"]["title"] == "E"


def test_status_is_the_last_change(spark):
    found = issues.group_issues(events(spark, [{}, {"fingerprint": "g"}]))
    changes = spark.createDataFrame([(1, "f", T, 1), (1, "f", T + timedelta(hours=1), 2), (1, "f", T - timedelta(hours=1), 0)], "project_id int, fingerprint string, changed_at timestamp, status int")
    got = {r["fingerprint"]: r["status"] for r in issues.current_status(found, changes).collect()}
    assert got == {"f": issues.IGNORED, "g": issues.OPEN}


def test_facets_never_move_back(spark):
    old = issues.issue_facets(events(spark, [{"environment": "x", "timestamp": T}]))
    new = issues.issue_facets(events(spark, [{"environment": "x", "timestamp": T - timedelta(days=1)}, {"environment": " "}, {"release": "r"}]))
    got = {(r["name"], r["value"]): r["last_seen_at"] for r in issues.merge_facets(old, new).collect()}
    assert got == {("environment", "x"): T, ("release", "r"): T}


def test_search_escapes_wildcards(spark):
    found = issues.group_issues(events(spark, [{"exception_value": "_dump"}, {"exception_value": "Xdump", "fingerprint": "g"}])).withColumn("status", F.lit(0))
    titles = lambda q: [r["title"] for r in issues.search_issues(found, q).collect()]
    assert titles("_DUMP") == ["_dump"] and titles("%") == [] and len(titles("dump")) == 2


def test_bursts(spark):
    e = events(spark, [{"timestamp": T - timedelta(minutes=i)} for i in range(70)])
    found = issues.group_issues(e).withColumn("status", F.lit(0))
    assert [r["rate"] for r in issues.burst_rates(e, found, T, 60).collect()] == [60]
    assert issues.burst_rates(e, found, T, 61).count() == 0
    assert issues.burst_rates(e, found.withColumn("status", F.lit(1)), T, 60).count() == 0


def test_recount_touches_affected_issues_only(spark):
    found = spark.createDataFrame([(1, "f", 10), (1, "g", 10), (1, "h", 10)], "project_id int, fingerprint string, count long")
    left, affected = events(spark, [{}, {"fingerprint": "h"}]), events(spark, [{}, {"fingerprint": "g"}])
    assert {r["fingerprint"]: r["count"] for r in issues.recount(found, left, affected).collect()} == {"f": 1, "g": 0, "h": 10}


def test_blank_traces_join_nothing(spark):
    t = spark.createDataFrame([(1, 1, "t1", "n", 5, "", T), (2, 1, "t2", "n", 6, "x", T), (3, 1, "t3", "n", 7, "x", T + timedelta(seconds=1))], "id long, project_id int, transaction_id string, transaction_name string, duration int, trace_id string, timestamp timestamp")
    e = events(spark, [{"trace_id": ""}, {"trace_id": "x"}, {"trace_id": None}, {"trace_id": "x", "project_id": 2}])
    assert {r["id"]: r["transaction_id"] for r in traces.with_transaction(e, t).collect()} == {0: None, 1: "t3", 2: None, 3: None}
    assert [r["transaction_id"] for r in traces.events_of_transactions(t, e).orderBy("transaction_id").collect()] == ["t2", "t3"]


def test_span_depths_against_a_loop(spark):
    rows = catalogue.QUERIES["span_depth"](spark, "/root/testdata/sf0.001").collect()
    from sparkscope.sources import views

    by = {}
    for r in rows:
        by.setdefault(r["transaction_id"], []).append((r["sequence"], r["depth"]))
    for r in views.span_trees(spark, "/root/testdata/sf0.001").collect():
        known, expected = {"root": 0}, [(0, 0)]
        ordered = sorted(enumerate(r["spans"]), key=lambda x: (x[1]["start_timestamp"], x[0]))
        for place, (_, s) in enumerate(ordered):
            known[s["span_id"]] = depth = known.get(s["parent_span_id"], 0) + 1
            expected.append((place + 1, depth))
        assert sorted(by[r["transaction_id"]]) == expected


def test_span_cap(spark):
    many = [(f"s{i}", "root", "db", "d", float(i), float(i) + 0.5) for i in range(1005)]
    t = spark.createDataFrame([(1, "t", "root", "http", "n", 0.0, 2000.0, many)], "project_id int, transaction_id string, root_span_id string, op string, transaction_name string, start_timestamp double, end_timestamp double, spans array<struct<span_id:string,parent_span_id:string,op:string,description:string,start_timestamp:double,timestamp:double>>")
    rows = spans.span_rows(t)
    assert rows.count() == 1001 and rows.filter("spans_truncated").count() == 1001
    assert rows.agg(F.max("depth")).collect()[0][0] == 1


def crumbs(spark, texts):
    return spark.createDataFrame([("t", i, "sql.active_record", s) for i, s in enumerate(texts)], "transaction_id string, pos int, category string, sql string")


def test_repeated_queries(spark):
    row = spans.repeated_queries(crumbs(spark, [f"SELECT * FROM u WHERE id = {i}" for i in range(5)] + ["SELECT 1 FROM v"] * 3 + [" ", "SELECT 1 FROM solid_queue_jobs"])).collect()[0]
    assert (row["total_queries"], row["unique_patterns"], row["flagged_patterns"], row["identical_patterns"]) == (9, 2, 1, 0)
    same = spans.query_patterns(crumbs(spark, ["SELECT 1 FROM u WHERE id = 7"] * 5)).collect()[0]
    assert (same["count"], same["distinct_count"], same["example"]) == (5, 1, "SELECT 1 FROM u WHERE id = 7")


def test_time_of_repeated_queries(spark):
    timed = spark.createDataFrame([("t", "db.sql", "SELECT * FROM u WHERE id = 1", 8.0)] * 5 + [("t", "db.sql", "SELECT 2 FROM w", 99.0), ("t", "http", "SELECT * FROM u WHERE id = 1", 99.0)], "transaction_id string, op string, description string, duration_ms double")
    texts = [f"SELECT * FROM u WHERE id = {i}" for i in range(5)] + ["SELECT 2 FROM w"]
    assert spans.repeated_queries(crumbs(spark, texts), timed).collect()[0]["wasted_ms"] == 40
    assert spans.repeated_queries(crumbs(spark, texts)).collect()[0]["wasted_ms"] is None


def test_repeats_need_more_than_three(spark):
    rows = spark.createDataFrame([("t", i, "db", d, 10) for i, d in enumerate(["a"] * 3 + ["b"] * 4 + [" "] * 9)], "transaction_id string, sequence int, op string, description string, duration_ms int")
    assert [(r["description"], r["count"], r["total_ms"]) for r in spans.repeated_descriptions(rows, "transaction_id").collect()] == [("b", 4, 40)]


def test_retention(spark):
    e = events(spark, [{"timestamp": T - timedelta(days=d)} for d in (0, 29, 30, 31)])
    assert retention.survivors(e, T, "events").count() == 3 and retention.retired(e, T, "events").count() == 1
    assert [retention.queue_status(n) for n in (0, 49, 50, 99, 100)] == ["ok", "ok", "warning", "warning", "critical"]


MONITOR = "project_id int, slug string, schedule_type string, schedule_value string, schedule_unit string, checkin_margin int, max_runtime int, timezone string, last_status string, last_checkin_at timestamp, in_progress_since timestamp, state string, created_at timestamp"


def monitor(**given):
    base = {"project_id": 1, "slug": "job", "schedule_type": "interval", "schedule_value": "1", "schedule_unit": "minute", "checkin_margin": 5, "max_runtime": 30, "state": "ok", "last_status": "ok", "last_checkin_at": T, "created_at": T}
    return tuple({**base, **given}.get(c.split()[0]) for c in MONITOR.split(", "))


def test_monitor_sweep(spark):
    at = T + timedelta(minutes=10)
    rows = spark.createDataFrame([
        monitor(slug="silent"), monitor(slug="fine", last_checkin_at=at), monitor(slug="bad", last_checkin_at=at, last_status="error"),
        monitor(slug="stuck", last_checkin_at=at, last_status="in_progress", in_progress_since=at - timedelta(minutes=31), state="ok"), monitor(slug="new", last_checkin_at=None, last_status=None, created_at=at, state="unknown"),
        monitor(slug="never", last_checkin_at=None, last_status=None, state="unknown"), monitor(slug="cron", schedule_type="crontab", schedule_value="0 * * * *"), monitor(slug="back", last_checkin_at=at, state="missed"),
    ], MONITOR)
    judged = monitors.verdicts(rows, at)
    got = {r["slug"]: (r["failures"], r["next_state"]) for r in judged.collect()}
    assert got == {"silent": (["missed"], "missed"), "fine": ([], "ok"), "bad": (["error"], "error"), "stuck": (["overrun"], "overrun"), "new": ([], "unknown"), "never": (["missed"], "missed"), "cron": ([], "ok"), "back": ([], "ok")}
    stored = spark.createDataFrame([(1, "monitor:silent:missed", 0), (1, "monitor:bad:error", 1), (1, "monitor:stuck:overrun", 2), (1, "monitor:back:missed", 0)], "project_id int, fingerprint string, status int")
    changes = {r["fingerprint"]: r["status"] for r in monitors.issue_transitions(judged, stored, at).collect()}
    assert changes == {"monitor:bad:error": 0, "monitor:never:missed": 0, "monitor:back:missed": 1}


def test_check_ins_fold_in_order(spark):
    schema = "project_id int, slug string, status string, arrived_at timestamp, sequence int, duration double, environment string, has_config boolean, schedule_type string, schedule_value string, schedule_unit string, checkin_margin int, max_runtime int, timezone string"
    row = lambda status, minute, duration=None, config=False: (1, " job ", status, T + timedelta(minutes=minute), 0, duration, None, config, *(("interval", "2", "hour", 5, 9, None) if config else (None,) * 6))
    got = monitors.fold_check_ins(spark.createDataFrame([row("ok", 1, 3.5, True), row("in_progress", 5), row("what", 9), row("error", 2, 1.5)], schema)).collect()[0]
    assert (got["slug"], got["last_status"], got["last_ok_at"], got["in_progress_since"], got["last_duration"], got["schedule_value"]) == ("job", "in_progress", T + timedelta(minutes=1), T + timedelta(minutes=5), 1.5, "2")


def test_log_search_is_newest_first_and_clamped(spark):
    logs = spark.createDataFrame([(i, 1, T + timedelta(minutes=i), i % 6, f"line {i}", None, float(i)) for i in range(300)], "id long, project_id int, timestamp timestamp, level int, body string, attrs_text string, duration_ms double")
    got = [r["id"] for r in log_search.search_logs(logs, "line", limit=1000).collect()]
    assert got == list(range(299, 99, -1))
    assert log_search.search_logs(logs, None, wanted=log_search.LogFilter(level="unheard"), limit=0).count() == 1


@pytest.mark.parametrize("name", ["endpoint_impact", "issue_grouping", "log_search", "monitor_verdicts", "ingest_events"])
def test_registered_queries_have_rows_and_sql(spark, name):
    assert name in catalogue.SQL and catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_waterfall_reads_the_spans_once_and_keeps_spans_without_a_transaction(spark):
    rows = spark.createDataFrame([(1, 0, 50), (1, 100, 100), (2, 7, 0), (None, 5, 10)], "transaction_id long, start_ms long, duration_ms long")
    found = spans.with_waterfall(rows)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["transaction_id"], r["start_ms"]): (r["offset_pct"], r["width_pct"]) for r in found.collect()}
    assert got == {(1, 0): (0.0, 25.0), (1, 100): (50.0, 50.0), (2, 7): (0.0, 0.25), (None, 5): (0.0, 100.0)}


def test_queries_are_gathered_once_in_parts_that_do_not_grow(spark, monkeypatch):
    from sparkscope.sources import views

    monkeypatch.setattr(views, "QUERY_ROWS", 600)
    lines = views.breadcrumbs(spark, "/root/testdata/sf0.001", gathered=True)
    assert lines.rdd.getNumPartitions() == -(-lines.count() // 600) > 4
    assert spans.query_patterns(lines)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_patterns_of_rows_are_those_of_exploded_rows(spark):
    sql = lambda *texts: [("sql.active_record", None, None, (t,)) for t in texts]
    span = lambda op, text, a, b: (None, None, None, op, None, text, a, b)
    rows = spark.createDataFrame([
        (1, "a", [span("db.sql", "SELECT * FROM u WHERE id = 1", 0.0, 0.0125), span("db", "SELECT * FROM u WHERE id = 9", 1.0, 1.5), span("http", "SELECT 1", 0.0, 1.0), span("db", "SELECT 3 FROM never", 0.0, 1.0), span("db", "SELECT 'x' FROM v", None, 1.0), span(None, "SELECT 1", 0.0, 1.0), span("db", " ", 0.0, 1.0), span("db", None, 0.0, 1.0)],
         sql("SELECT * FROM u WHERE id = 7", "SELECT 'y' FROM v", "SELECT * FROM u WHERE id = 1", "SELECT * FROM u WHERE id = 7", " ", None, "SELECT 1 FROM solid_queue_jobs", "/* c */", "") + [("http", None, None, ("SELECT 1",)), (None, None, None, ("SELECT 1",)), ("sql.active_record", None, None, None)]),
        (2, "a", [span("db", "SELECT 5", 0.0, 0.1)], sql("SELECT 4", "SELECT 2")), (1, "none", [span("db", "SELECT 5", 0.0, 0.1)], None), (1, "empty", [], []), (1, "bare", None, sql("SELECT " + "a, " * 400 + "8"))],
        f"project_id int, transaction_id string, spans {payloads.SPANS}, breadcrumbs {payloads.CRUMBS}")
    want = spans.query_patterns(payloads.breadcrumb_rows(rows), payloads.span_times(rows), payloads.TRANSACTION_KEYS)
    got = spans.patterns_of_rows(rows, payloads.TRANSACTION_KEYS)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 5


def test_patterns_of_envelopes_take_one_reading(spark):
    for name in ("pattern_times", "transaction_export"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("EvalPythonUDTF") == 1 and plan.count("Exchange") == 1, name
    routed = envelope.route(envelope.parse_envelopes(views.envelopes(spark, "/root/testdata/sf0.001"))).select("item_type", "sink", "event_id")
    assert routed._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
