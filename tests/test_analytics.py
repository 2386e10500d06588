"""Rollups, percentiles, series and lists on rows made by hand."""

import math
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkscope.functions import latency
from sparkscope.operators import analytics, percentiles, rollup, series
from sparkscope.operators.filters import Scope, SlowFilter
from sparkscope.plans.window import TimeWindow, WindowError, bucketing_for, resolve_window

HOUR = datetime(2024, 5, 1, 10)
SCHEMA = "id long, project_id int, transaction_name string, environment string, timestamp timestamp, duration int, db_time int, view_time int, query_count int, has_n_plus_one boolean, n_plus_one_time int, http_status string, release string, tags string"


def txn(spark, rows):
    base = {"project_id": 1, "transaction_name": "a#b", "environment": "production", "timestamp": HOUR, "duration": 100, "query_count": 0, "has_n_plus_one": False, "http_status": "200", "release": "v1", "tags": "{}"}
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**base, "id": i, **r}.get(n) for n in names) for i, r in enumerate(rows)], SCHEMA)


def test_hourly_stats(spark):
    t = txn(spark, [
        {"duration": 100, "db_time": 40, "query_count": 2, "http_status": "200"},
        {"duration": 1000, "db_time": 60, "view_time": 10, "query_count": 30, "has_n_plus_one": True, "n_plus_one_time": 96, "http_status": "503"},
        {"duration": 100, "query_count": 4, "http_status": "404"},
    ])
    row = rollup.hourly_stats(t).collect()[0]
    assert (row["count"], row["sum_duration"], row["min_duration"], row["max_duration"]) == (3, 1200, 100, 1000)
    assert (row["sum_db_time"], row["db_time_count"], row["view_time_count"], row["sum_query_count"], row["max_query_count"]) == (100, 2, 1, 36, 30)
    assert (row["n_plus_one_count"], row["sum_n_plus_one_time"], row["error_count"]) == (1, 96, 1)
    assert rollup.latency_histogram(t).agg(F.sum("count")).collect()[0][0] == 3


def test_statuses_that_are_no_numbers_are_no_errors(spark):
    row = rollup.hourly_stats(txn(spark, [{"http_status": None}, {"http_status": "5xx"}, {"http_status": "500"}])).collect()[0]
    assert row["error_count"] == 1


def test_partials_merge_to_the_whole(spark):
    t = txn(spark, [{"duration": 7 * i % 900, "db_time": i if i % 2 else None, "timestamp": HOUR + timedelta(minutes=11 * i), "environment": "x" if i % 3 else None} for i in range(60)])
    parts = rollup.hourly_stats(t.filter("id < 20")).unionByName(rollup.hourly_stats(t.filter("id >= 20")))
    order = [c for c in rollup.hourly_stats(t).columns]
    assert sorted(map(tuple, rollup.merge_stats(parts).select(order).collect())) == sorted(map(tuple, rollup.hourly_stats(t).select(order).collect()))


def test_recount_replaces_its_keys_and_keeps_the_others(spark):
    t = txn(spark, [{"duration": 100}, {"duration": 200}])
    stale = rollup.latency_histogram(txn(spark, [{"duration": 100}, {"duration": 100}, {"duration": 100, "transaction_name": "gone"}]))
    once = rollup.recount_hours(stale, rollup.latency_histogram(rollup.hour_slice(t, HOUR)))
    twice = rollup.recount_hours(once, rollup.latency_histogram(rollup.hour_slice(t, HOUR)))
    rows = sorted(map(tuple, once.select("transaction_name", "count").collect()))
    assert rows == [("a#b", 1), ("a#b", 1), ("gone", 1)]
    assert sorted(map(tuple, twice.select("transaction_name", "count").collect())) == rows


def test_percentiles_of_a_mix(spark):
    t = txn(spark, [{"duration": 100, "db_time": 40, "query_count": 2}] * 90 + [{"duration": 1000, "has_n_plus_one": True, "query_count": 50, "http_status": "500"}] * 10)
    window = TimeWindow(HOUR - timedelta(hours=2), HOUR + timedelta(hours=2))
    row = analytics.percentiles_block(rollup.hourly_stats(t), rollup.latency_histogram(t), t, window).collect()[0]
    assert (row["count"], row["avg_duration"], row["avg_db_time"], row["avg_view_time"], row["error_count"]) == (100, 190.0, 40.0, None, 10)
    assert row["p50"] == pytest.approx(100, rel=0.011) and row["p95"] == pytest.approx(1000, rel=0.011)


def test_impact_ranks_by_time_spent(spark):
    t = txn(spark, [{"duration": 800, "transaction_name": "slow", "has_n_plus_one": i < 20, "query_count": 40 if i < 20 else 1} for i in range(70)] + [{"duration": 10, "transaction_name": "fast"}] * 100)
    window = TimeWindow(HOUR - timedelta(hours=1), HOUR + timedelta(hours=1))
    rows = analytics.endpoint_impact(rollup.hourly_stats(t), rollup.latency_histogram(t), t, window).collect()
    assert [r["transaction_name"] for r in rows] == ["slow", "fast"]
    assert (rows[0]["count"], rows[0]["n_plus_one_count"], rows[0]["max_query_count"], rows[0]["time_spent"]) == (70, 20, 40, 56000)
    assert len(analytics.endpoint_impact(rollup.hourly_stats(t), rollup.latency_histogram(t), t, window, limit=1).collect()) == 1


def test_worklist_orders_by_waste(spark):
    make = lambda name, n, ms: [{"transaction_name": name, "has_n_plus_one": True, "n_plus_one_time": ms}] * n
    t = txn(spark, make("costly", 12, 96) + make("chatty", 40, 8) + make("legacy", 50, None) + [{"transaction_name": "clean"}])
    rows = analytics.n_plus_one_worklist(rollup.hourly_stats(t), TimeWindow(HOUR, HOUR)).collect()
    assert [(r["transaction_name"], r["wasted_ms"], r["avg_wasted_ms"]) for r in rows] == [("costly", 1152, 96.0), ("chatty", 320, 8.0), ("legacy", 0, 0.0)]


def test_batched_percentiles_equal_single_ones(spark):
    t = txn(spark, [{"transaction_name": f"e{i % 3}", "duration": (i * 37) % 2000 + 1, "timestamp": HOUR + timedelta(minutes=i)} for i in range(200)])
    window = TimeWindow(HOUR, HOUR + timedelta(minutes=190))
    hist = rollup.latency_histogram(t)
    batched = {r["transaction_name"]: tuple(r)[1:] for r in percentiles.merged_percentiles(hist, t, window, by_name=True).collect()}
    for name in batched:
        assert tuple(percentiles.merged_percentiles(hist, t, window, Scope(name=name)).collect()[0]) == batched[name]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 2_000_000), min_size=1, max_size=50))
def test_percentiles_are_within_one_per_cent(spark, durations):
    counts = spark.createDataFrame([(d,) for d in durations], "d int").groupBy(latency.bucket_index(F.col("d")).alias("bucket_index")).agg(F.count("*").alias("count"))
    row = percentiles.percentiles_from_counts(counts).collect()[0]
    ordered = sorted(durations)
    for name, q in percentiles.QUANTILES.items():
        exact = ordered[max(0, math.ceil(q * len(ordered)) - 1)]
        assert abs(row[name] - exact) <= 0.0101 * exact


def test_nearest_rank(spark):
    t = txn(spark, [{"duration": d} for d in (5, 1, 3, 3, 9, 7, 3)])
    row = percentiles.nearest_rank(t, "transaction_name").collect()[0]
    ordered = sorted((5, 1, 3, 3, 9, 7, 3))
    assert (row["count"], row["min_duration"], row["max_duration"], row["p50"], row["p95"]) == (7, 1, 9, ordered[3], ordered[6])


def test_no_rows(spark):
    t = txn(spark, [{}]).filter("false")
    window = TimeWindow(HOUR, HOUR + timedelta(hours=1))
    assert percentiles.merged_percentiles(rollup.latency_histogram(t), t, window).collect()[0]["p50"] is None
    assert analytics.endpoint_impact(rollup.hourly_stats(t), rollup.latency_histogram(t), t, window).count() == 0
    assert analytics.error_rate(rollup.hourly_stats(t), window).count() in (0, 1)
    assert [r["count"] for r in series.volume_by_bucket(rollup.latency_histogram(t), rollup.hourly_stats(t), t, window, bucketing_for(window, 6)).collect()] == [0] * 6


@pytest.mark.parametrize(("hours", "buckets", "expected"), [(24, 24, (3600, 24)), (24, 10, (10800, 8)), (90 * 24, 168, (46800, 167)), (1, 12, (300, 12))])
def test_bucketing(hours, buckets, expected):
    got = bucketing_for(TimeWindow(HOUR, HOUR + timedelta(hours=hours)), buckets)
    assert (got.width, got.count) == expected


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.integers(1, 168))
def test_buckets_cover_the_window(hours, buckets):
    got = bucketing_for(TimeWindow(HOUR, HOUR + timedelta(hours=hours)), buckets)
    assert got.width * got.count >= hours * 3600 - got.width * (got.width < 3600) * buckets and got.width * (got.count - 1) < hours * 3600


def test_windows():
    assert resolve_window(HOUR, hours=6) == TimeWindow(HOUR - timedelta(hours=6), HOUR)
    early = resolve_window(HOUR, start=HOUR - timedelta(days=1000), end=HOUR)
    assert early.begin == HOUR - timedelta(days=540) and early.note
    with pytest.raises(WindowError):
        resolve_window(HOUR, start=HOUR, end=HOUR - timedelta(hours=1))
    with pytest.raises(WindowError):
        resolve_window(HOUR, start=HOUR + timedelta(hours=1), end=HOUR + timedelta(hours=2))
    with pytest.raises(WindowError):
        resolve_window(HOUR, start=HOUR - timedelta(days=900), end=HOUR - timedelta(days=800))


def test_the_hour_before_the_window_counts_to_the_first_bucket(spark):
    t = txn(spark, [{"timestamp": HOUR + timedelta(minutes=5)}, {"timestamp": HOUR + timedelta(minutes=70)}])
    window = TimeWindow(HOUR + timedelta(minutes=30), HOUR + timedelta(hours=4, minutes=30))
    rows = series.volume_by_bucket(rollup.latency_histogram(t), rollup.hourly_stats(t), t, window, bucketing_for(window, 4)).orderBy("bucket").collect()
    assert [r["count"] for r in rows] == [2, 0, 0, 0]


def test_event_counts_drop_what_lies_past_the_last_whole_bucket(spark):
    events = spark.createDataFrame([("f", HOUR), ("f", HOUR + timedelta(seconds=100))], "fingerprint string, timestamp timestamp")
    rows = series.event_counts_by_bucket(events, TimeWindow(HOUR, HOUR + timedelta(seconds=100)), 7, "fingerprint").orderBy("bucket").collect()
    assert [r["count"] for r in rows] == [1, 0, 0, 0, 0, 0, 0]


def test_slow_filter(spark):
    t = txn(spark, [{"duration": 1000}, {"duration": 1001, "tags": '{"k":"7"}'}, {"duration": 5000, "tags": '{"k":7}'}, {"duration": 6000, "tags": '{"a":{"b":"x"}}'}])
    window = TimeWindow(HOUR, HOUR)
    ids = lambda **k: [r["id"] for r in analytics.slow_transactions(t, window, slow=SlowFilter(**k)).collect()]
    assert ids(min_duration=1000) == [3, 2, 1]
    assert ids(min_duration=1000, max_duration=5000) == [2, 1]
    assert ids(tags={"k": "7"}) == [1]
    assert ids(tags={"a.b": "x"}) == [3]
    with pytest.raises(ValueError, match="tag key"):
        ids(tags={"k' OR 1": "x"})


def test_scope_substrings_keep_wildcards_live(spark):
    t = txn(spark, [{"transaction_name": "Users#Show"}, {"transaction_name": "UsersXShow"}, {"transaction_name": "other"}])
    assert Scope(name_like="s_sho").apply(t).count() == 2
    assert Scope(name_like="").apply(t).count() == 3


def test_comparison(spark):
    t = txn(spark, [{"duration": 100, "timestamp": HOUR}, {"duration": 150, "timestamp": HOUR + timedelta(hours=2)}, {"duration": 150, "timestamp": HOUR + timedelta(hours=2)}])
    before, after = TimeWindow(HOUR, HOUR + timedelta(hours=1)), TimeWindow(HOUR + timedelta(hours=1), HOUR + timedelta(hours=3))
    row = analytics.compare_windows(t, before, after, "transaction_name").collect()[0]
    assert (row["before_avg"], row["after_avg"], row["avg_change_pct"], row["count_change"]) == (100.0, 150.0, 50.0, 1)
