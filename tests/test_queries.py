"""Registered queries against their SQL, both over the smallest tables: streams, ingest and what combines several operators."""

import math
from pathlib import Path

import duckdb
import pytest

from sparkscope.plans import catalogue

SF = "/root/testdata/sf0.001"
NAMES = (
    "burst_alert_stream", "live_hours", "stream_progress", "decompressed_bodies", "ingest_rollup", "transaction_export", "check_in_fold", "monitor_crontabs",
    "facet_retirement", "pattern_times", "p95_by_bucket", "endpoint_stats", "span_depth", "sql_normalize", "query_patterns", "event_details",
    "ingest_transactions", "ingest_issues", "ingest_facets", "ingest_releases", "retention_at_rest", "keys_among_stored", "retry_and_bury", "log_search_indexed",
    "project_resolution", "raw_expiry", "monitor_issues", "transaction_events", "stream_metrics",
)


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    found.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        found.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return found


def _value(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return repr(x)
    try:
        return "nan" if math.isnan(x) else f"{float(x):.9g}"
    except TypeError:
        return str(x)


@pytest.mark.parametrize("name", NAMES)
def test_queries_and_their_sql_agree(spark, tables, name):
    got = catalogue.QUERIES[name](spark, SF)
    wanted = tables.execute(catalogue.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(c[0] for c in wanted.description)
    places = [[c[0] for c in wanted.description].index(c) for c in columns]
    rows = sorted([_value(row[i]) for i in places] for row in wanted.fetchall())
    assert rows
    assert sorted([_value(row[c]) for c in columns] for row in got.collect()) == rows
