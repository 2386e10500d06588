"""SQL of the registered queries, for an engine that runs on the same tables: the views, then one text for each query."""

from __future__ import annotations

from ..sources.views import STATEMENTS


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ENV = "CASE user_id % 4 WHEN 0 THEN 'staging' WHEN 1 THEN NULL ELSE 'production' END"
_TRACE = "concat('t', CAST(user_id AS VARCHAR), '-', CAST(event_id // 10 AS VARCHAR))"

VIEWS = {
    "txn": f"""SELECT event_id AS id, CAST(event_id AS VARCHAR) AS transaction_id, CAST(user_id % 5 AS INTEGER) AS project_id, event_type AS transaction_name, {_ENV} AS environment,
      ts AS timestamp, CAST(floor(value * 10) AS INTEGER) AS duration, CASE WHEN event_id % 3 <> 0 THEN CAST(floor(value * 4) AS INTEGER) END AS db_time,
      CASE WHEN event_id % 5 <> 0 THEN CAST(floor(value) AS INTEGER) END AS view_time, CAST(event_id % 17 AS INTEGER) AS query_count, event_id % 11 = 0 AS has_n_plus_one,
      CASE WHEN event_id % 22 = 0 THEN CAST(floor(value) AS INTEGER) END AS n_plus_one_time, CASE WHEN event_type = 'error' THEN '500' WHEN event_id % 13 = 0 THEN '404' ELSE '200' END AS http_status,
      concat('v', CAST(event_id % 3 AS VARCHAR)) AS release, {_TRACE} AS trace_id FROM events""",
    "span_of_time": "SELECT max(ts) AS as_of, max(ts) - INTERVAL 168 HOUR AS begin_at, date_trunc('hour', max(ts)) AS last_hour, date_trunc('hour', max(ts) - INTERVAL 168 HOUR) AS first_hour FROM events",
    "hourly": """SELECT project_id, transaction_name, coalesce(environment, '') AS environment, date_trunc('hour', timestamp) AS hour_bucket, CAST(count(*) AS BIGINT) AS count, CAST(sum(duration) AS BIGINT) AS sum_duration,
      min(duration) AS min_duration, max(duration) AS max_duration, CAST(coalesce(sum(db_time), 0) AS BIGINT) AS sum_db_time, count(db_time) AS db_time_count, CAST(coalesce(sum(view_time), 0) AS BIGINT) AS sum_view_time,
      count(view_time) AS view_time_count, CAST(sum(query_count) AS BIGINT) AS sum_query_count, max(query_count) AS max_query_count, count(*) FILTER (has_n_plus_one) AS n_plus_one_count,
      CAST(coalesce(sum(n_plus_one_time), 0) AS BIGINT) AS sum_n_plus_one_time, count(*) FILTER (CAST(http_status AS INTEGER) >= 500) AS error_count FROM txn GROUP BY ALL""",
    "hist": "SELECT project_id, transaction_name, coalesce(environment, '') AS environment, date_trunc('hour', timestamp) AS hour_bucket, CAST(floor(ln(greatest(duration, 1)) / ln(1.02)) AS INTEGER) AS bucket_index, count(*) AS count FROM txn GROUP BY ALL",
    "inside": "SELECT h.* FROM hourly h, span_of_time WHERE hour_bucket BETWEEN first_hour AND last_hour",
    "merged": """SELECT project_id, transaction_name, bucket_index, count FROM hist, span_of_time WHERE hour_bucket >= first_hour AND hour_bucket < last_hour UNION ALL
      SELECT project_id, transaction_name, CAST(floor(ln(greatest(duration, 1)) / ln(1.02)) AS INTEGER), 1 FROM txn, span_of_time WHERE timestamp >= greatest(begin_at, last_hour) AND timestamp < as_of""",
    "err": f"""SELECT event_id AS id, CAST(event_id AS VARCHAR) AS event_id, CAST(user_id % 5 AS INTEGER) AS project_id, ts AS timestamp, event_type AS exception_type, concat(event_type, ' at ', CAST(event_id % 9 AS VARCHAR)) AS exception_value,
      concat(event_type, '::f', CAST(user_id % 7 AS VARCHAR), '.rb::', CAST(user_id % 3 AS VARCHAR)) AS fingerprint, {_ENV} AS environment, concat('v', CAST(event_id % 3 AS VARCHAR)) AS release, {_TRACE} AS trace_id FROM events WHERE event_type IN ('error', 'signup')""",
    "issues": "SELECT project_id, fingerprint, count(*) AS count, min(timestamp) AS first_seen, max(timestamp) AS last_seen, arg_min(exception_value, id) AS title, arg_min(exception_type, id) AS exception_type FROM err GROUP BY ALL",
    "status": "SELECT *, CASE WHEN contains(fingerprint, 'f1.rb') THEN 1 WHEN contains(fingerprint, 'f2.rb') THEN 2 ELSE 0 END AS status FROM issues",
    "issue_facets": "SELECT project_id, fingerprint, name, value, max(timestamp) AS last_seen_at FROM (SELECT *, 'environment' AS name, environment AS value FROM err UNION ALL SELECT *, 'release', release FROM err) WHERE trim(value) <> '' GROUP BY ALL",
    "spans": """SELECT l_orderkey AS transaction_id, o_orderdate AS root_ts, l_linenumber AS sequence, CASE l_returnflag WHEN 'A' THEN 'db.sql.active_record' WHEN 'N' THEN 'http.client' ELSE 'view.render' END AS op,
      concat('SELECT ', l_linestatus, ' ', CAST(l_suppkey % 2 AS VARCHAR)) AS description, CAST(floor(l_quantity * 10) AS INTEGER) AS duration_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "logs": """SELECT doc_id AS id, CAST(doc_id % 5 AS INTEGER) AS project_id, 1704067200 + doc_id * 60 AS at_s, CAST(doc_id % 6 AS INTEGER) AS level, text AS body, source AS service, lang AS environment, CAST(doc_id % 1000 AS DOUBLE) AS duration_ms,
      concat('status ', CAST(doc_id % 7 AS VARCHAR), ' user_id ', CAST(doc_id % 50 AS VARCHAR)) AS attrs_text, concat('t', CAST(doc_id % 200 AS VARCHAR), '-', CAST(doc_id // 10 AS VARCHAR)) AS trace_id FROM documents""",
    "newest": "SELECT project_id, trace_id, arg_max(transaction_id, (timestamp, id)) AS transaction_id, arg_max(transaction_name, (timestamp, id)) AS transaction_name, arg_max(duration, (timestamp, id)) AS duration FROM txn GROUP BY ALL",
    "crumbs": f"""SELECT l_orderkey AS transaction_id, l_linenumber AS pos, replace(replace([{", ".join(quoted(x) for x in STATEMENTS)}][l_linenumber], '{{part}}', CAST(l_partkey % 50 AS VARCHAR)), '{{qty}}', CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS sql FROM lineitem""",
    "monitors": """SELECT user_id AS monitor_id, CAST(user_id % 5 AS INTEGER) AS project_id, concat('job-', CAST(user_id AS VARCHAR)) AS slug, user_id % 6 + 1 AS n, CASE WHEN user_id % 2 = 0 THEN 3600 ELSE 86400 END AS unit,
      greatest(user_id % 3 * 30, 1) * 60 AS margin, max(ts) AS last_at, arg_max(event_type, (ts, event_id)) AS last_event FROM events GROUP BY user_id""",
}
#: Views that a view reads.
_NEEDS = {"hourly": ["txn"], "hist": ["txn"], "inside": ["hourly", "span_of_time"], "merged": ["hist", "span_of_time"], "issues": ["err"], "status": ["issues"], "issue_facets": ["err"], "newest": ["txn"]}


def query(body: str, *views: str, **more: str) -> str:
    """``body`` after the views it reads, theirs first, and its own subqueries ``more``."""
    names: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in names:
            names.append(name)

    for view in views:
        need(view)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({text})" for n, text in more.items()]
    return "WITH " + ", ".join(parts) + " " + body if parts else body


def percentiles(source: str, *keys: str, names: tuple[str, ...] = ("p50", "p95", "p99")) -> dict[str, str]:
    """Subqueries ``added``, ``summed`` and ``pct`` over bucket counts, the last with a row for each key."""
    by = ", ".join(keys)
    lead, part = (f"{by}, ", f"PARTITION BY {by} ") if keys else ("", "")
    at = lambda n: f"power(1.02, min(CASE WHEN running >= CAST(0.{n[1:]} AS DOUBLE) * whole THEN bucket_index END) + 0.5) AS {n}"
    return {
        "added": f"SELECT {lead}bucket_index, CAST(sum(count) AS BIGINT) AS n FROM {source} GROUP BY {lead}bucket_index",
        "summed": f"SELECT *, CAST(sum(n) OVER ({part}ORDER BY bucket_index) AS BIGINT) AS running, CAST(sum(n) OVER ({part}) AS BIGINT) AS whole FROM added",
        "pct": f"SELECT {lead}{', '.join(map(at, names))}, max(whole) AS sampled FROM summed" + (f" GROUP BY {by}" if keys else ""),
    }


def mean(total: str, n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN round({total} / {n}, 1) END"


MERGE = """CAST(sum(count) AS BIGINT) AS count, CAST(sum(sum_duration) AS BIGINT) AS sum_duration, CAST(sum(sum_db_time) AS BIGINT) AS sum_db_time, CAST(sum(db_time_count) AS BIGINT) AS db_time_count,
  CAST(sum(sum_view_time) AS BIGINT) AS sum_view_time, CAST(sum(view_time_count) AS BIGINT) AS view_time_count, CAST(sum(sum_query_count) AS BIGINT) AS sum_query_count, CAST(sum(n_plus_one_count) AS BIGINT) AS n_plus_one_count,
  CAST(sum(sum_n_plus_one_time) AS BIGINT) AS sum_n_plus_one_time, CAST(sum(error_count) AS BIGINT) AS error_count, min(min_duration) AS min_duration, max(max_duration) AS max_duration, max(max_query_count) AS max_query_count"""


_COMMENT, _NUMBER = r"/\*.*?\*/", r"(?:\B-|\b)\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_LITERAL = r"'[^'\\]*(?:(?:\\.|'')[^'\\]*)*'"


def normal_sql(sql: str) -> str:
    """The stored normal form of a statement, from patterns without look-around: comments and literals are cut out, numbers are
    replaced between them, then blanks and lists between the comments."""
    lexer, comment = quoted(f"(?s){_COMMENT}|{_LITERAL}"), quoted(f"(?s){_COMMENT}")
    pieces = lambda text, pattern, rest, token: f"array_to_string(list_transform(range(1, len(regexp_split_to_array({text}, {pattern})) + 1), lambda i: {rest(f'regexp_split_to_array({text}, {pattern})[i]')} || CASE WHEN i > len(regexp_extract_all({text}, {pattern})) THEN '' ELSE {token(f'regexp_extract_all({text}, {pattern})[i]')} END), '')"
    bare = pieces(sql, lexer, lambda x: f"regexp_replace({x}, {quoted(_NUMBER)}, '?', 'g')", lambda t: f"CASE WHEN starts_with({t}, '/*') THEN {t} ELSE '?' END")
    listed = lambda x: rf"regexp_replace(regexp_replace({x}, '(?i)\bIN\s*\(\s*\?(?:\s*,\s*\?)+\s*\)', 'IN (?)', 'g'), '\s+', ' ', 'g')"
    return f"(SELECT trim({pieces('b.t', comment, listed, lambda t: t)}) FROM (SELECT {bare} AS t) b)"


def pattern_sql(sql: str) -> str:
    """The shape of a query: comments go, then every value in one pass. The patterns of values are fixed values, and must be the
    operator's: what the text tests is the order in which they apply."""
    values = "|".join((r"\b(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\b", r"(?i:\b(IN)\s*(\()[^)]+\))", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", r"https?://\S+", r"'[^']*'", r"\b(?i:TRUE|FALSE)\b", _NUMBER))
    marked = f"regexp_replace(regexp_replace({sql}, {quoted('(?s)' + _COMMENT)}, '', 'g'), {quoted(values)}, '\\1\\2?', 'g')"
    return rf"trim(regexp_replace(regexp_replace({marked}, '(?i)\bIN\(\?', 'IN (?)', 'g'), '\s+', ' ', 'g'))"
