"""Column functions over SQL and log texts, and small derived values."""

import pytest
from pyspark.sql import functions as F

from sparkscope.functions import log_text, scalars, sql_text
from sparkscope.operators.monitors import cron_next


@pytest.fixture(scope="module")
def value(spark):
    def of(f, *texts):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = [r["v"] for r in rows.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]
        return got if len(texts) > 1 else got[0]

    return of


def test_sql_normalize(value):
    got = value(sql_text.sql_normalize, "SELECT * FROM t1 WHERE a = 'it''s' AND b = -1.5e3  AND c IN (1, 2,3)", "SELECT 1 /* app:x,id:42 */", "  a\n b ", "x = 'a\\'b'", "SELECT col1, t2.c3")
    assert got == ["SELECT * FROM t1 WHERE a = ? AND b = ? AND c IN (?)", "SELECT ? /* app:x,id:42 */", "a b", "x = ?", "SELECT col1, t2.c3"]


def test_sql_normalize_cuts_bytes_on_characters(value):
    long = "é" * 3000
    got = value(sql_text.sql_normalize, long)
    assert len(got.encode()) <= 4000 and got == "é" * 2000
    assert value(sql_text.sql_normalize, "a" + long) == "a" + "é" * 1999


def test_sql_pattern(value):
    got = value(
        sql_text.sql_pattern, "SELECT * FROM u WHERE id = 5 /* c */", "SELECT * FROM u WHERE id IN (1,2, 3)", "x = '01234567-89ab-cdef-0123-456789abcdef' AND y = TRUE",
        "ip 10.0.0.1 mail a.b@c.org url https://x.y/z?q=1", "WHERE id IN (SELECT id FROM t WHERE a = 1)", "q" * 1200)
    assert got[0] == "SELECT * FROM u WHERE id = ?"
    assert got[1] == "SELECT * FROM u WHERE id IN (?)"
    assert got[2] == "x = ? AND y = ?"
    assert got[3] == "ip ? mail ? url ?"
    assert got[4] == "WHERE id IN (?)"
    assert got[5] == "q" * 1000 + "…"


def test_infrastructure(value):
    assert value(sql_text.is_infrastructure, "SELECT 1 FROM solid_queue_jobs", "select * from PG_CLASS", "SELECT 1 FROM users", None) == [True, True, False, False]


def test_long_lists(value):
    assert value(sql_text.collapse_in_lists, "a IN (1, 2) b IN (1,2,3,4,5,6,7,8,9) c") == "a IN (1, 2) b IN (1, 2, 3, … 9 values …) c"


def test_levels(value):
    assert value(log_text.level_from_name, "WARNING", "Error", "panic", "", None, "what") == [3, 4, 5, None, None, None]
    assert value(log_text.level_from_number, "1", "5", "9", "13", "17", "21", "24", "0", "25") == [0, 1, 2, 3, 4, 5, 5, None, None]


def test_ids(value):
    hexed = "0123456789ABCDEF0123456789abcdef"
    import base64

    encoded = base64.b64encode(bytes.fromhex(hexed)).decode()
    assert value(lambda c: log_text.normalize_id(c, 32), hexed, encoded, "abc", None) == [hexed.lower(), hexed.lower(), None, None]
    body = "SELECT 1 /*traceparent='00-0123456789abcdef0123456789abcdef-0123456789abcdef-01'*/"
    assert value(lambda c: log_text.traceparent(c, 2), body, "none") == ["0123456789abcdef", None]


@pytest.mark.parametrize(("query", "text", "found"), [
    ("hello WORLD", "World, hello!", True), ("hello world", "hello", False), ("status:422", "status 422", True), ("status:422", "422 status", False),
    ("user_id", "the user id", True), ("user_id", "user x id", False), ("café", "CAFE noir", True), ("01234567-89ab-4def-8123-456789abcdef", "id 0123456789ab4def8123456789abcdef", True),
    ("!!! ...", "anything", True), ("", "anything", True), (None, "anything", True), ("hell", "hello", False),
])
def test_full_text(value, query, text, found):
    assert value(lambda c: log_text.fts_match([c], query), text) is found


def test_full_text_terms_may_stand_in_several_columns(spark):
    rows = spark.createDataFrame([("alpha", "beta gamma"), ("alpha beta", None)], "a string, b string")
    match = lambda q: [r[0] for r in rows.select(log_text.fts_match([F.col("a"), F.col("b")], q)).collect()]
    assert match("alpha beta") == [True, True]
    assert match("alpha:beta") == [False, True]


def test_body_structure(value):
    got = value(log_text.body_structure, "duration: 12.5 ms  statement: SELECT 1 /* app='x',job='y' */", "plain")
    assert (got[0]["duration_ms"], got[0]["statement"], got[0]["tags"]) == (12.5, "SELECT 1", {"app": "x", "job": "y"})
    assert (got[1]["duration_ms"], got[1]["statement"], got[1]["message"]) == (None, None, "plain")


def test_query_params(value):
    assert value(scalars.query_params, "http://h/p?a=1&b=x%20y&a=2#f", "http://h/p") == [{"b": "x y", "a": "2"}, None]


def test_dsn(value):
    got = value(scalars.dsn_parts, "https://key@host.io/42", "nonsense")
    assert (got[0]["public_key"], got[0]["host"], got[0]["project"], got[1]["host"]) == ("key", "host.io", "42", None)


def test_span_class(value):
    assert value(scalars.span_class, "db.sql", "http.client", "template.render", "cache.get", "queue.task", "dbx", "other") == ["db", "http", "view", "cache", "queue", "other", "other"]


def test_cron():
    from datetime import datetime

    after = datetime(2024, 3, 8, 10, 7)
    assert cron_next("*/15 * * * *", after) == datetime(2024, 3, 8, 10, 15)
    assert cron_next("0 9 * * mon-fri", after) == datetime(2024, 3, 11, 9)
    assert cron_next("0 0 13 * 5", after) == datetime(2024, 3, 13)
    assert cron_next("@monthly", after) == datetime(2024, 4, 1)
    assert cron_next("0 2 * * *", after, "America/New_York") == datetime(2024, 3, 9, 7)
    assert cron_next("0 12 * * *", datetime(2024, 3, 10, 0), "America/New_York") == datetime(2024, 3, 10, 16)
    assert cron_next("61 * * * *", after) is None and cron_next("nope", after) is None


@pytest.mark.parametrize(("sql", "normal"), [
    ("SELECT 'a /* secret */ b' /* tag */", "SELECT ? /* tag */"), ("SELECT 1 \u0001 2 /* t */", "SELECT ? \u0001 ? /* t */"), ("/* it's */ SELECT 'x' /* isn't */", "/* it's */ SELECT ? /* isn't */"),
    ("a IN (1, 2) AND b IN ( 'x' , 'y', 3 )", "a IN (?) AND b IN (?)"), ("/*a=1*/ SELECT 'x'  /*b  2*/ WHERE id = 7 /*c=3*/", "/*a=1*/ SELECT ? /*b  2*/ WHERE id = ? /*c=3*/"), ("SELECT 'it''s', 'q\\'z' , col1 FROM t2", "SELECT ?, ? , col1 FROM t2"),
    ("  SELECT -1.5e-3  ", "SELECT ?"), ("SELECT 'open", "SELECT 'open"), ("WHERE a = 'secret''x AND b", "WHERE a = ?'x AND b"), ("'''", "?'"), ("'a''b''c 5", "?'c ?"), ("'a''b' AND 'c''", "? AND ?'"), ("'a\\''b", "?b"), ("'a''b\\", "?'b\\"), ("", ""), (None, None), ("/* open 5", "/* open ?"),
])
def test_one_scan_normalises(spark, sql, normal):
    from sparkscope.functions.sql_text import sql_normalize

    assert spark.createDataFrame([(sql,)], "s string").select(sql_normalize(F.col("s"))).first()[0] == normal


def test_a_long_literal_is_scanned(spark):
    from sparkscope.functions.sql_text import sql_normalize

    cut = "SELECT '" + "it''s \\' /* " * 200_000
    assert spark.createDataFrame([(cut,)], "s string").select(sql_normalize(F.col("s"))).first()[0].startswith("SELECT ?'s")
    sql = "SELECT '" + "it''s \\' /* " * 200_000 + "' /* t */"
    assert spark.createDataFrame([(sql,)], "s string").select(sql_normalize(F.col("s"))).first()[0] == "SELECT ? /* t */"


@pytest.mark.parametrize("name, most", [("sql_pattern", 1), ("sql_normalize", 2)])
def test_a_text_is_computed_once_for_each_scan(spark, name, most):
    from sparkscope.functions import sql_text

    plan = spark.range(1).select(getattr(sql_text, name)(F.concat(F.lit("marker"), F.col("id").cast("string"))).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert 1 <= plan.count("marker") <= most


def test_values_of_a_query_in_one_scan(spark):
    from sparkscope.functions.sql_text import sql_pattern

    asked = {"a@b.co TRUE -5 x1 1.2.3.4": "? ? ? x1 ?", "IN (1, 2) in(?)": "IN (?) IN (?)", "http://h/1?q=2  'x'\n\n7": "? ? ?", "%a-b@ 12": "%a-b@ ?", "a /* 1 */ b": "a b"}
    rows = spark.createDataFrame([(k,) for k in asked], "s string")
    assert {r["s"]: r["p"] for r in rows.select("s", sql_pattern(F.col("s")).alias("p")).collect()} == asked
