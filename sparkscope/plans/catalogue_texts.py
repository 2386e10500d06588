"""Registered queries over small derived texts and values: log bodies, lists, labels, urls, times, details, flags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import log_text, scalars, sql_text
from ..operators import issues, spans
from ..sources import payloads, views
from .catalogue import _issues, _routed, register, sec
from .oracle import query



@register("log_body_structure", query(
    f"""SELECT id, CASE WHEN id % 3 = 0 THEN CAST(id % 1000 AS DOUBLE) + 0.5 END AS duration_ms, CASE id % 3 WHEN 0 THEN concat('SELECT ', CAST(id AS VARCHAR)) WHEN 1 THEN concat('plain ', CAST(id AS VARCHAR)) ELSE CASE WHEN id % 2 = 0 THEN '' ELSE concat('/* no tag */ body ', CAST(id AS VARCHAR)) END END AS message,
    CASE WHEN id % 2 = 0 THEN concat('show', CAST(id % 5 AS VARCHAR)) END AS action FROM logs""", "logs"))  # fmt: skip
def log_body_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A database's duration lines in several forms, plain bodies, trailing tags, and a comment before them, from which on
    all counts as the tags' comment."""
    n, i = F.col("id").cast("string"), F.col("id")
    form = F.when(i % 6 == 0, "statement: ").when(i % 6 == 3, "execute a1: ").otherwise("")
    body = F.when(i % 3 == 0, F.concat(F.lit("duration: "), (i % 1000).cast("string"), F.lit(".5 ms  "), form, F.lit("SELECT "), n)).when(i % 3 == 1, F.concat(F.lit("plain "), n)).otherwise(F.concat(F.lit("/* no tag */ body "), n))
    tagged = F.when(i % 2 == 0, F.concat(body, F.lit(" /* action='show"), (i % 5).cast("string"), F.lit("',application='a' */"))).otherwise(body)
    read = views.logs(spark, sf_dir).select("id", log_text.body_structure(tagged).alias("b"))
    return read.select("id", "b.duration_ms", "b.message", F.try_element_at("b.tags", F.lit("action")).alias("action"))


@register("log_identifiers", query(
    f"""SELECT id, CASE WHEN id % 2 = 0 THEN md5(CAST(id AS VARCHAR)) END AS parent, CASE WHEN id % 2 = 0 THEN substr(md5(CAST(id AS VARCHAR)), 1, 16) END AS span, concat('req ', md5(CAST(id AS VARCHAR)), ' and a-b') AS collapsed,
    CASE id % 4 WHEN 0 THEN CAST(id AS DOUBLE) + 0.25 WHEN 1 THEN CAST(id AS DOUBLE) END AS number FROM logs""", "logs"))  # fmt: skip
def log_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UUIDs as one token, the traceparent comment's ids, numbers or null."""
    i, digest = F.col("id"), F.md5(F.col("id").cast("string"))
    cut = lambda a, n: F.substring(digest, a, n)
    named = F.concat_ws("-", cut(1, 8), cut(9, 4), cut(13, 4), cut(17, 4), cut(21, 12))
    body = F.when(i % 2 == 0, F.concat(F.lit("x /* traceparent='00-"), digest, F.lit("-"), cut(1, 16), F.lit("-01' */"))).otherwise(F.lit("x traceparent=00-zz"))
    number = F.when(i % 4 == 0, F.concat(i.cast("string"), F.lit(".25"))).when(i % 4 == 1, i.cast("string")).when(i % 4 == 2, F.lit("fast"))
    return views.logs(spark, sf_dir).select("id", log_text.traceparent(body, 1).alias("parent"), log_text.traceparent(body, 2).alias("span"), log_text.collapse_uuids(F.concat(F.lit("req "), F.upper(named), F.lit(" and a-b"))).alias("collapsed_upper"), number.try_cast("double").alias("number")).select("id", "parent", "span", F.lower("collapsed_upper").alias("collapsed"), "number")


@register("collapsed_lists", query(
    """SELECT id, concat('a ', CASE WHEN id % 12 + 1 > 8 THEN concat('IN (0, 1, 2, … ', CAST(id % 12 + 1 AS VARCHAR), ' values …)') ELSE concat('in ( ', array_to_string(range(id % 12 + 1), ' , '), ')') END, ' AND b IN (SELECT 1)') AS short FROM txn""", "txn"))  # fmt: skip
def collapsed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I16: lists of one to twelve items, and a subquery."""
    items = F.array_join(F.sequence(F.lit(0), (F.col("id") % 12).cast("int")), " , ")
    return views.transactions(spark, sf_dir).select("id", sql_text.collapse_in_lists(F.concat(F.lit("a in ( "), items, F.lit(") AND b IN (SELECT 1)"))).alias("short"))


@register("release_labels", query(
    """SELECT id, CASE id % 4 WHEN 0 THEN concat(strftime(timestamp, '%b %-d %H:%M'), ' · ', substr(md5(CAST(id AS VARCHAR)), 1, 7)) WHEN 1 THEN concat('v', CAST(id AS VARCHAR)) WHEN 2 THEN concat(substr(md5(CAST(id AS VARCHAR)), 1, 17), '...') END AS label FROM txn""", "txn"))  # fmt: skip
def release_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with a hash, short names, long ones and blanks."""
    i, digest = F.col("id"), F.md5(F.col("id").cast("string"))
    release = F.when(i % 4 == 0, F.concat(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-"), digest)).when(i % 4 == 1, F.concat(F.lit("v"), i.cast("string"))).when(i % 4 == 2, F.concat(digest, F.lit("x"))).otherwise(F.lit(" "))
    return views.transactions(spark, sf_dir).select("id", scalars.release_label(release).alias("label"))


@register("url_params", query("SELECT id, CAST(id % 10 AS VARCHAR) AS page, CASE WHEN id % 2 = 0 THEN 'a b&c' END AS q, CASE WHEN id % 3 = 0 THEN '' END AS flag FROM txn", "txn"))
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded values, repeated names (the last counts), names without a value, fragments."""
    i = F.col("id")
    url = F.concat(F.lit("https://h/p?page=x&page="), (i % 10).cast("string"), F.when(i % 2 == 0, "&q=a+b%26c").otherwise(""), F.when(i % 3 == 0, "&flag").otherwise(""), F.lit("#q=z"))
    m = views.transactions(spark, sf_dir).select("id", scalars.query_params(url).alias("m"))
    return m.select("id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("page", "q", "flag")])


@register("span_times", query(
    """SELECT id, CASE WHEN id % 5 > 0 THEN CAST(duration AS BIGINT) END AS ms, CASE id % 7 WHEN 0 THEN 'db' WHEN 1 THEN 'http' WHEN 2 THEN 'view' WHEN 3 THEN 'view' WHEN 4 THEN 'cache' WHEN 5 THEN 'queue' ELSE 'other' END AS class FROM txn""", "txn"))  # fmt: skip
def span_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I20, I21."""
    i = F.col("id")
    end = F.when(i % 5 > 0, F.timestamp_micros(F.unix_micros("timestamp") + F.col("duration") * 1000 + 400))
    op = F.element_at(F.array(*[F.lit(x) for x in ("db.sql.query", "http.client", "template.render", "view.show", "cache.get", "queue.process", "database")]), (i % 7 + 1).cast("int"))
    return views.transactions(spark, sf_dir).select("id", scalars.span_duration_ms(F.col("timestamp"), end).alias("ms"), scalars.span_class(op).alias("class"))


@register("event_details", query(
    """SELECT concat('e', transaction_id) AS event_id, CAST(id % 100 AS VARCHAR) AS k, CAST(least(id % 13 + 1, 10) AS INTEGER) AS breadcrumbs, concat('m', CAST(id % 13 + 1 AS VARCHAR)) AS last_message, concat('f', CAST(id % 7 AS VARCHAR), '.rb') AS inner_file,
    CASE WHEN id % 3 = 0 THEN 'ruby' END AS runtime FROM txn WHERE id % 37 <> 0 AND id % 4 = 0""", "txn"))  # fmt: skip
def event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from stored payloads."""
    read = payloads.event_details(payloads.event_rows(_routed(spark, sf_dir).filter("sink = 'events'")))
    crumbs = F.col("breadcrumbs")
    return read.select("event_id", F.try_element_at("tags", F.lit("k")).alias("k"), F.size(crumbs).alias("breadcrumbs"), F.try_element_at(crumbs, F.lit(-1))["message"].alias("last_message"), F.get("frames", F.lit(0))["filename"].alias("inner_file"),
                       F.get_json_object(F.try_element_at("contexts", F.lit("runtime")), "$.name").alias("runtime"))


@register("display_attributes", query("SELECT source, service, environment, CAST(id % 1000 AS DOUBLE) AS duration_ms FROM logs, (VALUES ('sentry'), ('otlp')) v(source) WHERE source = 'sentry' UNION ALL SELECT 'otlp', NULL, NULL, CAST(id % 1000 AS DOUBLE) FROM logs", "logs"))
def display_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of both kinds of log as one flat map."""
    def read(rows: DataFrame) -> DataFrame:
        m = rows.select("source", payloads.display_attributes(F.col("payload")).alias("m"))
        of = lambda k: F.try_element_at("m", F.lit(k))
        return m.select("source", of("service.name").alias("service"), of("sentry.environment").alias("environment"), of("duration_ms").try_cast("double").alias("duration_ms"))

    return read(payloads.log_rows(views.log_items(spark, sf_dir))).unionByName(read(payloads.otlp_rows(views.otlp_items(spark, sf_dir))))


@register("dsn_parts", query("SELECT id, CASE WHEN id % 3 = 0 THEN NULL WHEN id % 2 = 0 THEN 'https' ELSE 'http' END AS scheme, CASE WHEN id % 3 > 0 THEN concat('key', CAST(id AS VARCHAR)) END AS public_key, CASE WHEN id % 3 > 0 THEN 'host:9000' END AS host, CASE WHEN id % 3 > 0 THEN CAST(id % 5 AS VARCHAR) END AS project FROM txn", "txn"))
def dsn_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With and without a secret, and texts that are none."""
    i = F.col("id")
    dsn = F.when(i % 3 == 0, "key@host/1").otherwise(F.concat(F.when(i % 2 == 0, "https").otherwise("http"), F.lit("://key"), i.cast("string"), F.when(i % 5 == 0, ":secret").otherwise(""), F.lit("@host:9000/"), (i % 5).cast("string")))
    return views.transactions(spark, sf_dir).select("id", scalars.dsn_parts(dsn).alias("d")).select("id", "d.*")


@register("stored_patterns", query("SELECT id, CAST(CASE WHEN id % 6 > 3 THEN 1 ELSE 0 END + 1 AS INTEGER) AS flagged, CAST(2 AS INTEGER) AS patterns FROM txn", "txn"))
def stored_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats derived from a stored map of counts."""
    held = F.create_map(F.lit("SELECT ?"), (F.col("id") % 6).cast("int"), F.lit("UPDATE ?"), F.lit(4))
    return views.transactions(spark, sf_dir).select("id", F.size(spans.flagged_patterns(held)).alias("flagged"), F.size(held).alias("patterns"))


@register("bursting_issues", query("SELECT project_id, fingerprint, status = 0 AND s.last_seen > as_of - INTERVAL 1 HOUR AS bursting FROM status s, span_of_time", "status", "span_of_time"))
def bursting_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event stands for the last burst."""
    return _issues(spark, sf_dir).select("project_id", "fingerprint", issues.is_bursting(F.col("status"), F.col("last_seen"), views.as_of(spark, sf_dir)).alias("bursting"))


@register("pattern_times", query(
    f"""SELECT transaction_id, pattern, count, distinct_count, total_time_ms FROM (
      SELECT id, transaction_id, 'SELECT * FROM parts WHERE id = ?' AS pattern, id % 7 AS count, id % 7 AS distinct_count, CASE WHEN id % 2 = 0 THEN CAST(id % 7 * 250 AS DOUBLE) END AS total_time_ms FROM txn WHERE id % 7 > 0
      UNION ALL SELECT id, transaction_id, 'SELECT name FROM users WHERE name = ?', 5, 1, CASE WHEN id % 6 = 0 THEN 500.0 END FROM txn WHERE id % 3 = 0) WHERE id % 37 <> 0 AND id % 31 <> 0""", "txn"))  # fmt: skip
def pattern_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The time of the spans of each shape, and whether a repeated shape is one text again and again."""
    rows = payloads.transaction_rows(_routed(spark, sf_dir).filter("sink = 'transactions'"))
    found = spans.patterns_of_rows(rows, payloads.TRANSACTION_KEYS)
    return found.select("transaction_id", "pattern", "count", "distinct_count", "total_time_ms")
