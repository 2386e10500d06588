"""Logical tables over the driver's star schema, so that every operator has data at each scale."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Events whose envelopes are made and read by one task.
PART_ROWS = 50_000
#: Lines whose queries are told apart by one task.
QUERY_ROWS = 200_000
SPAN_TYPE = "array<struct<op:string,description:string,start_timestamp:double,timestamp:double>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_transactions(table(spark, sf_dir, "events"))


def _as_transactions(events: DataFrame) -> DataFrame:
    user, event, whole = F.col("user_id"), F.col("event_id"), lambda k: F.floor(F.col("value") * k).cast("int")
    return events.select(
        event.alias("id"),
        event.cast("string").alias("transaction_id"),
        (user % 5).cast("int").alias("project_id"),
        F.col("event_type").alias("transaction_name"),
        F.when(user % 4 == 0, "staging").when(user % 4 == 1, F.lit(None)).otherwise("production").alias("environment"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        whole(10).alias("duration"),
        F.when(event % 3 != 0, whole(4)).alias("db_time"),
        F.when(event % 5 != 0, whole(1)).alias("view_time"),
        (event % 17).cast("int").alias("query_count"),
        (event % 11 == 0).alias("has_n_plus_one"),
        F.when(event % 22 == 0, whole(1)).alias("n_plus_one_time"),
        F.when(F.col("event_type") == "error", "500").when(event % 13 == 0, "404").otherwise("200").alias("http_status"),
        F.concat(F.lit("v"), (event % 3).cast("string")).alias("release"),
        F.concat(F.lit('{"k":"'), (event % 100).cast("string"), F.lit('"}')).alias("tags"),
        F.concat(F.lit("t"), user.cast("string"), F.lit("-"), F.floor(event / 10).cast("string")).alias("trace_id"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    rows = table(spark, sf_dir, "events").filter(kind.isin("error", "signup"))
    return rows.select(
        F.col("event_id").alias("id"),
        F.col("event_id").cast("string").alias("event_id"),
        (user % 5).cast("int").alias("project_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        kind.alias("exception_type"),
        F.concat_ws("", kind, F.lit(" at "), (F.col("event_id") % 9).cast("string")).alias("exception_value"),
        F.concat(kind, F.lit("::f"), (user % 7).cast("string"), F.lit(".rb::"), (user % 3).cast("string")).alias("fingerprint"),
        F.when(user % 4 == 0, "staging").when(user % 4 == 1, F.lit(None)).otherwise("production").alias("environment"),
        F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string")).alias("release"),
        F.concat(F.lit("t"), user.cast("string"), F.lit("-"), F.floor(F.col("event_id") / 10).cast("string")).alias("trace_id"),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("root_ts"))
    op = F.when(F.col("l_returnflag") == "A", "db.sql.active_record").when(F.col("l_returnflag") == "N", "http.client").otherwise("view.render")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_linenumber").alias("sequence"),
        op.alias("op"),
        F.concat(F.lit("SELECT "), F.col("l_linestatus"), F.lit(" "), (F.col("l_suppkey") % 2).cast("string")).alias("description"),
        F.floor(F.col("l_quantity") * 10).cast("int").alias("duration_ms"),
    )
    return lines.join(orders, lines["transaction_id"] == orders["o_orderkey"]).drop("o_orderkey")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    # One log per document; the texts are whole.
    return table(spark, sf_dir, "documents").select(
        doc.alias("id"),
        (doc % 5).cast("int").alias("project_id"),
        F.timestamp_seconds(F.lit(1704067200) + doc * 60).alias("timestamp"),
        (doc % 6).cast("int").alias("level"),
        F.col("text").alias("body"),
        F.col("source").alias("service"),
        F.col("lang").alias("environment"),
        (doc % 1000).cast("double").alias("duration_ms"),
        F.concat(F.lit("status "), (doc % 7).cast("string"), F.lit(" user_id "), (doc % 50).cast("string")).alias("attrs_text"),
        F.concat(F.lit("t"), (doc % 200).cast("string"), F.lit("-"), F.floor(doc / 10).cast("string")).alias("trace_id"),
    )


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("trace_id"), F.col("turn").alias("sequence"), F.col("role").alias("logger_name"), F.length("text").cast("long").alias("body_chars"))


def projects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"project-{i}", f"Project {i}", f"key{i}", True) for i in range(5)], "id int, slug string, name string, public_key string, active boolean")


def monitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One interval monitor for each user id, its check-ins being the user's events."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.groupBy(F.col("user_id").alias("monitor_id")).agg(F.max("ts").alias("last_checkin_at"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_event")).select(
        "monitor_id", (F.col("monitor_id") % 5).cast("int").alias("project_id"), F.concat(F.lit("job-"), F.col("monitor_id").cast("string")).alias("slug"),
        F.lit("interval").alias("schedule_type"), (F.col("monitor_id") % 6 + 1).cast("string").alias("schedule_value"),
        F.when(F.col("monitor_id") % 2 == 0, "hour").otherwise("day").alias("schedule_unit"), (F.col("monitor_id") % 3 * 30).cast("int").alias("checkin_margin"),
        F.lit(30).alias("max_runtime"), F.when(F.col("last_event") == "error", "error").when(F.col("last_event") == "view", "in_progress").otherwise("ok").alias("last_status"), "last_checkin_at",
        F.when(F.col("last_event") == "view", F.col("last_checkin_at")).alias("in_progress_since"), F.lit("unknown").alias("state"), F.lit(None).cast("string").alias("timezone"))


def as_of(spark: SparkSession, sf_dir: str) -> datetime:
    """The newest event, which every window of the registered queries ends with."""
    return table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("t")).first()["t"]


def _queries() -> Column:
    """Breadcrumbs of a transaction: up to six queries of one shape, for every third five times the same one, for every fourth
    one of the infrastructure's, and one that is no query."""
    each = lambda n, sql: F.transform(F.filter(F.sequence(F.lit(0), n), lambda j: j > 0), lambda j: F.struct(F.lit("sql.active_record").alias("category"), F.struct(sql(j).alias("sql")).alias("data")))
    no_query = F.array(F.struct(F.lit("http").alias("category"), F.struct(F.lit("SELECT 1").alias("sql")).alias("data")))
    event = F.col("id")
    return F.concat(
        no_query, each((event % 7).cast("int"), lambda j: F.concat(F.lit("SELECT * FROM parts WHERE id = "), (event + j).cast("string"))),
        each(F.when(event % 3 == 0, 5).otherwise(0), lambda j: F.lit("SELECT name FROM users WHERE name = 'x'")), each(F.when(event % 4 == 0, 1).otherwise(0), lambda j: F.lit("SELECT * FROM solid_queue_jobs")))


def _payload_spans() -> Column:
    """Spans of every second transaction: a quarter of a second for each of its queries, for every sixth half a second for the
    one that repeats, and the view's eighth."""
    span = lambda op, text, begin, length: F.struct(F.lit(op).alias("op"), F.lit(text).alias("description"), begin.cast("double").alias("start_timestamp"), (begin + length).cast("double").alias("timestamp"))
    event = F.col("id")
    queries = F.transform(F.filter(F.sequence(F.lit(0), (event % 7).cast("int")), lambda j: j > 0), lambda j: span("db.sql.active_record", "SELECT * FROM parts WHERE id = 5", j.cast("double"), 0.25))
    again = F.when(event % 6 == 0, F.array(span("db.query", "SELECT name FROM users WHERE name = 'q'", F.lit(1.0), 0.5))).otherwise(F.array())
    view = F.array(span("view.process_action.action_controller", "show", F.lit(0.0), 0.125))
    return F.when(event % 2 == 0, F.concat(queries, again.cast(SPAN_TYPE), view))


def _spread(rows: DataFrame) -> DataFrame:
    """Rows in parts that do not grow with their number, as each becomes some kilobytes, however few files they come from."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_ROWS))
    return rows.repartition(parts, "event_id")


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One envelope for each event: its transaction, for every fourth an error beside it, and for some what is to be dropped.

    Every tenth transaction has no measurements, so that its spans tell its times.
    """
    # Events move before they become transactions, by the columns that these are made of.
    events = _spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value"))
    t = _as_transactions(events).withColumn("begin", F.unix_micros("timestamp") / 1e6)
    trace = F.struct(F.col("trace_id"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("span_id"), F.lit("http.server").alias("op"))
    measured = F.when(F.col("id") % 10 != 2, F.struct(F.struct(F.col("db_time").alias("value")).alias("db"), F.struct(F.col("view_time").alias("value")).alias("view")))
    payload = F.to_json(F.struct(
        F.col("transaction_id").alias("event_id"), F.when(F.col("id") % 31 == 0, F.concat(F.lit("SolidCable::"), "transaction_name")).otherwise(F.col("transaction_name")).alias("transaction"),
        F.col("begin").alias("start_timestamp"), (F.col("begin") + F.col("duration") / 1000.0).alias("timestamp"), "environment", "release",
        F.struct(trace.alias("trace"), F.struct(F.col("http_status").alias("status_code")).alias("response")).alias("contexts"),
        measured.alias("measurements"), F.struct(_queries().alias("values")).alias("breadcrumbs"), _payload_spans().alias("spans")))
    error = F.to_json(F.struct(
        F.concat(F.lit("e"), F.col("transaction_id")).alias("event_id"), F.col("begin").alias("timestamp"), "environment", "release",
        F.when(F.col("id") % 3 == 0, F.struct(F.struct(F.col("trace_id")).alias("trace"), F.struct(F.lit("ruby").alias("name")).alias("runtime"))).alias("contexts"),
        F.create_map(F.lit("k"), (F.col("id") % 100).cast("string")).alias("tags"), F.struct(F.transform(F.sequence(F.lit(1), (F.col("id") % 13 + 1).cast("int")), lambda j: F.struct(F.lit("log").alias("category"), F.concat(F.lit("m"), j.cast("string")).alias("message"))).alias("values")).alias("breadcrumbs"),
        F.struct(F.array(F.struct(F.col("transaction_name").alias("type"), F.concat(F.lit("value "), (F.col("id") % 9).cast("string")).alias("value"),
                                  F.struct(F.array(F.struct(F.concat(F.lit("f"), (F.col("id") % 7).cast("string"), F.lit(".rb")).alias("filename"), (F.col("id") % 3).alias("lineno"))).alias("frames")).alias("stacktrace"))).alias("values")).alias("exception")))
    newline = "\n"
    head = F.when(F.col("id") % 37 == 0, F.lit("no json")).otherwise(F.lit("{}"))
    sized = F.concat(F.lit('{"type":"transaction","length":'), F.octet_length(payload).cast("string"), F.lit("}"))
    body = F.concat_ws(newline, head, sized, payload, F.when(F.col("id") % 4 == 0, F.concat(F.lit('{"type":"event"}' + newline), error)), F.when(F.col("id") % 5 == 0, F.lit('{"type":"session"}' + newline + '{"sid":1}')))
    return t.select("project_id", F.col("timestamp").alias("received_at"), body.alias("body"))


def log_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log items of two records each: one for every two neighbouring documents."""
    rows = logs(spark, sf_dir).withColumn("item", F.floor(F.col("id") / 2))
    attribute = lambda c: F.struct(F.col(c).alias("value"))
    record = F.struct((F.unix_micros("timestamp") / 1e6).alias("timestamp"), F.element_at(F.array(*[F.lit(x) for x in ("trace", "debug", "info", "warning", "error", "fatal")]), F.col("level") + 1).alias("level"),
                      "body", "trace_id", F.struct(attribute("service").alias("service.name"), attribute("environment").alias("sentry.environment"), attribute("duration_ms").alias("duration_ms")).alias("attributes"))
    items = rows.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("id", record.alias("r")))).alias("all"))
    return items.select(F.lit(0).alias("project_id"), F.timestamp_seconds(F.lit(0)).alias("received_at"), F.to_json(F.struct(F.transform("all", lambda x: x["r"]).alias("items"))).alias("payload"))


def otlp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTLP payloads: one resource and scope for each source of documents in a range of a hundred, a record for each document."""
    rows = logs(spark, sf_dir).withColumn("item", F.floor(F.col("id") / 100))
    pair = lambda key, value: F.struct(F.lit(key).alias("key"), F.struct(F.col(value).cast("string").alias("stringValue")).alias("value"))
    record = F.struct((F.unix_micros("timestamp") * 1000).cast("string").alias("timeUnixNano"), (F.col("level") * 4 + 1).alias("severityNumber"), F.struct(F.col("body").alias("stringValue")).alias("body"),
                      F.md5(F.col("trace_id")).alias("traceId"), F.array(pair("duration_ms", "duration_ms")).alias("attributes"))
    grouped = rows.groupBy("item", "service", "environment").agg(F.array_sort(F.collect_list(F.struct("id", record.alias("r")))).alias("all"))
    resource = F.struct(F.struct(F.array(pair("service.name", "service"), pair("deployment.environment", "environment")).alias("attributes")).alias("resource"),
                        F.array(F.struct(F.struct(F.lit("scope").alias("name")).alias("scope"), F.transform("all", lambda x: x["r"]).alias("logRecords"))).alias("scopeLogs"))
    return grouped.select(F.lit(0).alias("project_id"), F.timestamp_seconds(F.lit(0)).alias("received_at"), F.to_json(F.struct(F.array(resource).alias("resourceLogs"))).alias("payload"))


def span_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, their lines as spans: each hangs below its predecessor or, for every third, below the root."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))).alias("lines"))
    name = lambda n: F.concat(F.lit("s"), n.cast("string"))
    parent = lambda x, i: F.when((i == 0) | (x["l_partkey"] % 3 == 0), F.lit("root")).otherwise(name(F.get("lines", i - 1)["l_linenumber"]))
    span = lambda x, i: F.struct(name(x["l_linenumber"]).alias("span_id"), parent(x, i).alias("parent_span_id"), F.lit("db").alias("op"), F.concat(F.lit("SELECT "), (x["l_suppkey"] % 2).cast("string")).alias("description"), (x["l_linenumber"] * 10.0).alias("start_timestamp"), (x["l_linenumber"] * 10.0 + x["l_quantity"] / 100).alias("timestamp"))
    return lines.select(F.lit(0).alias("project_id"), F.col("l_orderkey").alias("transaction_id"), F.lit("root").alias("root_span_id"), F.lit("http.server").alias("op"), F.lit("order").alias("transaction_name"), F.lit(0.0).alias("start_timestamp"), F.lit(100.0).alias("end_timestamp"), F.transform("lines", span).alias("spans"))


#: Statements of breadcrumbs by line number, ``{part}`` and ``{qty}`` being the line's own: what looks like a comment in a
#: literal and like a literal in a comment, several comments, escapes, lists, identifiers with digits, unfinished literals, one of them with a doubled quote.
STATEMENTS = (
    "SELECT * FROM parts WHERE name = 'p{part}' AND id = {part}",
    "SELECT 'a /* secret {part} */ b'  , col1 FROM\tt9 WHERE price > -{qty}.50 /* tag: it's {qty} */",
    "/* a=1 */ SELECT 'it''s {part}' /*b=2*/ WHERE id IN ({part}, 2,  3) AND \u0001 < 1.5e3 /* c=3 */",
    "INSERT INTO \"t1\" VALUES (TRUE, 'x\\'y {part}', \"q1\", 10.0.0.{qty}, me{part}@x.org, http://h/{part}?q=1 , 'o''pen {part}",
    "SELECT * FROM parts WHERE id IN ({part}, 2, 3) /* app:x */",
    "SELECT * FROM solid_queue_jobs WHERE id = {part} AND note = 'cut",
    "  ",
)


def breadcrumbs(spark: SparkSession, sf_dir: str, gathered: bool = False) -> DataFrame:
    """Order lines as the queries of their order; ``gathered``, those of an order lie in one part, and parts do not grow with the lines.

    Lines move before they become texts, and what groups by the order and more need not move them again.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    if gathered:
        lines = lines.repartition(max(spark.sparkContext.defaultParallelism, -(-lines.count() // QUERY_ROWS)), "l_orderkey")
    own = {"{part}": (F.col("l_partkey") % 50).cast("string"), "{qty}": F.col("l_quantity").cast("int").cast("string")}
    sql = F.element_at(F.array(*[F.lit(x) for x in STATEMENTS]), F.col("l_linenumber"))
    for mark, value in own.items():
        sql = F.replace(sql, F.lit(mark), value)
    return lines.select(F.col("l_orderkey").alias("transaction_id"), F.col("l_linenumber").alias("pos"), F.lit("sql.active_record").alias("category"), sql.alias("sql"))
