"""Payloads to rows: events (A11), transactions (A10), logs (A6–A8), check-ins (A12), times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.log_text import attrs_text, level_from_name, level_from_number, normalize_id, traceparent
from ..functions.sql_text import REPEAT_THRESHOLD, is_infrastructure, once, sql_pattern
from ..operators.issues import fingerprint
from ..operators.spans import QUERY_CATEGORY, SPAN_CAP, timing

SPANS = "array<struct<span_id:string,parent_span_id:string,trace_id:string,op:string,status:string,description:string,start_timestamp:double,timestamp:double>>"
CRUMBS = "array<struct<category:string,message:string,level:string,data:struct<sql:string>>>"
TRANSACTION = f"struct<spans:{SPANS},breadcrumbs:struct<values:{CRUMBS}>,measurements:map<string,struct<value:double>>>"
TRANSACTION_KEYS = ("project_id", "transaction_id")
BREADCRUMBS = f"struct<breadcrumbs:struct<values:{CRUMBS}>>"
FRAMES = "struct<exception:struct<values:array<struct<type:string,value:string,stacktrace:struct<frames:array<struct<filename:string,function:string,lineno:string,in_app:boolean>>>>>>,fingerprint:array<string>>"
_VALUE = "struct<value:string,stringValue:string,intValue:string,boolValue:string,doubleValue:string>"


def parse_time(text: Column) -> Column:
    """Epoch seconds or a date-time text; null where it is neither."""
    return F.coalesce(F.timestamp_seconds(text.try_cast("double")), F.try_to_timestamp(text))


def _at(json: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(json, path, kind)


def _fields(json: Column, paths: dict[str, str]) -> list[Column]:
    return [_at(json, p).alias(n) for n, p in paths.items()]


def _parsed(items: DataFrame) -> DataFrame:
    """Items with their payload as ``json``, parsed once for all fields."""
    return items.withColumn("json", F.try_parse_json("payload"))


def event_rows(items: DataFrame) -> DataFrame:
    """Routed event items (``project_id, event_id, payload, received_at``) to columns; a bad time is the arrival's."""
    p, items = F.col("json"), _parsed(items)
    parsed = F.from_json("payload", FRAMES)
    first = F.get(parsed["exception"]["values"], F.lit(0))
    last = F.try_element_at(first["stacktrace"]["frames"], F.lit(-1))
    message = F.coalesce(_at(p, "$.message.formatted"), F.when(F.schema_of_variant(_at(p, "$.message", "variant")) == "STRING", _at(p, "$.message")))
    rows = items.select(
        "project_id", "event_id", F.coalesce(parse_time(_at(p, "$.timestamp")), F.col("received_at")).alias("timestamp"),
        *_fields(p, {"platform": "$.platform", "sdk_name": "$.sdk.name", "sdk_version": "$.sdk.version", "environment": "$.environment", "release": "$.release", "server_name": "$.server_name", "transaction_name": "$.transaction", "trace_id": "$.contexts.trace.trace_id"}),
        F.coalesce(_at(p, "$.level"), F.lit("error")).alias("level"), first["type"].alias("exception_type"), first["value"].alias("exception_value"), message.alias("message"),
        parsed["fingerprint"].alias("_declared"), last["filename"].alias("_file"), last["lineno"].alias("_line"), "payload", "received_at")
    return rows.withColumn("fingerprint", F.substring(fingerprint(F.col("_declared"), F.col("exception_type"), F.col("_file"), F.col("_line"), F.col("message")), 1, 1000)).drop("_declared", "_file", "_line")


def event_details(events: DataFrame) -> DataFrame:
    """Tags, user, request, the last ten breadcrumbs and the frames, innermost first, of stored payloads."""
    p = F.col("payload")
    crumbs = F.from_json(p, BREADCRUMBS)["breadcrumbs"]["values"]
    frames = F.get(F.from_json(p, FRAMES)["exception"]["values"], F.lit(0))["stacktrace"]["frames"]
    maps = [F.from_json(F.get_json_object(p, f"$.{n}"), "map<string,string>").alias(n) for n in ("tags", "user", "request", "contexts")]
    last = F.when(F.size(crumbs) > 10, F.slice(crumbs, -10, 10)).otherwise(crumbs)
    return events.select("project_id", "event_id", *maps, last.alias("breadcrumbs"), F.reverse(frames).alias("frames"))


def transaction_rows(items: DataFrame) -> DataFrame:
    """Routed transaction items to columns with their ``spans`` and ``breadcrumbs``; an unreadable duration is 0.

    Span timing stands in for measured times only where the payload has no measurements at all. Fields are read from one
    parsed value, what is nested by one schema. ``with_query_analysis`` adds what the breadcrumbs tell.
    """
    p = F.col("json")
    rows = _parsed(items).withColumn("n", F.from_json("payload", TRANSACTION))
    start, end = parse_time(_at(p, "$.start_timestamp")), parse_time(_at(p, "$.timestamp"))
    spans, measured = F.col("n.spans"), F.col("n.measurements")
    bare = F.coalesce(F.size(measured), F.lit(0)) < 1
    db, view = F.try_element_at(measured, F.lit("db"))["value"], F.try_element_at(measured, F.lit("view"))["value"]
    return rows.select(
        "project_id", F.col("event_id").alias("transaction_id"), F.coalesce(end, F.col("received_at")).alias("timestamp"),
        *_fields(p, {"transaction_name": "$.transaction", "op": "$.contexts.trace.op", "trace_id": "$.contexts.trace.trace_id", "environment": "$.environment", "release": "$.release", "server_name": "$.server_name", "http_method": "$.request.method", "http_status": "$.contexts.response.status_code", "http_url": "$.request.url", "root_span_id": "$.contexts.trace.span_id"}),
        F.coalesce(F.round((F.unix_micros(end) - F.unix_micros(start)) / 1000.0).cast("int"), F.lit(0)).alias("duration"),
        F.coalesce(db.cast("int"), F.when(bare, timing(spans, "db.sql.active_record").cast("int"))).alias("db_time"),
        F.coalesce(view.cast("int"), F.when(bare, timing(spans, "view.process_action.action_controller").cast("int"))).alias("view_time"),
        F.coalesce(F.get_json_object("payload", "$.tags"), F.lit("{}")).alias("tags"), F.map_filter(measured, lambda k, _: ~k.isin("db", "view")).alias("measurements"),
        (F.coalesce(F.size(spans), F.lit(0)) > SPAN_CAP).alias("spans_truncated"), (F.unix_micros(start) / 1e6).alias("start_timestamp"), (F.unix_micros(end) / 1e6).alias("end_timestamp"),
        F.coalesce(spans, F.array().cast(SPANS)).alias("spans"), F.col("n.breadcrumbs.values").alias("breadcrumbs"))


def span_times(transactions: DataFrame) -> DataFrame:
    """One row per payload span, in the form that the query analysis takes; no time where either end is missing."""
    rows = transactions.select(*TRANSACTION_KEYS, F.explode("spans").alias("s"))
    return rows.select(*TRANSACTION_KEYS, "s.op", "s.description", ((F.col("s.timestamp") - F.col("s.start_timestamp")) * 1000).alias("duration_ms"))


def with_query_analysis(transactions: DataFrame) -> DataFrame:
    """Transactions with ``query_count, has_n_plus_one, n_plus_one_time``.

    The time is that of the flagged shapes' spans, null where none of them has any: unknown is not zero. All of it is told by
    the arrays of the row, so nothing moves: sorted, the shapes that repeat too often are those that stand a threshold apart from
    themselves, and only these are looked up among the spans.
    """
    none = F.array().cast("array<string>")
    asked = F.filter("breadcrumbs", lambda b: (b["category"] == QUERY_CATEGORY) & ~is_infrastructure(b["data"]["sql"]))
    rows = transactions.withColumn("_asked", F.transform(asked, lambda b: b["data"]["sql"]))
    rows = rows.withColumn("_shapes", F.array_sort(F.transform(F.filter("_asked", lambda q: F.trim(q) != ""), sql_pattern)))
    apart = F.transform("_shapes", lambda p, i: F.when(F.get("_shapes", i + REPEAT_THRESHOLD) == p, p))
    rows = rows.withColumn("_flagged", F.coalesce(F.array_distinct(F.array_compact(apart)), none))
    timed = F.filter("spans", lambda s: s["op"].startswith("db") & (F.trim(s["description"]) != "") & (s["timestamp"] - s["start_timestamp"]).isNotNull())
    shaped = F.transform(timed, lambda s: F.struct(sql_pattern(s["description"]).alias("p"), ((s["timestamp"] - s["start_timestamp"]) * 1000).alias("ms")))
    rows = rows.withColumn("_timed", F.when(F.size("_flagged") > 0, F.filter(shaped, lambda s: F.array_contains("_flagged", s["p"]))))
    total = lambda values: once(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x)))
    each = F.transform("_flagged", lambda p: F.round(total(F.transform(F.filter("_timed", lambda s: s["p"] == p), lambda s: s["ms"])), 1))
    return rows.withColumns({
        "query_count": F.coalesce(F.size("_asked"), F.lit(0)), "has_n_plus_one": F.size("_flagged") > 0,
        "n_plus_one_time": F.round(total(F.array_compact(each))).cast("int")}).drop("_asked", "_shapes", "_flagged", "_timed")


def breadcrumb_rows(transactions: DataFrame) -> DataFrame:
    """One row per breadcrumb, in the form that the query analysis takes."""
    rows = transactions.select("project_id", "transaction_id", F.posexplode("breadcrumbs").alias("pos", "b"))
    return rows.select("project_id", "transaction_id", "pos", F.col("b.category").alias("category"), F.col("b.data.sql").alias("sql"))


def unwrap(value: Column) -> Column:
    """The scalar of an attribute object (``value``, then the typed OTLP fields), or a bare scalar as text."""
    parsed = F.from_json(value, _VALUE)
    inner = F.coalesce(*[parsed[f] for f in ("value", "stringValue", "intValue", "boolValue", "doubleValue")], F.get_json_object(value, "$.arrayValue"), F.get_json_object(value, "$.kvlistValue"))
    return F.when(F.ltrim(value).startswith("{"), inner).otherwise(value)


def log_rows(items: DataFrame) -> DataFrame:
    """Log items (``project_id, payload, received_at``) to one row per record; payloads without a list give none."""
    records = F.from_json(F.get_json_object("payload", "$.items"), "array<string>")
    rows = items.select("project_id", "received_at", F.posexplode(records).alias("position", "record")).filter(F.ltrim("record").startswith("{"))
    raw = F.from_json(F.get_json_object("record", "$.attributes"), "map<string,string>")
    rows = rows.withColumn("a", F.transform_values(raw, lambda _, v: unwrap(v)))
    attr = lambda k: F.try_element_at("a", F.lit(k))
    text = lambda k: F.get_json_object("record", f"$.{k}")
    return rows.select(
        "project_id", "position", F.coalesce(parse_time(text("timestamp")), F.col("received_at")).alias("timestamp"), level_from_name(text("level")).alias("level"), text("severity_number").try_cast("int").alias("severity_number"),
        F.coalesce(text("body"), F.lit("")).alias("body"), F.coalesce(attr("logger.name"), attr("sentry.logger.name")).alias("logger_name"), F.coalesce(text("trace_id"), attr("sentry.trace.trace_id")).alias("trace_id"),
        F.coalesce(text("span_id"), attr("sentry.trace.parent_span_id")).alias("span_id"), attr("sentry.environment").alias("environment"), attr("sentry.release").alias("release"), F.coalesce(attr("server.address"), attr("sentry.server_name")).alias("server_name"),
        attr("service.name").alias("service"), attr("duration_ms").try_cast("double").alias("duration_ms"), F.lit("sentry").alias("source"), attrs_text(F.col("a")).alias("attrs_text"), F.col("record").alias("payload"))


def _attribute_map(attributes: Column) -> Column:
    """``[{key, value}]`` to a map; the last of equal keys wins, as in the merge of resource and record."""
    known = F.filter(attributes, lambda a: a["key"].isNotNull())
    kind = "array<struct<key:string,value:string>>"
    pairs = F.transform(known, lambda a: F.struct(a["key"].alias("key"), unwrap(a["value"]).alias("value"))).cast(kind)
    return F.aggregate(F.coalesce(pairs, F.array().cast(kind)), F.create_map().cast("map<string,string>"), _put)


def _put(m: Column, p: Column) -> Column:
    return F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.map_from_entries(F.array(p)))


def otlp_rows(items: DataFrame) -> DataFrame:
    """OTLP payloads to one row per record; resource attributes are inherited, a record's own win.

    Without a readable trace id the body's traceparent comment gives it. A missing time is the arrival's.
    """
    attribute = "array<struct<key:string,value:string>>"
    schema = f"struct<resourceLogs:array<struct<resource:struct<attributes:{attribute}>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<string>>>>>>"
    top = F.from_json("payload", schema)["resourceLogs"]
    rows = items.select("project_id", "received_at", F.explode(top).alias("r")).select("project_id", "received_at", _attribute_map(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeLogs").alias("s"))
    rows = rows.select("project_id", "received_at", "res", F.col("s.scope.name").alias("scope"), F.posexplode("s.logRecords").alias("position", "record")).filter(F.ltrim("record").startswith("{"))
    rows = rows.withColumn("own", _attribute_map(F.from_json(F.get_json_object("record", "$.attributes"), attribute))).withColumn("body", F.coalesce(unwrap(F.get_json_object("record", "$.body")), F.lit("")))
    text = lambda k: F.get_json_object("record", f"$.{k}")
    res, own = (lambda k: F.try_element_at("res", F.lit(k))), (lambda k: F.try_element_at("own", F.lit(k)))
    trace, span = normalize_id(text("traceId"), 32), normalize_id(text("spanId"), 16)
    nanos = F.coalesce(text("timeUnixNano"), text("observedTimeUnixNano")).try_cast("long")
    merged = F.map_concat(F.map_filter("res", lambda k, _: ~F.coalesce(F.map_contains_key("own", k), F.lit(False))), F.col("own"))
    return rows.select(
        "project_id", "position", F.coalesce(F.timestamp_micros(F.floor(nanos / 1000)), F.col("received_at")).alias("timestamp"), F.coalesce(level_from_number(text("severityNumber").try_cast("int")), level_from_name(text("severityText"))).alias("level"),
        text("severityNumber").try_cast("int").alias("severity_number"), "body", F.coalesce(own("log.logger"), own("code.namespace"), F.col("scope")).alias("logger_name"), F.coalesce(trace, traceparent(F.col("body"), 1)).alias("trace_id"),
        F.coalesce(span, F.when(trace.isNull(), traceparent(F.col("body"), 2))).alias("span_id"), F.coalesce(res("deployment.environment"), own("deployment.environment")).alias("environment"), res("service.version").alias("release"),
        F.coalesce(res("host.name"), res("server.address"), res("service.name")).alias("server_name"), res("service.name").alias("service"), own("duration_ms").try_cast("double").alias("duration_ms"), F.lit("otlp").alias("source"),
        attrs_text(merged).alias("attrs_text"), F.col("record").alias("payload"))


def name_services(logs: DataFrame, projects: DataFrame) -> DataFrame:
    """A log without a service takes its project's slug."""
    named = logs.join(projects.select(F.col("id").alias("project_id"), "slug"), "project_id", "left")
    return named.withColumn("service", F.coalesce(F.nullif(F.trim("service"), F.lit("")), F.col("slug"))).drop("slug")


def display_attributes(payload: Column) -> Column:
    """A stored log's attributes as one flat map of scalars, whether they came as an object or as a list of pairs."""
    raw = F.get_json_object(payload, "$.attributes")
    listed = _attribute_map(F.from_json(raw, "array<struct<key:string,value:string>>"))
    keyed = F.transform_values(F.from_json(raw, "map<string,string>"), lambda _, v: unwrap(v))
    none = F.create_map().cast("map<string,string>")
    return F.when(F.ltrim(raw).startswith("["), listed).when(F.ltrim(raw).startswith("{"), keyed).otherwise(none)


def check_in_rows(items: DataFrame) -> DataFrame:
    """Check-in items to rows for the monitors' fold; a schedule counts only where the payload has a configuration."""
    p = F.col("json")
    return _parsed(items).select(
        "project_id", F.col("received_at").alias("arrived_at"), F.coalesce(F.col("item_index"), F.lit(0)).alias("sequence"),
        *_fields(p, {"slug": "$.monitor_slug", "status": "$.status", "environment": "$.environment", "schedule_type": "$.monitor_config.schedule.type", "schedule_value": "$.monitor_config.schedule.value", "schedule_unit": "$.monitor_config.schedule.unit", "timezone": "$.monitor_config.timezone"}),
        _at(p, "$.duration", "double").alias("duration"), _at(p, "$.monitor_config.checkin_margin", "int").alias("checkin_margin"), _at(p, "$.monitor_config.max_runtime", "int").alias("max_runtime"),
        _at(p, "$.monitor_config", "variant").isNotNull().alias("has_config"))
