"""Small derived values: shares of a request (C12), bands (C15, C11), labels (I17), spans (I19–I21), urls (I18, I25), deltas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share_pct(part: Column, whole: Column) -> Column:
    """Per cent to two places; 0 where either is missing or the whole is not positive."""
    return F.when((whole > 0) & part.isNotNull(), F.round(part / whole * 100, 2)).otherwise(F.lit(0.0))


def other_time(duration: Column, db_time: Column, view_time: Column) -> Column:
    return F.greatest(duration - F.coalesce(db_time, F.lit(0)) - F.coalesce(view_time, F.lit(0)), F.lit(0))


def controller_name(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("#")), F.split(name, "#").getItem(0))


def action_name(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("#")), F.element_at(F.split(name, "#"), -1))


def latency_band(duration: Column) -> Column:
    return F.when(duration >= 2000, "critical").when(duration >= 1000, "slow").when(duration >= 500, "moderate").otherwise("fast")


def is_slow(duration: Column) -> Column:
    return duration > 1000


def is_success(status: Column) -> Column:
    return F.coalesce(status.startswith("2"), F.lit(False))


def is_http_error(status: Column) -> Column:
    return F.coalesce(status.startswith("4") | status.startswith("5"), F.lit(False))


def duration_label(ms: Column) -> Column:
    """Seconds to two places from a second on, whole milliseconds below; ``N/A`` for null."""
    return F.when(ms.isNull(), "N/A").when(ms >= 1000, F.concat(F.round(ms / 1000.0, 2).cast("string"), F.lit("s"))).otherwise(F.concat(F.round(ms).cast("long").cast("string"), F.lit("ms")))


def release_label(release: Column) -> Column:
    """Month, day, time and seven digits of the hash for ``<time>-<hash>``; else at most twenty characters."""
    parts = F.regexp_extract(release, r"^(.+)-([0-9a-fA-F]{7,40})$", 1), F.regexp_extract(release, r"^(.+)-([0-9a-fA-F]{7,40})$", 2)
    local = F.try_to_timestamp(F.regexp_extract(parts[0], r"^(\d{4}-\d\d-\d\d[T ]\d\d:\d\d(?::\d\d)?)", 1))
    label = F.concat(F.date_format(local, "MMM d HH:mm"), F.lit(" · "), F.substring(parts[1], 1, 7))
    return F.when(F.trim(release) == "", F.lit(None)).otherwise(F.coalesce(label, F.when(F.length(release) > 20, F.concat(F.substring(release, 1, 17), F.lit("..."))).otherwise(release)))


def span_duration_ms(begin: Column, end: Column) -> Column:
    return F.round((F.unix_micros(end) - F.unix_micros(begin)) / 1000.0).cast("long")


def span_class(op: Column) -> Column:
    dotted = lambda *names: op.rlike(rf"^(?:{'|'.join(names)})\.")
    return F.when(dotted("db"), "db").when(dotted("http"), "http").when(dotted("view", "template", "render"), "view").when(dotted("cache"), "cache").when(dotted("queue"), "queue").otherwise("other")


def waterfall(begin_ms: Column, duration_ms: Column, root_begin_ms: Column, root_duration_ms: Column) -> Column:
    """Offset within 0..100 and width within 0.25..100 per cent of a root of at least one millisecond."""
    whole = F.greatest(root_duration_ms, F.lit(1)).cast("double")
    clamp = lambda x, low: F.least(F.greatest(x, F.lit(low)), F.lit(100.0))
    return F.struct(clamp((begin_ms - root_begin_ms) / whole * 100, 0.0).alias("offset_pct"), clamp(duration_ms / whole * 100, 0.25).alias("width_pct"))


def query_params(url: Column) -> Column:
    """Decoded parameters of a url; null where it has none."""
    raw = F.nullif(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(""))
    pairs = F.transform(F.filter(F.split(raw, "&"), lambda p: p != ""), lambda p: F.struct(F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1)).alias("key"), F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)).alias("value")))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["key"]), F.map_from_entries(F.array(p))))


def dsn_parts(dsn: Column) -> Column:
    pattern = r"^(https?)://([^:@/]+)(?::[^@/]*)?@([^/]+)/(.+)$"
    return F.struct(*[F.nullif(F.regexp_extract(dsn, pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(("scheme", "public_key", "host", "project"))])


def percent_change(before: Column, after: Column) -> Column:
    """Relative change in per cent to one place, in floating point; null where there was nothing before."""
    return F.when(before != 0, F.round((after - before) / before.cast("double") * 100, 1))
