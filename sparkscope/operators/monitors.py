"""Cron monitors: check-in fold (A12), schedules (I26), verdicts and issue transitions."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("in_progress", "ok", "error")
FAILURES = ("missed", "error", "overrun")
#: Seconds of a schedule's units.
UNIT_SECONDS = {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}
_NAMES = {**{n: i for i, n in enumerate(("sun", "mon", "tue", "wed", "thu", "fri", "sat"))}, **{n: i + 1 for i, n in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"))}}
_MACROS = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *"}


def fold_check_ins(check_ins: DataFrame) -> DataFrame:
    """A monitor's state from its check-ins (``project_id, slug, status, arrived_at, sequence, ...``).

    Other statuses are dropped. ``in_progress`` starts the overrun clock, the other two stop it; only ``ok`` moves
    ``last_ok_at``; duration, environment and schedule are the last that were given.
    """
    order = F.struct("arrived_at", "sequence")
    last = lambda c, when=None: F.max_by(c, F.when(F.col(c).isNotNull() if when is None else when, order)).alias(c)
    running = F.max_by("status", order) == "in_progress"
    rows = check_ins.withColumn("slug", F.trim("slug")).filter((F.col("slug") != "") & F.col("status").isin(*STATUSES)).withColumn("duration", F.when(F.col("status") != "in_progress", F.col("duration")))
    return rows.groupBy("project_id", "slug").agg(
        F.max_by("status", order).alias("last_status"), F.max("arrived_at").alias("last_checkin_at"), F.max(F.when(F.col("status") == "ok", F.col("arrived_at"))).alias("last_ok_at"),
        F.when(running, F.max("arrived_at")).alias("in_progress_since"), last("duration").alias("last_duration"), last("environment"),
        *[F.max_by(c, F.when(F.col("has_config"), order)).alias(c) for c in ("schedule_type", "schedule_value", "schedule_unit", "checkin_margin", "max_runtime", "timezone")])


def _field(text: str, low: int, high: int) -> set[int] | None:
    found: set[int] = set()
    for part in text.lower().split(","):
        body, _, step = part.partition("/")
        ends = body.split("-")
        try:
            values = [_NAMES[e[:3]] if e[:3] in _NAMES else int(e) for e in ends] if body != "*" else [low, high]
            by = int(step) if step else 1
        except ValueError:
            return None
        stop = values[-1] if len(values) > 1 else (high if step else values[0])
        if by < 1 or not low <= values[0] <= stop <= max(high, 7 if high == 6 else high):
            return None
        found.update(range(values[0], stop + 1, by))
    return {v % 7 for v in found} if high == 6 else found


def cron_next(expression: str, after: datetime, zone: str | None = None) -> datetime | None:
    """The first minute after ``after`` (UTC) that a five-field crontab matches in its zone; null where it can't be read.

    Days match by either field when both are restricted. Hours that a zone skips do not occur.
    """
    fields = _MACROS.get(expression.strip(), expression).split()
    try:
        tz = ZoneInfo(zone or "UTC")
    except (KeyError, ValueError, OSError):
        return None
    if len(fields) != 5:
        return None
    sets = [_field(f, lo, hi) for f, (lo, hi) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 6)), strict=True)]
    if any(s is None for s in sets):
        return None
    minutes, hours, days, months, weekdays = sets
    start = after.replace(tzinfo=ZoneInfo("UTC")).astimezone(tz)
    day = start.replace(hour=0, minute=0, second=0, microsecond=0, tzinfo=None)
    for _ in range(366 * 8):
        by_day, by_week = day.day in days, (day.weekday() + 1) % 7 in weekdays
        either = fields[2] != "*" and fields[4] != "*"
        if day.month in months and ((by_day or by_week) if either else (by_day and by_week)):
            for hour in sorted(hours):
                for minute in sorted(minutes):
                    at = day.replace(hour=hour, minute=minute, tzinfo=tz)
                    utc = at.astimezone(ZoneInfo("UTC"))
                    if utc.astimezone(tz).replace(tzinfo=None) == at.replace(tzinfo=None) and utc > after.replace(tzinfo=ZoneInfo("UTC")):
                        return utc.replace(tzinfo=None)
        day += timedelta(days=1)
    return None


def _next_time(expression: Column, basis: Column, zone: Column) -> Column:
    def each(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for expressions, bases, zones in batches:
            values = [None if not e or pd.isna(b) else cron_next(e, b.to_pydatetime(), z) for e, b, z in zip(expressions, bases, zones, strict=True)]
            yield pd.Series(pd.to_datetime(pd.Series(values, dtype="object")))

    # Made here, as workers that import this module have no session.
    each.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, "timestamp")(expression, basis, zone)


def interval_seconds(kind: Column, value: Column, unit: Column) -> Column:
    n = value.try_cast("long")
    seconds = F.try_element_at(F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv]), F.coalesce(unit, F.lit("")))
    return F.when((kind == "interval") & (n > 0), n * seconds)


def margin_seconds(margin: Column) -> Column:
    return F.when(margin > 0, margin).otherwise(F.lit(1)) * 60


def verdicts(monitors: DataFrame, as_of: datetime, with_crontabs: bool = True) -> DataFrame:
    """Each monitor's failures as of a time and its next state; the first failure names the state.

    What is due counts from the last check-in of any status, else from the monitor's creation. Monitors without a readable
    schedule can't be missed; those that never checked in and are not overdue stay as they are.
    """
    now = F.lit(as_of)
    basis = F.coalesce(F.col("last_checkin_at"), F.col("created_at")) if "created_at" in monitors.columns else F.col("last_checkin_at")
    due = F.timestamp_seconds(F.unix_micros(basis) / 1e6 + interval_seconds(F.col("schedule_type"), F.col("schedule_value"), F.col("schedule_unit")))
    if with_crontabs:
        due = F.coalesce(due, F.when(F.col("schedule_type") == "crontab", _next_time(F.when(F.col("schedule_type") == "crontab", F.col("schedule_value")), basis, F.col("timezone"))))
    rows = monitors.withColumn("next_expected_at", due)
    seconds = lambda c: F.unix_micros(c) / 1e6
    missed = seconds(now) > seconds(F.col("next_expected_at")) + margin_seconds(F.coalesce("checkin_margin", F.lit(0)))
    overrun = (F.col("max_runtime") > 0) & (seconds(now) > seconds(F.col("in_progress_since")) + F.col("max_runtime") * 60)
    failing = {"missed": missed, "error": F.col("last_status") == "error", "overrun": overrun}
    failures = F.array_compact(F.array(*[F.when(failing[k], F.lit(k)) for k in FAILURES]))
    state = F.when(F.size("failures") > 0, F.get("failures", F.lit(0))).when(F.col("last_checkin_at").isNotNull(), F.lit("ok")).otherwise(F.col("state"))
    return rows.withColumn("failures", failures).withColumn("next_state", state)


def issue_transitions(judged: DataFrame, issues: DataFrame, as_of: datetime) -> DataFrame:
    """Status changes by fingerprint ``monitor:<slug>:<kind>``: every failing kind opens an issue unless it is open or
    ignored; a monitor that recovers from a stored failure resolves its open ones."""
    key = lambda kind: F.concat(F.lit("monitor:"), F.col("slug"), F.lit(":"), kind)
    kinds = judged.select("project_id", "slug", "state", "next_state", "failures", F.explode(F.array(*[F.lit(k) for k in FAILURES])).alias("kind")).withColumn("fingerprint", key(F.col("kind")))
    joined = kinds.join(issues.select("project_id", "fingerprint", "status"), ["project_id", "fingerprint"], "left")
    failing = F.array_contains("failures", F.col("kind"))
    change = F.when(failing & (F.col("status").isNull() | (F.col("status") == 1)), F.lit(0)).when((F.size("failures") == 0) & F.col("state").isin(*FAILURES) & (F.col("next_state") == "ok") & (F.col("status") == 0), F.lit(1))
    return joined.withColumn("new_status", change).filter("new_status IS NOT NULL").select("project_id", "fingerprint", F.concat(F.lit("Monitor"), F.initcap("kind")).alias("exception_type"), F.col("new_status").alias("status"), F.lit(as_of).alias("changed_at"))
