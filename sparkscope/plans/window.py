"""Time windows (C13, C20), bucketing (T3) and labels. Every "now" is an explicit argument."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days that each stream's rows are kept.
RETENTION_DAYS = {"events": 30, "transactions": 90, "spans": 30, "logs": 14, "histograms": 540}
HOUR = 3600


class WindowError(ValueError):
    """A window that can't be answered: inverted, in the future, or wholly expired."""


def expired(begin: Column, as_of: datetime, stream: str = "transactions") -> Column:
    """C20 for a column of windows: whether each begins before the stream's raw rows do."""
    return begin < F.lit(as_of - timedelta(days=RETENTION_DAYS[stream]))


@dataclass(frozen=True)
class TimeWindow:
    begin: datetime
    end: datetime
    note: str | None = None

    @property
    def seconds(self) -> int:
        return int((self.end - self.begin).total_seconds())

    @property
    def first_hour(self) -> datetime:
        return hour_floor(self.begin)

    @property
    def last_hour(self) -> datetime:
        return hour_floor(self.end)

    def raw_expired(self, as_of: datetime, stream: str = "transactions") -> bool:
        """Whether the window begins before the stream's raw rows do (C20)."""
        return self.begin < as_of - timedelta(days=RETENTION_DAYS[stream])


@dataclass(frozen=True)
class Bucketing:
    origin: datetime
    width: int
    count: int

    @property
    def hourly(self) -> bool:
        return self.width % HOUR == 0

    def start(self, index: int) -> datetime:
        return self.origin + timedelta(seconds=index * self.width)


def hour_floor(t: datetime) -> datetime:
    return t.replace(minute=0, second=0, microsecond=0)


def resolve_window(as_of: datetime, hours: float | None = None, start: datetime | None = None, end: datetime | None = None, stream: str = "histograms", default_hours: float = 24) -> TimeWindow:
    """The window of a request: explicit ends win over ``hours``, and what begins before retention is pulled forward."""
    oldest = as_of - timedelta(days=RETENTION_DAYS[stream])
    end = end or as_of
    begin = start or end - timedelta(hours=min(hours or default_hours, RETENTION_DAYS[stream] * 24))
    if begin >= end:
        raise WindowError("the window's start must lie before its end")
    if begin > as_of:
        raise WindowError("the window starts in the future")
    if end < oldest:
        raise WindowError(f"the window ends before the oldest data kept, {oldest:%Y-%m-%d}")
    note = None
    if begin < oldest:
        begin, note = oldest, f"start pulled forward to {oldest:%Y-%m-%d %H:%M}, the oldest data kept"
    return TimeWindow(begin, end, note)


def bucketing_for(window: TimeWindow, buckets: int) -> Bucketing:
    """Below an hour the natural width stays; else it is rounded up to whole hours, which the rollups tile."""
    natural = max(1, window.seconds // buckets)
    if natural < HOUR:
        return Bucketing(window.begin, natural, buckets)
    width = -(-natural // HOUR) * HOUR
    return Bucketing(window.begin, width, -(-window.seconds // width))
