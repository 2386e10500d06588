"""Filters: ranges (C1–C3), optional equalities (C4), substrings (C5, C6), bands (C7), tags."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.window import TimeWindow

TAG_KEY = re.compile(r"[a-zA-Z0-9_.-]+")


def inclusive(window: TimeWindow, column: str = "timestamp") -> Column:
    return F.col(column).between(F.lit(window.begin), F.lit(window.end))


def half_open(window: TimeWindow, column: str = "timestamp") -> Column:
    return (F.col(column) >= F.lit(window.begin)) & (F.col(column) < F.lit(window.end))


def whole_hours(window: TimeWindow, column: str = "hour_bucket") -> Column:
    """From the begin's whole hour to the end's, both included."""
    return F.col(column).between(F.lit(window.first_hour), F.lit(window.last_hour))


def like(column: Column, text: str) -> Column:
    """Substring match with ``%`` and ``_`` live, case folded."""
    return column.ilike(f"%{text}%")


def contains(column: Column, text: str) -> Column:
    """Substring match of the text as it is, case folded."""
    return F.contains(F.lower(column), F.lit(text.lower()))


@dataclass(frozen=True)
class Scope:
    """Optional filters; None or blank is no filter. The blank environment of the rollups can't be asked for."""

    project_id: int | None = None
    name: str | None = None
    name_like: str | None = None
    environment: str | None = None
    release: str | None = None
    status: str | None = None
    method: str | None = None

    def apply(self, rows: DataFrame, rollup: bool = False) -> DataFrame:
        equal = {"project_id": self.project_id, "transaction_name": self.name, "environment": self.environment}
        if not rollup:
            equal |= {"release": self.release, "http_status": self.status, "http_method": self.method}
        for column, value in equal.items():
            if value is not None and value != "":
                rows = rows.filter(F.col(column) == F.lit(value))
        return rows.filter(like(F.col("transaction_name"), self.name_like)) if self.name_like else rows


@dataclass(frozen=True)
class SlowFilter:
    """Longer than ``min_duration``, at most ``max_duration``, and string tags equal to the given values."""

    min_duration: int | None = None
    max_duration: int | None = None
    tags: dict[str, str] = field(default_factory=dict)

    def apply(self, rows: DataFrame) -> DataFrame:
        if self.min_duration is not None:
            rows = rows.filter(F.col("duration") > self.min_duration)
        if self.max_duration is not None:
            rows = rows.filter(F.col("duration") <= self.max_duration)
        for key, value in self.tags.items():
            if not TAG_KEY.fullmatch(key):
                raise ValueError(f"tag key {key!r} has other characters than letters, digits, _ . -")
            # Only strings match: numbers and booleans of the same spelling are other values. Dots walk into objects.
            found = F.try_variant_get(F.try_parse_json("tags"), f"$.{key}", "string")
            kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("tags"), f"$.{key}", "variant"))
            rows = rows.filter((kind == "STRING") & (found == value))
        return rows
