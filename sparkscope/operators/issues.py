"""Issues: grouping (E25, I6, I7), facets (B7, B8, D1, E18, E19), releases (B9), bursts (E23, I28), status (B14), recount."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import contains

OPEN, RESOLVED, IGNORED = 0, 1, 2
STATUS = {"open": OPEN, "resolved": RESOLVED, "ignored": IGNORED}
ISSUE_FACETS = ("environment", "release")
UNKNOWN_TITLE = "Unknown Error"


def fingerprint(declared: Column, kind: Column, file: Column, line: Column, message: Column) -> Column:
    """The declared parts, else type, file and line of the last frame, else the message's digest; missing parts are empty."""
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    own = F.array_join(declared, "::", "")
    return F.when(F.size(F.coalesce(declared, F.array().cast("array<string>"))) > 0, own).when(F.trim(kind) != "", F.concat_ws("::", blank(kind), blank(file), blank(line))).otherwise(F.md5(F.coalesce(message, F.lit(UNKNOWN_TITLE))))


def title(value: Column, message: Column, kind: Column) -> Column:
    """The first that is not blank."""
    filled = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(filled(value), filled(message), filled(kind), F.lit(UNKNOWN_TITLE))


def group_issues(events: DataFrame, arrival: str = "id") -> DataFrame:
    """One issue per project and fingerprint; title and type are those of the event that arrived first."""
    first = lambda c: F.min_by(c, arrival).alias(c)
    named = events.withColumn("title", title(F.col("exception_value"), F.lit(None).cast("string"), F.col("exception_type")))
    return named.groupBy("project_id", "fingerprint").agg(F.count("*").alias("count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), first("title"), first("exception_type"))


def issue_partials(events: DataFrame, arrived: str = "received_at") -> DataFrame:
    """E25 as a partial that merges: counts, extremes, and of the event that arrived first what names the issue (``first``)."""
    message = F.col("message") if "message" in events.columns else F.lit(None).cast("string")
    first = F.struct(F.col(arrived).alias("arrived_at"), "event_id", title(F.col("exception_value"), message, F.col("exception_type")).alias("title"), "exception_type")
    return events.groupBy("project_id", "fingerprint").agg(F.count("*").alias("count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.min(first).alias("first"))


def merge_issues(parts: DataFrame) -> DataFrame:
    """Partials of several batches, or of merges of them, as one: counts add, extremes take the extreme."""
    return parts.groupBy("project_id", "fingerprint").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min("first").alias("first"))


def named_issues(merged: DataFrame) -> DataFrame:
    """Merged partials in the form of ``group_issues``."""
    return merged.select("project_id", "fingerprint", "count", "first_seen", "last_seen", F.col("first.title").alias("title"), F.col("first.exception_type").alias("exception_type"))


def current_status(issues: DataFrame, changes: DataFrame) -> DataFrame:
    """The last change of each issue wins; none is open. Changes are an append-only log."""
    last = changes.groupBy("project_id", "fingerprint").agg(F.max_by("status", F.struct("changed_at", "status")).alias("status"))
    return issues.join(last, ["project_id", "fingerprint"], "left").withColumn("status", F.coalesce("status", F.lit(OPEN)))


def issue_facets(events: DataFrame) -> DataFrame:
    """When each allowed facet value of an issue was last seen; blank values are none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in ISSUE_FACETS]))
    rows = events.select("project_id", "fingerprint", "timestamp", pairs.alias("f")).filter("trim(f.value) != ''")
    return rows.groupBy("project_id", "fingerprint", F.col("f.name").alias("name"), F.col("f.value").alias("value")).agg(F.max("timestamp").alias("last_seen_at"))


def facets(rows: DataFrame, stream: str, names: list[str]) -> DataFrame:
    """Distinct facet values of a stream and when they were last seen."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in names]))
    seen = rows.select("project_id", "timestamp", pairs.alias("f")).filter("trim(f.value) != ''")
    return seen.groupBy("project_id", F.lit(stream).alias("stream"), F.col("f.name").alias("name"), F.col("f.value").alias("value")).agg(F.max("timestamp").alias("last_seen_at"))


def merge_facets(*parts: DataFrame) -> DataFrame:
    """Facets of several batches: the latest sighting stays."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*[c for c in whole.columns if c != "last_seen_at"]).agg(F.max("last_seen_at").alias("last_seen_at"))


def facet_values(found: DataFrame, name: str) -> DataFrame:
    """Sorted distinct values of a facet."""
    return found.filter(F.col("name") == name).select("project_id", "value").distinct().orderBy("project_id", "value")


def values_per_issue(found: DataFrame, name: str) -> DataFrame:
    """An issue's values of a facet as a sorted list."""
    return found.filter(F.col("name") == name).groupBy("project_id", "fingerprint").agg(F.array_sort(F.collect_set("value")).alias("values"))


def seen_in(issues: DataFrame, found: DataFrame, **wanted: str) -> DataFrame:
    """Issues seen with every wanted facet value."""
    for name, value in wanted.items():
        match = found.filter((F.col("name") == name) & (F.col("value") == value)).select("project_id", "fingerprint")
        issues = issues.join(match, ["project_id", "fingerprint"], "left_semi")
    return issues


def search_issues(issues: DataFrame, text: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    """By title or type as written, and status, most recent first; ``all`` is no status filter."""
    if text:
        issues = issues.filter(contains(F.col("title"), text) | contains(F.coalesce("exception_type", F.lit("")), text))
    if status and status != "all":
        issues = issues.filter(F.col("status") == STATUS[status])
    return issues.orderBy(F.desc("last_seen"), "project_id", "fingerprint").limit(max(1, min(limit, 100)))


def by_frequency(issues: DataFrame, limit: int = 20) -> DataFrame:
    """G5."""
    return issues.orderBy(F.desc("count"), "project_id", "fingerprint").limit(limit)


def status_counts(issues: DataFrame, *keys: str) -> DataFrame:
    """E17."""
    return issues.groupBy(*keys, "status").agg(F.count("*").alias("count"))


def release_sightings(rows: DataFrame) -> DataFrame:
    """First and last sighting of each release and how many rows named it; blank releases are none."""
    return rows.filter("trim(release) != ''").groupBy("project_id", F.col("release").alias("version")).agg(F.min("timestamp").alias("first_seen_at"), F.max("timestamp").alias("last_seen_at"), F.count("*").alias("transaction_count"))


def merge_releases(parts: DataFrame) -> DataFrame:
    """Sightings of several batches as one."""
    return parts.groupBy("project_id", "version").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"), F.sum("transaction_count").alias("transaction_count"))


def burst_rates(events: DataFrame, issues: DataFrame, as_of: datetime, threshold: int = 1000) -> DataFrame:
    """Open issues with at least ``threshold`` events in the hour up to ``as_of``."""
    rows = events.filter((F.col("timestamp") > F.lit(as_of - timedelta(hours=1))) & (F.col("timestamp") <= F.lit(as_of)))
    rates = rows.groupBy("project_id", "fingerprint").agg(F.count("*").alias("rate")).filter(F.col("rate") >= threshold)
    return rates.join(issues.filter(F.col("status") == OPEN).select("project_id", "fingerprint", "title"), ["project_id", "fingerprint"])


def is_bursting(status: Column, last_burst_at: Column, as_of: datetime) -> Column:
    """I28."""
    return F.coalesce((status == OPEN) & (last_burst_at > F.lit(as_of - timedelta(hours=1))), F.lit(False))


def recount(issues: DataFrame, events: DataFrame, affected: DataFrame | None = None) -> DataFrame:
    """Counts anew from the events that are left, for the affected issues only; the others keep theirs."""
    keys = ["project_id", "fingerprint"]
    counted = issues.join(events.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "left")
    if affected is None:
        return counted.withColumn("count", F.coalesce("_n", F.lit(0))).drop("_n")
    hit = counted.join(affected.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    return hit.withColumn("count", F.when(F.col("_hit"), F.coalesce("_n", F.lit(0))).otherwise(F.col("count"))).drop("_n", "_hit")


def delete_events(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Events without those named; recount their issues afterwards."""
    return events.join(tombstones.select("project_id", "event_id"), ["project_id", "event_id"], "left_anti")


def events_of(issues: DataFrame, events: DataFrame) -> DataFrame:
    """Each issue's events; the issue's columns come with them, the keys once."""
    keys = ["project_id", "fingerprint"]
    own = [F.col(c).alias(f"issue_{c}") for c in issues.columns if c not in keys]
    return issues.select(*keys, *own).join(events, keys)
