"""Burst alerts (S7): an issue's events of the trailing hour against a threshold, at most one alert an hour."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR = 3600
_OUT = "project_id int, fingerprint string, alert_at timestamp, rate long"
_STATE = "minutes array<long>, counts array<long>, alerted_at long"


def burst_alerts(events: DataFrame, threshold: int = 1000, delay: str = "1 hour") -> DataFrame:
    """A stream of ``project_id, fingerprint, alert_at, rate`` from events with ``project_id, fingerprint, timestamp``.

    The state of an issue is a count for each of the last sixty-one minutes and the time of its last alert: bounded, however
    many events an issue has. It goes once no event for that long is older than the watermark, so that there is state for the
    issues that are live alone; events more than ``delay`` behind the newest of all then count no more. Events are taken in the
    order of their times within a batch.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        counts: dict[int, int] = {}
        alerted = -HOUR
        if state.exists:
            minutes, held, alerted = state.get
            counts = dict(zip(minutes, held, strict=True))
        arrived: dict[int, int] = {}
        for batch in batches:
            at = batch["timestamp"].astype("datetime64[us]").astype("int64") // 60_000_000
            for minute, n in at.value_counts().items():
                arrived[int(minute)] = arrived.get(int(minute), 0) + int(n)
        alerts = []
        for minute in sorted(arrived):
            counts[minute] = counts.get(minute, 0) + arrived[minute]
            rate = sum(n for m, n in counts.items() if minute - 60 < m <= minute)
            if rate >= threshold and minute * 60 - alerted >= HOUR:
                alerted = minute * 60
                alerts.append((int(key[0]), key[1], pd.Timestamp(minute * 60, unit="s"), rate))
        newest = max(counts)
        kept = {m: n for m, n in counts.items() if m > newest - 61}
        state.update((list(kept), list(kept.values()), alerted))
        state.setTimeoutTimestamp((newest + 61) * 60_000)
        yield pd.DataFrame(alerts, columns=["project_id", "fingerprint", "alert_at", "rate"])

    return events.withWatermark("timestamp", delay).groupBy("project_id", "fingerprint").applyInPandasWithState(judge, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
