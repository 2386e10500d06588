"""Metrics of streams (S10): a listener keeps what each micro-batch took, and a delivery's ledger says what waits and is buried."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

from ..sources import sinks
from .delivery import Delivery

_ROW = "name string, batch_id long, at string, rows long, rows_per_second double, arriving_per_second double, batch_ms long, behind long, state_rows long"


class ProgressTable(StreamingQueryListener):
    """Writes a row for each batch of each named stream below ``root``, replaced when the batch runs again.

    One short row a batch, from the driver, where Spark tells it; add it with ``spark.streams.addListener``.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        if not p.name:
            return
        behind = sum(int(v) for s in p.sources for k, v in (s.metrics or {}).items() if k in ("numFilesOutstanding", "avgOffsetsBehindLatest") and str(v).isdigit())
        row = (p.name, p.batchId, p.timestamp, p.numInputRows, float(p.processedRowsPerSecond or 0), float(p.inputRowsPerSecond or 0), p.batchDuration, behind, sum(s.numRowsTotal for s in p.stateOperators))
        self.spark.createDataFrame([row], _ROW).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/stream={p.name}/batch={p.batchId}")

    def onQueryIdle(self, event: object) -> None:
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass

    def read(self) -> DataFrame:
        """A row for each stream and batch that took rows."""
        columns = [c.split()[0] for c in _ROW.split(", ")]
        rows = self.spark.read.schema(_ROW).option("recursiveFileLookup", "true").parquet(self.root) if sinks.exists(self.spark, self.root) else self.spark.createDataFrame([], _ROW)
        return rows.select(*columns).filter("rows > 0")


def ledger(deliver: Delivery) -> DataFrame:
    """``batch_id, failed, waiting, buried``: items of each batch that failed, and of these those that wait for another attempt or
    were buried with it."""
    read = lambda table: deliver.spark.read.parquet(f"{deliver.root}/{table}").groupBy("batch_id").agg(F.count("*").alias(table))
    batches = deliver.spark.read.parquet(f"{deliver.root}/work").select("batch_id").distinct()
    counts = batches.join(read("waiting"), "batch_id", "left").join(read("buried"), "batch_id", "left").na.fill(0)
    return counts.select("batch_id", (F.col("waiting") + F.col("buried")).alias("failed"), "waiting", "buried")
