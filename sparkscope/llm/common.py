"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once; a longer text is handled alone.
CHUNK_BYTES = 2 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions: the one setting that operators scale their buckets by."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, as in tests, a new one.

    A machine's own folder is no place for what a cluster shares, so there an unset folder is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder, so that lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        values = batch.column(column)
        if not len(values):
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(values), 0), dtype=np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return pc.fill_null(batch.column(column).cast(pa.binary()), b"").to_pylist()


def ordinal(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """Number rows from 0 in the given order without a single task: range partitions, then each one's offset."""
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each range partition, so its size is bounded by their number.
    offsets = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    row = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, row).drop("_part", "_at", "_before")
