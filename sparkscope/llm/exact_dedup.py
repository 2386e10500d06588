"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, each partition is sorted (externally, by Spark), equal texts are
then neighbours, and neighbouring texts are compared in full. A group that a splitter cuts is joined again from the first
and last run of each partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_RUN = "id long, run_id long, keep_id long, group_size long, first boolean, text_sha256 string, cut_text binary"


def normalised(text_col: str = "text"):
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each text with the one before it; a run of equals is given out when it ends.

    Only the ids of the run at hand are held. The splitters also order by id, so a large group is cut over partitions.
    """
    base, run, ids, digest, text, whole = TaskContext.get().partitionId() << 33, 0, [], None, b"", None

    def ended(last: bool) -> pa.RecordBatch:
        n, cut = len(ids), run == 0 or last
        texts = [_whole(text) if cut else None] + [None] * (n - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([base + run] * n, pa.int64()), pa.array([ids[0]] * n, pa.int64()), pa.array([n] * n, pa.int64()),
             pa.array([True] + [False] * (n - 1)), pa.array([digest] * n, pa.string()), pa.array(texts, pa.binary())],
            names=["id", "run_id", "keep_id", "group_size", "first", "text_sha256", "cut_text"])

    def _whole(value: bytes) -> bytes:
        return _SPACES.sub(b" ", value)

    for batch in batches:
        out = []
        rows = zip(batch.column("id").to_pylist(), batch.column("sha").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True)
        for key, sha, raw in rows:
            same = False
            if ids and sha == digest:
                whole = _whole(text) if whole is None else whole
                same = whole == _whole(raw)
            if not same:
                if ids:
                    out.append(ended(False))
                    run += 1
                ids, digest, text, whole = [], sha, raw, None
            ids.append(key)
        yield from pa.Table.from_batches(out).combine_chunks().to_batches() if out else []
    if ids:
        yield ended(True)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after normalisation; the row with the smallest id stays. A null text counts as
    empty. Null ids sort last, so such a row stays only if its whole group has none. Of rows repeated with the same id and
    text exactly one stays. Very long texts are sorted by Spark like any others, by their head and digest, and compared whole:
    a task holds two of them. Ties in head and digest go by the id. An empty table gives an empty result. Other columns of
    ``docs`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = normalised(text_col)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.substring(norm, 1, 64).alias("head"), F.sha2(norm, 256).alias("sha"))
    # The order is by content: the first characters, then the digest of all, so that the splitters' sample stays small.
    order = [F.col("head").asc(), F.col("sha").asc(), F.col("id").asc_nulls_last()]
    runs = cut_lineage(keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "sha", "text").mapInArrow(_runs, _RUN))
    group = Window.partitionBy("cut_text")
    # At most two runs for each range partition, whatever the input: a bounded broadcast.
    cut = runs.filter(F.col("first") & F.col("cut_text").isNotNull()).select(
        "run_id",
        F.min("keep_id").over(group).alias("all_keep"),
        F.sum("group_size").over(group).alias("all_size"),
        F.min("run_id").over(group).alias("first_run"),
    )
    merged = runs.join(F.broadcast(cut), "run_id", "left")
    return merged.select(
        F.col("id").alias(id_col),
        F.coalesce("all_keep", "keep_id").alias("keep_id"),
        F.coalesce("all_size", "group_size").alias("group_size"),
        (F.col("first") & (F.coalesce("first_run", "run_id") == F.col("run_id"))).alias("kept"),
        "text_sha256",
    )
