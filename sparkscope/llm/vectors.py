"""Exact top-k search by vector-approximation files.

The file holds a byte for each component: its cell on a grid of equal steps between the dimension's extremes. As all cells of
a dimension are equally wide, one product of the queries with the bytes gives each score's lower and upper bound, which lie a
constant of the query apart. Exact vectors are then read in the order of the upper bounds, and a query is done when no unread
bound reaches its k-th exact score.

Candidates and queries are dealt over a grid of large cells of bounded size. Every query is first searched in one lane of
candidates; its k-th score there goes to all other lanes, which read only what may still reach it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions

#: Candidates and queries in a cell of the grid, and candidates from which on more lanes are made for more tasks.
CELL_ROWS, CELL_QUERIES, LANE_ROWS = 32768, 8192, 1024
#: Quantised values of a dimension, and queries that are bounded at once.
LEVELS, _SOME = 16, 128
_FILE, _ASKED, _BOUND = 0, 1, 2


def scaled(vector_col: str, scale: int = 64) -> Column:
    """Each component as ``floor(scale * x)``; null where the vector or a component is null or not finite."""
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(finite, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long")))


class ApproximationFile:
    """Vectors as bytes on the grid ``low + step * byte`` beside their exact values."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, exact: np.ndarray, low: np.ndarray, step: np.ndarray) -> None:
        self.ids, self.exact, self.low, self.step = ids, exact, low, step
        most = float(np.abs(low).max(initial=0) + (LEVELS * step).max(initial=0))
        self.kind = np.float32 if most < 1e12 else np.float64
        self.codes = np.ascontiguousarray(codes.T.astype(self.kind))

    def scores(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each query and vector a number, and for each query what to add to it for the lower and for the upper bound."""
        products = (queries * self.step).astype(self.kind) @ self.codes
        start, wide = (queries @ self.low).astype(float), self.step - 1
        # The sum of rounded products is off by no more than this.
        slack = np.abs(queries).astype(float) @ (self.step * float(LEVELS)) * (queries.shape[1] + 2) * float(np.finfo(self.kind).eps)
        return products, start + np.minimum(queries, 0) @ wide - slack, start + np.maximum(queries, 0) @ wide + slack

    def nearest(self, query: np.ndarray, own: int, products: np.ndarray, low: float, high: float, k: int, known: float) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and exact scores of the k best of at least the ``known`` score, and how many vectors were read; ties go to the
        smaller id, so bounds that equal the k-th score are read too."""
        some = np.flatnonzero(products >= known - high) if known > -np.inf else np.arange(len(products))
        some = some[self.ids[some] != own]
        if len(some) > 2 * k:
            least = np.partition(products[some], len(some) - k)[len(some) - k]
            some = some[products[some] >= min(least, least + low - high)]
        order = some[np.argsort(-products[some], kind="stable")]
        best_i, best_s, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 2 * k
        while at < len(order) and (len(best_s) < k or products[order[at]] + high >= best_s[-1]):
            read = order[at : at + step]
            best_i, best_s = np.concatenate([best_i, self.ids[read]]), np.concatenate([best_s, self.exact[read].astype(np.int64) @ query])
            keep = np.lexsort((best_i, -best_s))[:k]
            best_i, best_s, at, step = best_i[keep], best_s[keep], at + step, 2 * step
        return best_i, best_s, min(at, len(order))


def _grids(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, str]]:
    """For each length of vectors the grid's lows and steps, and the smallest type of its exact values."""
    ends = rows.select(F.size("v").alias("width"), F.posexplode("v").alias("d", "x")).groupBy("width", "d").agg(F.min("x").alias("low"), F.max("x").alias("high")).collect()
    grids = {}
    for width in {r["width"] for r in ends}:
        own = sorted((r["d"], r["low"], r["high"]) for r in ends if r["width"] == width)
        low, high = (np.array([r[i] for r in own], np.int64) for i in (1, 2))
        kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low.min() and high.max() <= np.iinfo(t).max)
        grids[width] = low, (high - low) // LEVELS + 1, kind
    return grids


def _search(grids: dict[int, tuple[np.ndarray, np.ndarray, str]], k: int, first: bool):
    """A function over a cell's rows: what it finds for its queries, and in the first lane each query's k-th score."""
    empty = np.zeros(0, np.int64)

    def search(key: tuple, table: pa.Table) -> pa.Table:
        width = key[0].as_py()
        low, step, kind = grids.get(width, (empty, empty, "<i8"))
        of = table.column("kind").to_numpy()
        part = lambda column, which, dtype: np.frombuffer(b"".join(x for x, o in zip(table.column(column).to_pylist(), of, strict=True) if o == which), dtype)
        ids, asked = part("ids", _FILE, "<i8"), part("ids", _ASKED, "<i8")
        held = part("data", _FILE, kind).reshape(len(ids), width)
        queries = part("data", _ASKED, kind).reshape(len(asked), width).astype(np.int64)
        file = ApproximationFile(ids, part("codes", _FILE, np.uint8).reshape(len(ids), width), held, low, step)
        known = np.full(len(asked), -np.inf)
        told = part("ids", _BOUND, "<i8")
        if len(told):
            order = np.argsort(told)
            at = np.minimum(np.searchsorted(told, asked, sorter=order), len(told) - 1)
            same = told[order[at]] == asked
            known[same] = part("data", _BOUND, "<f8")[order[at]][same]
        found, reached, read = [], np.full(len(asked), -np.inf), 0
        for i in range(0, len(asked) if len(ids) else 0, _SOME):
            products, lows, highs = file.scores(queries[i : i + _SOME])
            for j in range(len(products)):
                best, scores, n = file.nearest(queries[i + j], asked[i + j], products[j], lows[j], highs[j], k, known[i + j])
                found.append((np.full(len(best), asked[i + j]), best, scores))
                read += n
                if len(best) == k:
                    reached[i + j] = scores[-1]
        columns = [np.concatenate([empty, *(f[c] for f in found)]) for c in range(3)]
        sure = reached > -np.inf
        return pa.table({
            "width": pa.array([width], pa.int32()), "block": pa.array([key[2].as_py()], pa.int32()), "n_read": pa.array([read], pa.int64()), "found": pa.array([np.stack(columns).tobytes()], pa.binary()),
            "ids": pa.array([asked[sure].tobytes() if first else b""], pa.binary()), "data": pa.array([reached[sure].tobytes() if first else b""], pa.binary()),
        })

    return search


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column("found").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.frombuffer(raw, "<i8").reshape(3, -1)], names=["query_id", "id", "score"])


def searched(vectors: DataFrame, queries: Column, k: int, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """A row for each cell, with what it found and how many exact vectors it read (``n_read``)."""
    value = scaled(vector_col, scale)
    rows = cut_lineage(vectors.select(F.col(id_col).cast("long").alias("id"), value.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & F.col("v").isNotNull()))
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    lanes = max(1, math.ceil(counts.n / CELL_ROWS), min(shuffle_partitions(vectors.sparkSession), counts.n // LANE_ROWS))
    blocks = max(1, math.ceil(counts.q / CELL_QUERIES))
    grids = _grids(rows)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        """The file and the queries of a lane; of rows repeated with one id and vector one stays, which asks if any does."""
        width, lane = (x.as_py() for x in key)
        low, step, kind = grids.get(width, (np.zeros(0, np.int64), np.zeros(0, np.int64), "<i8"))
        ids, asks = table.column("id").to_numpy(), np.asarray(table.column("asks").to_pylist(), bool)
        exact = np.asarray(table.column("v").combine_chunks().flatten()).reshape(len(ids), width)
        order = np.lexsort((~asks, *exact.T, ids))
        ids, asks, exact = ids[order], asks[order], exact[order]
        once = np.concatenate([[True], (ids[1:] != ids[:-1]) | (exact[1:] != exact[:-1]).any(axis=1)])
        ids, asks, exact = ids[once], asks[once], exact[once]
        codes = ((exact - low) // step).astype(np.uint8)
        sides = [(_FILE, ids, codes.tobytes(), exact), (_ASKED, ids[asks], b"", exact[asks])]
        return pa.table({
            "width": pa.array([width] * 2, pa.int32()), "lane": pa.array([lane] * 2, pa.int32()), "kind": pa.array([s[0] for s in sides], pa.int32()), "ids": pa.array([s[1].astype("<i8").tobytes() for s in sides], pa.binary()),
            "codes": pa.array([s[2] for s in sides], pa.binary()), "data": pa.array([s[3].astype(kind).tobytes() for s in sides], pa.binary()),
        })

    lane = F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int")
    packed = cut_lineage(rows.withColumn("width", F.size("v")).withColumn("lane", lane).groupBy("width", "lane").applyInArrow(pack, "width int, lane int, kind int, ids binary, codes binary, data binary"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["width", "lane", "block", "kind", "ids", "codes", "data"]
    held = packed.filter(F.col("kind") == _FILE).withColumn("block", every(blocks)).select(cell)
    asked = packed.filter((F.col("kind") == _ASKED) & (F.length("ids") > 0)).withColumn("block", F.col("lane") % blocks).withColumn("lane", every(lanes)).select(cell)
    grid, own = held.unionByName(asked), F.col("lane") == F.col("block") % lanes
    schema = "width int, block int, n_read long, found binary, ids binary, data binary"
    first = cut_lineage(grid.filter(own).groupBy("width", "lane", "block").applyInArrow(_search(grids, k, True), schema))
    if lanes == 1:
        return first
    bounds = first.filter(F.length("ids") > 0).select("width", every(lanes).alias("lane"), "block", F.lit(_BOUND).alias("kind"), "ids", F.lit(b"").alias("codes"), "data")
    rest = grid.unionByName(bounds).filter(~own).groupBy("width", "lane", "block").applyInArrow(_search(grids, k, False), schema)
    return first.unionByName(rest)


def top_k(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """``query_id, rank, id_col, score``: for each row where ``queries`` holds, its k best other rows by inner product.

    Vectors that are null or hold a null or non-finite component take no part, nor do null ids; of rows repeated with one id
    and vector one does. Ties go to the smaller id. Vectors of another length than the query's are not compared with it;
    empty ones have the score 0 with each other. Very long vectors only make their cells' bytes more. A query without any
    other row gives no row, and so does an empty table. Other columns are ignored, whatever their names. Scores are exact
    64-bit integers: components must keep them in that range, and scaled components below 2^62.
    """
    found = searched(vectors, queries, k, id_col, vector_col, scale).select("found").mapInArrow(_unpack, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
