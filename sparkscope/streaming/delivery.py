"""Delivery (S1): what a batch can't take is found, tried again with later batches, and buried after five retries.

A stream's batch fails as a whole, whatever item is at fault. Where a function judges the items, those that it names are taken out
first, however many, in one pass over the batch and without the driver. A batch that fails even so is split by hash, halves of
halves in parallel, until each failing item stands alone; the rest is processed as one batch. Failed items wait in a table with their attempts and last
error, and join the next batches until they are through or their retries are used up; then they lie in ``buried``, from where
``replay`` puts them back. All of it is written per batch, so a batch that runs again after a crash finds and leaves the same.
"""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import sinks

#: Fixed value: retries after the first attempt, before an item is buried.
RETRIES = 5
#: Failing items, found by splitting, up to which a batch's failure counts as theirs; beyond, as the system's.
MOST_FAILING = 1000
_DEPTH = 62


class SystemFailure(RuntimeError):
    """A batch that fails though no item does, or in which too many do: the stream stops and starts again from its checkpoint."""


class Delivery:
    """A ``foreachBatch`` function around ``process(rows, batch_id)``; ``check(rows)`` reads the same without writing, and
    ``judge(rows)``, where there is one, gives the rows that can't be taken with why as ``error`` (null: the row can be taken).

    Tables below ``root``: ``judged`` (items that ``judge`` named, with ``error``), ``work`` (the rows of each batch, new ones and those tried again, with ``item`` and ``attempts``),
    ``waiting`` and ``buried`` (the rows of items that failed, with ``attempts`` and ``error``), ``replayed``.
    """

    def __init__(self, spark: SparkSession, root: str, process: Callable[[DataFrame, int], None], check: Callable[[DataFrame], None], retries: int = RETRIES, parallel: int = 8, judge: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.spark, self.root, self.process, self.check, self.retries, self.parallel, self.judge = spark, root, process, check, retries, parallel, judge

    def _path(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/batch_id={batch_id}"

    def _read(self, table: str, batch_id: int) -> DataFrame | None:
        path = self._path(table, batch_id)
        return self.spark.read.parquet(path) if sinks.exists(self.spark, f"{path}/_SUCCESS") else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        item = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        work = batch.withColumn("item", item).withColumn("attempts", F.lit(0))
        for again in (self._read("waiting", batch_id - 1), self._read("replayed", batch_id - 1)):
            if again is not None:
                work = work.unionByName(again.select(*columns, "item", "attempts"))
        work.write.mode("overwrite").parquet(self._path("work", batch_id))
        work = self.spark.read.parquet(self._path("work", batch_id))
        judged, sound = self._judged(work, batch_id)
        failed = self._attempt(sound, columns, batch_id)
        lost = work.join(F.broadcast(self.spark.createDataFrame(list(failed.items()), "item string, error string")), "item")  # at most MOST_FAILING rows
        lost = lost if judged is None else lost.unionByName(work.join(judged, "item"))
        lost = lost.withColumn("attempts", F.col("attempts") + 1)
        over = F.col("attempts") > self.retries
        lost.filter(over).write.mode("overwrite").parquet(self._path("buried", batch_id))
        lost.filter(~over).write.mode("overwrite").parquet(self._path("waiting", batch_id))

    def _judged(self, work: DataFrame, batch_id: int) -> tuple[DataFrame | None, DataFrame]:
        """The items that are judged to fail with their errors, and the rows of all others."""
        if self.judge is None:
            return None, work
        # An item is all rows of one content: it fails with any of them.
        named = self.judge(work).filter(F.col("error").isNotNull()).groupBy("item").agg(F.substring(F.min("error"), 1, 1000).alias("error"))
        named.write.mode("overwrite").parquet(self._path("judged", batch_id))
        judged = self.spark.read.parquet(self._path("judged", batch_id))
        return judged, work.join(judged, "item", "left_anti")

    def _attempt(self, work: DataFrame, columns: list[str], batch_id: int) -> dict[str, str]:
        """Process what can be; the failed items with their errors."""
        try:
            self.process(work.select(*columns), batch_id)
            return {}
        except Exception as error:  # noqa: BLE001 - whatever it is, it is the batch's failure until an item is found
            failed = self._failing(work, columns)
            if not failed and not self._passes(work, columns)[0]:
                raise SystemFailure("the batch fails, but none of its items") from error
        ledger = self.spark.createDataFrame([(i,) for i in failed], "item string")
        rest = work.join(F.broadcast(ledger), "item", "left_anti") if failed else work
        self.process(rest.select(*columns), batch_id)
        return failed

    def _passes(self, work: DataFrame, columns: list[str]) -> tuple[bool, str]:
        try:
            self.check(work.select(*columns))
            return True, ""
        except Exception as error:  # noqa: BLE001
            return False, f"{type(error).__name__}: {str(error).strip().splitlines()[-1] if str(error).strip() else ''}"[:1000]

    def _failing(self, work: DataFrame, columns: list[str]) -> dict[str, str]:
        """Split the failing parts by one more bit of the items' hash until each is one item."""
        place, parts, found = F.xxhash64("item"), [(0, 0)], {}
        with ThreadPool(self.parallel) as pool:
            for depth in range(_DEPTH + 1):
                rows = [work.filter(F.pmod(place, F.lit(1 << depth)) == low) for _, low in parts]
                broken = [(r, low, told[1]) for r, (_, low), told in zip(rows, parts, pool.map(lambda r: self._passes(r, columns), rows), strict=True) if not told[0]]
                parts = []
                for (own, low, error), items in zip(broken, pool.map(lambda b: [x["item"] for x in b[0].select("item").distinct().limit(2).collect()], broken), strict=True):
                    if len(items) == 1:
                        found[items[0]] = error
                    elif items:
                        parts += [(depth + 1, low), (depth + 1, low + (1 << depth))]
                if len(found) + len(parts) > MOST_FAILING:
                    raise SystemFailure(f"more than {MOST_FAILING} items fail")
                if not parts:
                    break
        return found

    def table(self, name: str) -> DataFrame:
        """``waiting`` items, which are those of the newest batch, or ``buried`` ones that were not put back since."""
        rows = self.spark.read.parquet(f"{self.root}/{name}")
        if name != "waiting":
            if not sinks.exists(self.spark, f"{self.root}/replayed"):
                return rows
            again = self.spark.read.parquet(f"{self.root}/replayed").groupBy("item").agg(F.max("batch_id").alias("replayed_at"))
            return rows.join(again, "item", "left").filter(F.col("replayed_at").isNull() | (F.col("replayed_at") < F.col("batch_id"))).drop("replayed_at")
        newest = self.spark.read.parquet(f"{self.root}/work").agg(F.max("batch_id")).first()[0]
        return rows.filter(F.col("batch_id") == newest)

    def replay(self, batch_id: int, items: DataFrame | None = None) -> int:
        """Put buried items (all, or those in ``items``) before the batch after ``batch_id``, with no attempts; how many."""
        rows = self.table("buried").drop("batch_id")
        rows = (rows if items is None else rows.join(items.select("item"), "item", "left_semi")).withColumn("attempts", F.lit(0)).drop("error")
        rows.write.mode("overwrite").parquet(self._path("replayed", batch_id))
        return self.spark.read.parquet(self._path("replayed", batch_id)).count()
