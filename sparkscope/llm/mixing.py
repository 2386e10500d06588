"""Mixing sources to target weights, to the word.

Every document gets a hash-random key. Within a source the documents are sorted by it, in ranges of the key (each range a
group of its own, so a hot source spreads over the cluster); prefix sums of sizes run over the ranges and then within each,
and the source is cut at its exact budget. A budget above the source's size takes whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, ordinal, shuffle_partitions

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: A target stops at so many times its source's size.
MAX_EPOCHS = 3


def word_count(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to ``source, source_size``: each weight's share of the whole, the excess over the cap reshared.

    Filling by level: a source is capped when its cap over its weight is below the level, and each capped source raises the
    level of the rest. Every round is one aggregate over the sources; only its four sums reach the driver.
    """
    ranked = ordinal(sources, F.col("source").asc_nulls_last(), name="place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = cut_lineage(ranked.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * max_epochs))
    ratio = F.col("cap") / F.col("weight")
    level, capped = 0.0, -1
    while True:
        below = ratio < F.lit(level)
        row = table.agg(F.count_if(below).alias("n"), F.sum(F.when(~below, F.col("weight"))).alias("w"), F.sum(F.when(below, F.col("cap"))).alias("c"), F.sum("source_size").alias("s")).first()
        if row.n == capped or not row.w:
            break
        capped, level = row.n, ((row.s or 0) - (row.c or 0)) / row.w
    target = F.when(ratio < F.lit(level), F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(level))
    return table.select("source", "source_size", "n_rows", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: ``id_col, source, size, source_size, target, epochs, taken``.

    ``taken`` is the number of words that the mix takes of the document: its size for each whole epoch, and in the last,
    partial one its size, nothing, or at the cut the rest of the budget. Taken words add up to the target, rounded. Null
    texts have size 0; null sources form one source, the last; rows repeated with one id and size share its place in
    either order. Very long texts count all of their words; where one stands at the cut, it gives the rest of the budget. The
    keys are a digest of seed, epoch and id, so reruns agree; ties go by id, then size. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    sized = cut_lineage(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = source_targets(totals, weights, max_epochs)
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rows = sized.count()
    # Four ranges for each shuffle partition in all, shared out by rows: no range holds more than its part of a hot source.
    ranges = F.greatest(F.lit(1), F.ceil(F.col("n_rows") * 4 * shuffle_partitions(spark) / F.lit(max(1, rows)))).cast("long")
    plan = cut_lineage(targets.withColumn("budget", budget).withColumn("epochs", epochs).withColumn("ranges", ranges).drop("n_rows"))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("ranges") / F.lit(1 << 32)).cast("long")
    keyed = sized.join(plan, sized["source"].eqNullSafe(plan["source"])).drop(sized["source"]).withColumn("key", key).withColumn("part", part)
    upto = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # Ranges of a source number at most four times the shuffle partitions.
    offsets = keyed.groupBy("source", "part").agg(F.sum("size").alias("part_size")).withColumn("part_before", F.coalesce(F.sum("part_size").over(upto), F.lit(0))).drop("part_size")
    within = Window.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.alias("p").join(offsets.alias("o"), F.col("p.source").eqNullSafe(F.col("o.source")) & (F.col("p.part") == F.col("o.part")))
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("p.before") - F.col("o.part_before")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select(F.col("id").alias(id_col), F.col("p.source").alias("source"), "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"))
