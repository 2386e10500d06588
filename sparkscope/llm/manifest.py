"""Merkle dataset manifest, a level at a time.

Leaves are digests of rows, numbered within their group along range partitions. A window over each group's runs of eight
consecutive nodes lists the run in order: joined it is what the parent is the digest of, and without the node itself it is the
node's siblings. One node of each run stands for the parent at the next level. The tops of all groups make one more tree.
Paths are then handed down from the root, each node taking its parent's, so that every level is joined once to the next.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

#: Consecutive nodes below a parent, as a power of two.
FANOUT_BITS = 3
FANOUT = 1 << FANOUT_BITS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<place:int,run:array<string>>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: each value as its byte count, a colon and itself, a null as a dash; numbers in decimal."""
    text = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text])


def _numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Add ``idx``, a row's number from 0 within ``g`` by ``order``, and ``n``, the group's rows.

    Range partitions hold the order, whichever group is large; what is added up is one count for each group in a partition.
    """
    ranged = rows.repartitionByRange(F.col("g"), *order).sortWithinPartitions(F.col("g"), *order)
    placed = cut_lineage(ranged.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before = Window.partitionBy("g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("g", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    starts = counts.select("g", "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_n").over(Window.partitionBy("g")).alias("n"))
    return placed.join(starts, ["g", "_part"]).withColumn("idx", F.col("_at") + F.col("_offset")).drop("_at", "_part", "_offset")


def _levels(nodes: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """All levels of the trees over ``g, idx, n, hash`` with each node's ``run``, and the tops: nodes alone at their level.

    Other columns stay with the first level. The number of levels grows with the logarithm of the largest group.
    """
    levels, tops = [], []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        tops.append(nodes.filter("n = 1"))
        if most <= 1:
            return levels, tops
        run = Window.partitionBy("g", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        level = cut_lineage(nodes.filter("n > 1").withColumn("parent", F.shiftright("idx", FANOUT_BITS)).withColumn("run", F.collect_list("hash").over(run)))
        levels.append(level)
        first = level.filter(F.col("idx").bitwiseAND(F.lit(FANOUT - 1)) == 0)
        up = F.shiftright(F.col("n") + (FANOUT - 1), FANOUT_BITS)
        nodes, most = first.select("g", F.col("parent").alias("idx"), up.alias("n"), digest(F.array_join("run", "")).alias("hash")), (most + FANOUT - 1) >> FANOUT_BITS


def _handed_down(levels: list[DataFrame], tops: list[DataFrame], above: DataFrame, carried: Sequence[str]) -> DataFrame:
    """Nodes of the first level with ``path``, the runs from their own to the root, and the columns of ``above``.

    ``above`` has each group's ``g`` with its top's ``path``.
    """
    held = [c for c in above.columns if c not in ("g", "path")]
    rest = [above["path"], *[above[c] for c in held]]
    topped = [top.join(above, "g") for top in tops]
    paths = topped[-1]
    for k in range(len(levels) - 1, -1, -1):
        own = F.struct(F.col("idx").bitwiseAND(F.lit(FANOUT - 1)).cast("int").alias("place"), "run")
        higher = paths.select("g", F.col("idx").alias("parent"), F.col("path").alias("_up"), *held)
        more = list(carried) if k == 0 else []
        joined = levels[k].join(higher, ["g", "parent"]).select("g", "idx", "hash", *more, F.concat(F.array(own), "_up").cast(PATH).alias("path"), *held)
        paths = joined.unionByName(topped[k].select("g", "idx", "hash", *more, *rest))
    return paths.select("idx", "hash", *carried, "path", *held)


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = COLUMNS, also: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, leaf, subroot, root, path`` and the columns ``also``.

    A leaf is the digest of ``columns``. Leaves stand in their group by id, null ids first, rows with one id by their digest;
    equal rows are interchangeable and each has its own leaf. A null group is a group, before all others, which stand by their
    bytes; an empty name is another one. Null values, empty texts and very long ones are leaves like any others: texts are
    digested whole and move no further. ``path`` has ``place, run`` for each level from the leaf to the root; a level where the
    node is alone with no level above has none, a run of one node has no siblings. An empty table gives an empty result. Other
    columns are ignored, whatever their names.
    """
    more = dict(also or {})
    name = F.col(group_col).cast("string")
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("g"), F.col(id_col).alias("id"), leaf_digest(*[F.col(c) for c in columns]).alias("hash"),
        *[c.alias(f"also_{k}") for k, c in more.items()], F.monotonically_increasing_id().alias("_tie"))
    # Rows that are equal in all else are told apart by where they were read, fixed before they are sorted.
    leaves = _numbered(cut_lineage(rows), F.col("id").asc_nulls_first(), F.col("hash"), F.col("_tie")).drop("_tie")
    levels, tops = _levels(leaves)
    subroots = tops[0].select("g", "hash")
    for top in tops[1:]:
        subroots = subroots.unionByName(top.select("g", "hash"))
    roots = _numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), "hash"), F.col("id"))
    high, last = _levels(roots)
    found = last[-1].first()
    root = found["hash"] if found else None
    whole = docs.sparkSession.createDataFrame([("",)], "g string").withColumn("path", F.array().cast(PATH))
    above = _handed_down(high, last, whole, ["id"]).select(F.col("id").alias("g"), "path", F.col("hash").alias("subroot"))
    held = ["id", *[f"also_{k}" for k in more]]
    told = _handed_down(levels, tops, cut_lineage(above), held)
    return told.select(F.col("id").alias(id_col), F.col("hash").alias("leaf"), "subroot", F.lit(root).alias("root"), "path", *[F.col(f"also_{k}").alias(k) for k in more])


def proof(path: Column) -> Column:
    """All siblings from the leaf's run to the root's, left to right, as one text."""
    return F.array_join(F.flatten(F.transform(path, lambda s: F.filter(s["run"], lambda _, i: i != s["place"]))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to with the siblings of ``path``."""
    around = lambda h, s: digest(F.array_join(F.slice(s["run"], F.lit(1), s["place"]), ""), h, F.array_join(F.slice(s["run"], s["place"] + 2, F.lit(FANOUT)), ""))
    return F.aggregate(path, leaf, around)


def lower_ascii(text: Column) -> Column:
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())
