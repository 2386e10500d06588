"""The manifest against a plain recursion over lists, and its edge cases."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from sparkscope.llm.manifest import folded, leaf_digest, manifest, proof

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])])


def tree(leaves):
    """The root of a list of digests, and each one's siblings by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for i, own in enumerate(at):
            paths[i].append((own % 8, runs[own // 8]))
        level, at = [H(*run) for run in runs], [own // 8 for own in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[name] = (own, *tree([leaf_of(r) for r in own]))
    root, upper = tree([trees[n][1] for n in names])
    out = []
    for name, above in zip(names, upper, strict=True):
        own, subroot, paths = trees[name]
        for row, path in zip(own, paths, strict=True):
            siblings = "".join("".join(run[:p] + run[p + 1 :]) for p, run in path + above)
            out.append((row[0], leaf_of(row), subroot, root, H(siblings)))
    return sorted(out, key=repr)


def results(found):
    rows = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256), folded(F.col("leaf"), F.col("path")) == F.col("root")).collect()
    assert all(r[5] for r in rows)
    return sorted([tuple(r)[:5] for r in rows], key=repr)


@pytest.mark.parametrize("sizes", [(1,), (8,), (9,), (64, 1), (65, 7, 8, 9), (520, 1, 3, 2, 1, 1, 1, 1, 10), (3,) * 70])
def test_as_by_plain_recursion(spark, sizes):
    rng = random.Random(len(sizes))
    rows = [(rng.randrange(10**6) * 100 + g, f"s{i % 3}", f"l{g}", i, f"text {i} é") for g, n in enumerate(sizes) for i in range(n)]
    assert results(manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_empty_texts_repeats_and_long_texts(spark):
    rows = [
        (1, None, None, None, None), (2, "", "", 0, ""), (None, "a", "en", 1, "x"), (3, "a", "en", 1, "x"), (3, "a", "en", 1, "x"), (3, "b", "en", 1, "x"),
        (4, "a", "en", None, "X" * 3_000_000), (-5, "a", None, -1, "é\n"), (6, "ü", "ü", 2, "-"), (7, "z", "z", 2, "1:-"), *[(9, "same", "en", 4, "copy")] * 30,
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert results(manifest(docs)) == brute(rows)


def test_clashing_columns_are_ignored(spark):
    rows = [(i, "s", "en", i, "t") for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    more = docs
    for name in ("g", "idx", "n", "hash", "path", "run", "parent", "leaf", "root", "id", "place"):
        more = more.withColumn(name, F.lit("clash"))
    assert results(manifest(more)) == brute(rows)


def test_a_change_shows_in_the_root_it_leads_to(spark):
    rows = [(i, "s", f"l{i % 3}", i, f"Text {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    seen = F.when(F.col("doc_id") == 42, F.lit("changed")).otherwise(F.col("text"))
    found = manifest(docs, also={"seen": leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), seen)})
    wrong = found.filter(folded(F.col("seen"), F.col("path")) != F.col("root")).collect()
    assert [r["doc_id"] for r in wrong] == [42]


def test_empty_table(spark):
    found = manifest(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "path"]
