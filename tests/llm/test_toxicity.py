"""Toxicity: what a token stands for, features, held-out quality, and edge cases."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscope.llm import toxicity
from sparkscope.llm.toxicity import FEATURES, Reader, fit, lexicons, readings, score, training_rows

DOCS, LABELS = "doc_id long, text string, source string, lang string", "doc_id long, toxic int"
INSULTS = ("blockhead", "nitwit", "dimwits", "grunzkopfen", "grunzkopfer")


def corpus(n=600, seed=3):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioubcdfgl") for _ in range(rng.randrange(3, 9))) for _ in range(900)]
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        text = [rng.choice(plain) for _ in range(rng.randrange(20, 160))]
        for at in range(5, len(text), 25) if toxic else ():
            text[at] = rng.choice(INSULTS)
        docs.append((i, " ".join(text) + ".", f"s{i % 4}", "en"))
        labels.append((i, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    return d, y, fit(d, y)


def test_readings_see_through_obfuscation():
    shown = lambda t: {w for w, hides in readings(t) if hides}
    assert readings("Nitwit,") == [("nitwit", False)]
    for hidden in ("n1tw1t", "n.i.t.w.i.t", "N-I-T-W-I-T!", "niiiitwit", "n!tw!t"):
        assert "nitwit" in shown(hidden), hidden
    assert "ass" in shown("@ss") and readings("---") == [] and readings("42.") == []


def test_features_of_a_text():
    reader = Reader({"nitwit": 2.0, "bloc-": 3.0})
    at = lambda text, name: reader.features(text.encode())[FEATURES.index(name)]
    assert reader.features(b"") == reader.features(b" \n") == [0.0] * len(FEATURES)
    assert at("a nitwit and blockheads here", "weight") == pytest.approx(1.0) and at("a nitwit and blockheads here", "heaviest") == 3.0
    assert at("you are a nitwit", "near_you") == 0.25 and at("a nitwit " + "so " * 9 + "you", "near_you") == 0
    assert at("n1tw1t ok", "hidden") == 0.5 and at("n i t w i t is", "weight") > 0
    assert at("AB cd", "capitals") == 0.5 and at("STOP now", "shouted") == 0.5 and at("oh!!", "exclaimed") == 2


def test_held_out_rows_are_told_apart(spark, fitted):
    docs, labels, model = fitted
    rows = score(docs, model).join(labels, "doc_id").collect()
    assert len(rows) == 600
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) >= 0.97 * len(held)
    assert {"blockhead", "nitwit"} <= set(model.lexicon) and any(e.startswith("grunzko") and e.endswith("-") for e in model.lexicon)


def test_held_out_labels_and_other_columns_make_no_score(spark, fitted):
    docs, labels, model = fitted
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.select("doc_id", "text", F.lit("x").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(1).alias("features"), F.lit(2).alias("fold"), F.lit(0.5).alias("score"), F.lit("y").alias("id"))
    again = fit(other, flipped)
    assert again.lexicon == model.lexicon
    told = lambda d, m: {r["doc_id"]: r["score"] for r in score(d, m).collect()}
    assert told(other, again) == told(docs, model)


def test_nulls_empty_long_and_repeated_texts(spark, fitted):
    model = fitted[2]
    rows = [(1, None, None, None), (None, "", None, None), (2, " ", None, None), (3, "nitwit " * 200_000, None, None), (4, "plain words here", None, None), (4, "plain words here", None, None), (5, "x" * 1_000_000, None, None)]
    found = score(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(found) == 7 and all(0 <= r["score"] <= 1 for r in found)
    assert len({r["score"] for r in found if r["doc_id"] in (1, None, 2)}) == 1 and len({r["score"] for r in found if r["doc_id"] == 4}) == 1
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert score(spark.createDataFrame([], DOCS), model).count() == 0


def test_isotonic_steps_are_the_least_squares():
    rng = np.random.default_rng(1)
    p, y, w = rng.random(60).round(1), (rng.random(60) < 0.4).astype(float), rng.integers(1, 4, 60).astype(float)
    steps = toxicity.isotonic(p, y, w)
    found = np.interp(p, *steps)
    assert (np.diff(steps[1]) >= 0).all() and (np.diff(steps[0]) > 0).all()
    # The mean of every block is that of its rows, and no block could be split at a gain.
    values = np.unique(p)
    mean = lambda lo, hi: np.average(y[(p >= lo) & (p <= hi)], weights=w[(p >= lo) & (p <= hi)])
    for v in values:
        wanted = max(min(mean(lo, hi) for hi in values if hi >= v) for lo in values if lo <= v)
        assert found[p == v] == pytest.approx(wanted)


def test_trees_learn_what_a_sum_does_not_tell():
    rng = np.random.default_rng(2)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(float)
    p = toxicity.grow(x, y).probability(x)
    assert ((p > 0.5) == (y > 0)).mean() > 0.97 and (toxicity.grow(x, y).probability(x) == p).all()
    flat = toxicity.grow(np.zeros((20, 2)), np.arange(20) % 2)
    assert flat.probability(np.ones((3, 2))) == pytest.approx([0.5] * 3, abs=0.01)


@pytest.mark.parametrize(("labels", "share"), [([], 0.0), ([(i, 0) for i in range(9)], 0.0), ([(i, 1) for i in range(9)], 1.0), ([(None, 1), (3, None)], 0.0)])
def test_nothing_to_learn(spark, labels, share):
    docs = spark.createDataFrame([(i, "a b c", None, None) for i in range(9)], DOCS)
    found = score(docs, fit(docs, spark.createDataFrame(labels, LABELS))).collect()
    assert {r["score"] for r in found} == {share}


def test_few_rows_and_repeated_labels(spark):
    docs = spark.createDataFrame([(i, "nitwit you" if i % 2 else "fine day", None, None) for i in range(30)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)] * 2, LABELS)
    assert all(0 <= r["score"] <= 1 for r in score(docs, fit(docs, labels)).collect())


def test_the_sample_is_bounded_and_entries_are_counted_for_other_folds(spark):
    docs, labels = corpus()
    d, y = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    sample = training_rows(d, y, "doc_id", "text", "toxic", 40)
    counts = {r["y"]: (r["n"], r["w"]) for r in sample.groupBy("y").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    known = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    assert counts[0][0] == counts[1][0] == 40
    assert counts[0][1] == pytest.approx(sum(t == 0 for _, t in known)) and counts[1][1] == pytest.approx(sum(t for _, t in known))
    rows = spark.createDataFrame([(f, y, t, 1.0) for f in range(4) for y, t in [(1, "nitwit low")] * (6 if f == 2 else 0) + [(0, "calm day")] * 60 + [(1, "boor")] * 2], "fold int, y int, text string, weight double")
    found = lexicons(rows)
    assert "nitwit" in found[-1] and "nitwit" in found[0] and "nitwit" not in found[2] and "boor" in found[2]
