"""Substring dedup and top-k search against plain brute force, language ID on held-out labels."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscope.llm import languages, queries
from sparkscope.llm.substrings import remove_repeats
from sparkscope.llm.vectors import top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, block string, part int, n long, kept string, spans int"
SHARED = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"


def _cases():
    texts = [None, "", " \t ", SHARED, "x " + SHARED + " y", SHARED, SHARED + " " + SHARED, "z " * 40, "z " * 13, "z " * 12, "a b  c\td", "é" * 50,
             "word " * 30000 + SHARED, "\x00 \x1c \x85 \xa0 " + SHARED, SHARED.upper(), " ".join(SHARED.split()[1:14]), " ".join(SHARED.split()[:12])]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, SHARED), (None, "q " + SHARED), (None, None), (-5, "w " + SHARED)]
    return [(*r, "clash", 1, 2, "clash", 3) for r in rows]


def _without_repeats(rows, size):
    words = [(key, WORD.findall(text or "")) for key, text in rows]
    least = {}
    rank = lambda key: math.inf if key is None else key
    for key, w in words:
        for i in range(len(w) - size + 1):
            s = tuple(w[i : i + size])
            least[s] = min(least.get(s, math.inf), rank(key))
    out = Counter()
    for key, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if least[tuple(w[i : i + size])] < rank(key):
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[key, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("which", ["cases", "small"])
@pytest.mark.parametrize("size", [13, 3])
def test_remove_repeats(spark, which, size):
    table = spark.createDataFrame(_cases(), SCHEMA).repartition(3) if which == "cases" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    expected = _without_repeats([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()], size)
    got = remove_repeats(table, size).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == expected
    assert any(r["n_removed"] for r in got)


def test_remove_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    assert remove_repeats(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).select("n_words", "kept").distinct().collect() == [(0, "")]


def test_a_frequent_anchor_is_divided(spark):
    """A five-word phrase that is the anchor everywhere, among words that differ, must not fill a single group."""
    import zstandard

    from sparkscope.llm import substrings

    rng = np.random.default_rng(4)
    phrases = [f"ab{i} cd ef gh ij" for i in range(20000)]
    words = substrings.Words([p.encode() for p in phrases], 5)
    phrase = phrases[int(np.argmin(words.runs(5, words.at)))]
    some = lambda: " ".join(f"w{x}" for x in rng.integers(0, 300, 8))
    rows = [(i, f"{some()} {phrase} {some()}") for i in range(1500)]
    rows += [(5000 + i, f"{i} {rows[i][1]} end") for i in range(100)]
    docs = spark.createDataFrame(rows, "id long, text string")
    parts, share = 4, 1 / 64
    packed = substrings._packed(docs, parts)
    survey = substrings._survey(packed, parts, share, 13)
    frequent = {}
    for r in survey.filter("block < 0").collect():
        frequent[-r["block"]] = np.concatenate([frequent.get(-r["block"], np.zeros(0, np.int64)), np.frombuffer(r["data"], np.int64)])
    sizes = Counter()
    for r in substrings._suffixes(packed, survey.filter("block >= 0"), frequent, parts, 13).collect():
        sizes[r["part"]] += len(zstandard.ZstdDecompressor().decompress(r["data"]))
    assert max(sizes.values()) < 0.4 * sum(sizes.values())
    got = remove_repeats(docs, 13, "id").select("id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, got)) == _without_repeats(rows, 13) and any(r["n_removed"] for r in got)


def _best(rows, k=20):
    vectors = {}
    for key, v in rows:
        if key is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vectors[key, tuple(math.floor(64.0 * x) for x in v)] = None
    out = set()
    for q, v in vectors:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in vectors if i != q and len(w) == len(v))
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got = top_k(table, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert {tuple(r) for r in got} == _best(rows) and len(got) == len(_best(rows))


def test_top_k_cases(spark, monkeypatch):
    from sparkscope.llm import vectors

    monkeypatch.setattr(vectors, "CELL_ROWS", 16)
    monkeypatch.setattr(vectors, "CELL_QUERIES", 2)
    monkeypatch.setattr(vectors, "LANE_ROWS", 8)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(150)]
    rows += [(i, [0.5, 0.25, -0.5, 0.125]) for i in range(200, 300)]
    rows += [(400, None), (420, [1.0, None, 0.0, 0.0]), (440, [1.0, float("nan"), 0.0, 0.0]), (460, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (480, [1.0, 2.0]), (481, [0.5, 2.0]), (500, []), (501, []), (520, [3.0])]
    rows += [(0, rows[0][1]), (200, rows[150][1])]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, v string, score int")
    got = top_k(table, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert {tuple(r) for r in got} == _best(rows) and len(got) == len(_best(rows))
    assert top_k(table.filter("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_bounds_hold_and_spare_reads(spark, monkeypatch):
    from sparkscope.llm import vectors

    rng = np.random.default_rng(6)
    low, exact = np.array([-64, -50, 0, 7], np.int64), rng.integers(-50, 60, (500, 4)) + np.array([0, 0, 60, 60])
    low, high = exact.min(axis=0), exact.max(axis=0)
    step = (high - low) // vectors.LEVELS + 1
    file = vectors.ApproximationFile(np.arange(500), (exact - low) // step, exact, low, step)
    queries = rng.integers(-64, 64, (50, 4))
    products, lows, highs = file.scores(queries)
    scores = queries @ exact.T
    assert (products + lows[:, None] <= scores).all() and (scores <= products + highs[:, None]).all()
    centres = rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + rng.normal(size=16) / 8).astype(np.float32).tolist()) for i in range(4000)]
    monkeypatch.setattr(vectors, "CELL_ROWS", 500)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    read = vectors.searched(table, F.col("vec_id") % 20 == 0, 20, "vec_id", "embedding", 64).agg(F.sum("n_read")).first()[0]
    assert read < 0.2 * 4000 * 200
    got = top_k(table, F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score").collect()
    assert {tuple(r) for r in got} == _best(rows)


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    train, held = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    model = languages.fit(train)
    blind = held.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string"))
    got = languages.identify_documents(blind, model).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == held.count()
    assert sum(r["language"] == r["lang"] for r in got) > 0.95 * len(got)
    assert sum(r["accepted"] for r in got) > 0.99 * len(got)


def test_a_root_element_after_a_long_preamble_declares_its_language(spark):
    preamble = "<!-- " + "licence " * 400 + "-->"
    pages = spark.createDataFrame([(0, preamble + "<html class=x lang='fr'><body>"), (1, preamble + "<html><p lang=de>"), (2, "<html lang=es>")], "n int, html string")
    assert dict(pages.select("n", languages.markup_language(F.col("html"))).collect()) == {0: "fr", 1: None, 2: "es"}


def test_languages_of_pages(spark):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").filter("page_id IS NOT NULL").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", F.regexp_extract("url", r"//[^/]+/([a-z]{2})/", 1).alias("path")), "page_id").filter("path IN ('en', 'de', 'fr', 'es')").collect()
    assert len(got) > 200
    assert sum(r["language"] == r["path"] for r in got) > 0.95 * len(got)


def test_evidence_is_fused(spark):
    train = [(i, "the and that with this from have", "en", "h1") for i in range(30)] + [(100 + i, "der die und das nicht mit ist", "de", "h2") for i in range(30)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string, source string")
    model = languages.fit(docs)
    # Letters that neither language has leave the likelihoods even: the declaration or the host decides.
    odd = [(1000, "zzq zzq", "de", None), (1001, "zzq zzq", None, "h2"), (1002, "zzq zzq", None, "h1"), (1003, None, "en", "h1"), (1004, " 12 %", "en", "h1"), (1005, "", None, None)]
    both = docs.union(spark.createDataFrame(odd, docs.schema))
    got = {r["doc_id"]: r for r in languages.identify_documents(both, model, declared=F.col("lang")).collect()}
    assert len(got) == 66
    assert [got[i]["language"] for i in (1000, 1001, 1002)] == ["de", "de", "en"]
    assert not any(got[i]["accepted"] for i in (1003, 1004, 1005))
    assert all(got[i]["accepted"] and got[i]["language"] == lang for i, _, lang, _ in train)


def test_languages_without_rows_or_labels(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert languages.identify_documents(none, languages.fit(none)).count() == 0
    docs = spark.createDataFrame([(1, "some text", None, None)], none.schema)
    assert languages.identify_documents(docs, languages.fit(docs)).select("language", "accepted").collect() == [(None, False)]


def test_page_markup(spark):
    pages = spark.createDataFrame([(1, None, None), (2, "", ""), (3, "https://www.example.DE:80/x", '<!DOCTYPE html><HTML class="a" lang="De-ch"><script>the and that</script><p>der die und das</p></HTML>')], "page_id long, url string, html string")
    docs = spark.createDataFrame([(1, "the and that", "en"), (2, "der die und das", "de")], "doc_id long, text string, lang string")
    got = {r["page_id"]: r for r in languages.identify_pages(pages, languages.fit(docs)).collect()}
    assert (got[3]["declared"], got[3]["host"], got[3]["suffix"], got[3]["language"]) == ("de", "www.example.de", "de", "de")
    assert not got[1]["accepted"] and not got[2]["accepted"]


def test_words_decide_where_digests_coincide():
    from sparkscope.llm.substrings import Words

    words = Words([b"a b c d", b"a b c e", b"a b c d", b"x y z w", b"a b c e"], 4)
    at, sizes = words.at, np.full(5, 4)
    one, number = words.equals(np.zeros(5, np.uint64), at, sizes)
    assert [number[i] == number[j] for i, j in ((0, 2), (1, 4), (0, 1), (0, 3), (1, 3))] == [True, True, False, False, False]
    assert [words.texts_at(at[one], sizes[one])[n] for n in number] == [b"a b c d", b"a b c e", b"a b c d", b"x y z w", b"a b c e"]
    one, number = words.equals(words.runs(4, at), at, sizes)
    assert number[0] == number[2] and number[1] == number[4] and len(one) == 3
