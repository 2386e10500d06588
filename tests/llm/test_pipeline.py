"""The corpus pipeline's stages against brute force, and its near-dedup on planted copies."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from sparkscope.llm import simhash  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}{c}" for a in "btkmrs" for b in "aeiou" for c in ("ne", "lo", "mi", "rd")]


def _text(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def _edited(rng, text, n):
    words = text.split(" ")
    for i in rng.choice(len(words), n, replace=False):
        words[i] = "edited"
    return " ".join(words)


def _shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _similar(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def planted(spark):
    """Sixty texts and for each a copy with a few words changed, and sixty that only share a passage of sixty words."""
    rng = np.random.default_rng(11)
    texts = [_text(rng, int(n)) for n in rng.integers(120, 900, 60)]
    passage = _text(rng, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, _edited(rng, t, max(1, len(t.split()) // 120))) for i, t in enumerate(texts)]
    rows += [(200 + i, _text(rng, 300) + " " + passage + " " + _text(rng, 100)) for i in range(60)]
    return spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in rows], SCHEMA), dict(rows)


def test_similar_texts_are_one_group(planted):
    docs, texts = planted
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    shingles = {k: _shingles(t) for k, t in texts.items()}
    near = [i for i in range(60) if _similar(shingles[i], shingles[100 + i]) >= 0.85]
    assert len(near) >= 50
    assert sum(got[100 + i] == i for i in near) >= 0.97 * len(near)
    assert all(got[k] == k for k in texts if k < 100 or k >= 200)


def test_pairs_are_found_as_often_as_wanted():
    rng = np.random.default_rng(2)
    n, share = 3000, simhash.differing_share(0.8)
    a = rng.integers(0, 2**63, (n, simhash.WIDE_WORDS), dtype=np.uint64)
    flips = np.packbits(rng.random((n, simhash.WIDE_WORDS, 64)) < share, axis=-1, bitorder="little").view("<u8").reshape(n, -1)
    for rows in (10**4, 10**6):
        found = np.zeros(n, bool)
        for blocks in simhash.table_plan(rows, 0.8):
            sides = [simhash._cover(simhash._block_values(x, blocks), np.full(n, simhash.EXCESS)) for x in (a, a ^ flips)]
            keys = [set(zip(row.tolist(), anchor.tolist(), strict=True)) for row, anchor, _ in sides]
            found[[row for row, _ in keys[0] & keys[1]]] = True
        assert found.mean() > 0.95


@pytest.mark.parametrize("rows", [150_000, 2 * 10**6, 10**7])
def test_the_found_share_holds_at_every_size(rows):
    """Over the real plan, with the limit on differing bits: blocks that tables share would miss the same pairs."""
    rng = np.random.default_rng(3)
    plan, n, share = simhash.table_plan(rows, 0.8), 4000, simhash.differing_share(0.8)
    words = max(simhash.WIDE_WORDS, -(-(int(plan.max()) + 1) * 7 // 64))
    a = rng.integers(0, 2**63, (n, words), dtype=np.uint64)
    b = a ^ np.packbits(rng.random((n, words, 64)) < share, axis=-1, bitorder="little").view("<u8").reshape(n, -1)
    found = np.zeros(n, bool)
    for blocks in plan:
        sides = [simhash._cover(simhash._block_values(x, blocks), np.full(n, simhash.EXCESS)) for x in (a, b)]
        keys = [set(zip(row.tolist(), anchor.tolist(), strict=True)) for row, anchor, _ in sides]
        found[[row for row, _ in keys[0] & keys[1]]] = True
    compared = getattr(simhash, "COMPARED_WORDS", simhash.WIDE_WORDS)
    most = np.floor(64 * compared * share + simhash.DEVIATIONS * np.sqrt(64 * compared * share * (1 - share)))
    found &= simhash._apart(a[:, :compared], b[:, :compared]) <= most
    print(f"{rows} rows: {plan.shape} plan, {found.mean():.4f} found")
    assert found.mean() >= simhash.FOUND - 0.003


def test_a_large_group_of_copies_is_one_component(spark):
    rng = np.random.default_rng(5)
    base = _text(rng, 400)
    rows = [(i, _edited(rng, base, 3)) for i in range(1500)] + [(5000 + i, _text(rng, 50)) for i in range(200)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(1500)} == {0}
    assert all(got[5000 + i] == 5000 + i for i in range(200))


@pytest.mark.parametrize("cell", [1024, 16])
def test_only_texts_of_the_wanted_similarity_link(spark, monkeypatch, cell):
    """Planted pairs at 0.6 to 0.85, and a family whose members are as far apart, against brute-force Jaccard."""
    monkeypatch.setattr(simhash, "CELL_TEXTS", cell, raising=False)
    monkeypatch.setattr(simhash, "LEADERS", 4, raising=False)
    rng = np.random.default_rng(21)
    texts = {}
    for i in range(80):
        texts[i] = _text(rng, 300)
        texts[1000 + i] = _edited(rng, texts[i], int(rng.integers(2, 15)))
    base = _text(rng, 300)
    texts |= {5000 + i: _edited(rng, base, int(rng.integers(1, 9))) for i in range(120)}
    sets, ids = {k: _shingles(t) for k, t in texts.items()}, sorted(texts)
    want = {k: k for k in ids}
    near = [(a, b) for a in ids for b in ids if a < b and abs(a - b) in (1000, *range(1, 120)) and _similar(sets[a], sets[b]) >= 0.8]
    for _ in ids:
        before = dict(want)
        for a, b in near:
            want[a] = want[b] = min(want[a], want[b])
        if want == before:
            break
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert all(want[got[k]] == want[k] for k in ids)
    assert sum(0.6 <= _similar(sets[i], sets[1000 + i]) < 0.8 for i in range(80)) > 20 and 20 < sum(want[1000 + i] == i for i in range(80))
    assert sum(got[k] == want[k] for k in ids) >= 0.97 * len(ids)


def test_similar_groups_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "a b c"), (5, "A  b C"), (None, "a b c"), (None, "only here " * 9), (7, "x"), (7, "x"), (8, "long " * 30000)]
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], "doc_id long, text string, fp string, node int, component_id int")
    got = Counter(map(tuple, simhash.similar_groups(docs).collect()))
    assert got == Counter([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, 4), (None, None), (7, 7), (7, 7), (8, 8)])
    assert simhash.similar_groups(docs.filter("false")).count() == 0


def _odd_rows(spark):
    rng = np.random.default_rng(9)
    long = _text(rng, 6000)
    rows = [(1, None), (2, ""), (3, " ... 12"), (4, _text(rng, 80)), (5, long), (6, long + " "), (6, long), (7, _edited(rng, long, 5)), (None, _text(rng, 70)), (9, _text(rng, 90)), (10, "le la les des une est dans pour " * 9), (11, _text(rng, 60))]
    return spark.createDataFrame([(k, t, None if i % 4 == 0 else "fr" if k == 10 else "en", None if i % 5 == 0 else f"s{i % 2}", None) for i, (k, t) in enumerate(rows)], SCHEMA)


def test_stages_on_odd_rows(spark):
    docs = _odd_rows(spark)
    told = corpus_pipeline.identify(spark, docs, "")
    assert told.columns == docs.columns and Counter(told.select("doc_id").rdd.map(lambda r: r[0]).collect()) == Counter([4, 5, 6, 6, 7, None, 9, 10, 11])
    whole = corpus_pipeline.drop_copies(spark, told, "")
    assert whole.columns == docs.columns and sorted(str(r["doc_id"]) for r in whole.collect()) == sorted(map(str, [4, 5, 6, 7, None, 9, 10, 11]))
    near = corpus_pipeline.drop_near_copies(spark, whole, "")
    assert near.columns == docs.columns and sorted(str(r["doc_id"]) for r in near.collect()) == sorted(map(str, [4, 5, None, 9, 10, 11]))
    mixed = corpus_pipeline.mix_sources(spark, near, "")
    assert mixed.columns == docs.columns and mixed.count() > 0
    packed = corpus_pipeline.pack(spark, mixed, "")
    assert packed.agg(F.count_distinct("doc_id")).collect()[0][0] == mixed.agg(F.count_distinct("doc_id")).collect()[0][0]


def test_exact_stage_keeps_one_row_of_each_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    doubled = docs.union(docs)
    kept = corpus_pipeline.drop_copies(spark, doubled, "").collect()
    least = {}
    for r in docs.collect():
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "")
        least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values())


def test_mixing_stage_repeats_and_cuts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from sparkscope.llm.mixing import mix

    taken = {r["doc_id"]: r["taken"] for r in mix(docs).collect()}
    got = defaultdict(int)
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        got[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert dict(got) == {k: n for k, n in taken.items() if n}


def test_the_whole_pipeline(spark):
    packed = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = packed.collect()
    assert rows and {r["doc_id"] for r in rows} <= set(docs)
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 4096
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mix_sources", "pack"]


def test_found_by_similarity_on_the_given_documents(spark):
    """Every pair by brute force, in bands of similarity: all of 0.8 and more are in one group, and nothing else links."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets = {}
    for r in rows:
        sets.setdefault(frozenset(_shingles(r["text"] or "")), r["doc_id"])
    held, keys, holders = list(sets), list(sets.values()), defaultdict(list)
    for i, s in enumerate(held):
        for x in s:
            holders[x].append(i)
    common = Counter((i, j) for own in holders.values() for k, j in enumerate(own) for i in own[:k])
    near = {(i, j): n / (len(held[i]) + len(held[j]) - n) for (i, j), n in common.items()}
    near = {pair: share for pair, share in near.items() if share >= 0.45}
    docs = spark.createDataFrame([(keys[i], r) for i, r in enumerate({k: r["text"] or "" for k in keys for r in rows if r["doc_id"] == k}.values())], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_groups(docs).collect()}
    bands, top = defaultdict(Counter), {i: i for i in range(len(held))}
    for (i, j), share in sorted(near.items()):
        bands[min(int(share * 20) / 20, 0.95)][got[keys[i]] == got[keys[j]]] += 1
    for _ in held:
        before = dict(top)
        for (i, j), share in near.items():
            if share >= 0.8:
                top[i] = top[j] = min(top[i], top[j])
        if before == top:
            break
    for band, n in sorted(bands.items()):
        print(f"similarity {band:.2f} and up: {n[True]} of {sum(n.values())} pairs in one group")
    together = defaultdict(set)
    for i, root in top.items():
        together[root].add(keys[i])
    assert any(share >= 0.8 for share in near.values())
    assert all(len({got[k] for k in group}) == 1 for group in together.values())
    assert len(set(got.values())) == len(together)
