"""Collocations against a plain count of all word sequences, the automaton by itself, and edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkscope.llm import phrases
from sparkscope.llm.phrases import Automaton, collocations, segments, words

SCHEMA = "doc_id long, text string, lang string"


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, most=5, top=2000):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            totals[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            for k in range(1, most + 1):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in counts.items():
        n, found = totals[lang], []
        frequent = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        for p, a in frequent.items():
            if any(len(q) > len(p) and f >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, f in frequent.items()):
                continue
            score, k = min((1000 * a * n // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def results(found):
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14), st.integers(1, 3)), max_size=6))
def test_automaton_counts_every_sequence(sequences):
    automaton, wanted = Automaton(), Counter()
    for s, weight in sequences:
        automaton.add(tuple(s), weight)
        for k in range(1, 6):
            for i in range(len(s) - k + 1):
                wanted[tuple(s[i : i + k])] += weight
    found = {p: (n, left, right) for p, n, left, right in automaton.phrases()}
    assert {p: n for p, (n, *_) in found.items()} == {p: n for p, n in wanted.items() if len(p) > 1}
    for p, (n, left, right) in found.items():
        if len(p) < 5:
            assert left == (not any(q[1:] == p and f == n for q, f in wanted.items()))
            assert right == (not any(q[:-1] == p and f == n for q, f in wanted.items()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc,"), min_size=1, max_size=60), st.integers(1, 9))
def test_cut_segments_count_each_sequence_once(letters, block):
    import numpy as np

    found = words(" ".join(letters).encode())
    ids = np.array([0 if w == b"\xff" else w[0] for w in found], np.uint64)
    whole, cut, counts = Automaton(), Automaton(), Counter()
    for sequence, context, more, _ in segments(found, ids, 5, {}):
        whole.add(sequence, 1, context, more)
    apart: dict[tuple, list] = {}
    for sequence, context, more, at in segments(found, ids, 5, {}, block):
        assert tuple(found[at : at + len(sequence)]) == sequence
        cut.add(sequence, 1, context, more)
        alone = Automaton()
        alone.add(sequence, 1, context, more)
        for p, n, left, right in alone.phrases():
            counts[p] += n
            apart.setdefault(p, []).append((left, right))
    wanted = {p: (n, *o) for p, n, *o in whole.phrases()}
    assert {p: n for p, n, *_ in cut.phrases()} == dict(counts) == {p: n for p, (n, *_) in wanted.items()}
    # Whatever falls to which shard, what is part of a longer sequence as often is never called open.
    for p, (_, left, right) in wanted.items():
        if len(p) < 5:
            assert left or not any(x for x, _ in apart[p])
            assert right or not any(x for _, x in apart[p])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd,"), min_size=1, max_size=60), st.integers(1, 4), st.integers(1, 20))
def test_segments_hold_each_frequent_sequence_once(letters, least, block):
    """With a bitmap for each size that holds just the frequent ones, counts of these are those of all places."""
    import numpy as np

    from sparkscope.llm import phrases

    found = words(" ".join(letters).encode())
    ids = np.array([0 if w == b"\xff" else w[0] for w in found], np.uint64)
    places = {k: [tuple(found[i : i + k]) if b"\xff" not in found[i : i + k] else None for i in range(len(found) - k + 1)] for k in range(2, 6)}
    frequent = {k: {p for p, n in Counter(places[k]).items() if p and n >= least} for k in places}
    bits = {}
    for k in places:
        mixed, known, _ = phrases._linked(ids, k, dict(bits))
        flags = np.zeros(1 << 12, np.uint8)
        flags[[int(phrases._bucket(mixed[i : i + 1], 1 << 12)[0]) for i in range(len(mixed)) if places[k][i] in frequent[k]]] = 1
        bits[k] = np.packbits(flags, bitorder="little")
    automaton, apart = Automaton(), {}
    for sequence, context, more, _ in segments(found, ids, 5, bits, block):
        automaton.add(sequence, 1, context, more)
        alone = Automaton()
        alone.add(sequence, 1, context, more)
        for p, _, left, right in alone.phrases():
            apart.setdefault(p, []).append((left, right))
    for p in [p for k in range(2, 5) for p in frequent[k]]:
        n = Counter(places[len(p)])[p]
        assert not any(left for left, _ in apart[p]) or not any(q[1:] == p and Counter(places[len(q)])[q] == n for q in frequent[len(p) + 1])
        assert not any(right for _, right in apart[p]) or not any(q[:-1] == p and Counter(places[len(q)])[q] == n for q in frequent[len(p) + 1])
    counts = {p: n for p, n, *_ in automaton.phrases()}
    assert {p: counts.get(p) for k in frequent for p in frequent[k]} == {p: n for k in places for p, n in Counter(places[k]).items() if p in frequent[k]}


@pytest.mark.parametrize(("least", "shard", "block"), [(3, 1 << 17, 1 << 12), (2, 40, 7), (5, 200, 3)])
def test_as_by_plain_counts(spark, least, shard, block):
    rng = random.Random(least)
    vocabulary = ["The", "of", "in", "new", "york", "city", "hall", "É", "ß", "x1", "%", "of"]
    rows = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", ", ", ". ", "\n", "  ", ": "]) for _ in range(rng.randrange(40))), rng.choice(["en", "en", "de", None, "und"])) for i in range(120)]
    assert results(collocations(spark.createDataFrame(rows, SCHEMA), least=least, shard_words=shard, block=block)) == brute(rows, least)


def test_only_the_best_of_each_language_stay(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(50)), "en" if i % 2 else "fr") for i in range(60)]
    assert results(collocations(spark.createDataFrame(rows, SCHEMA), least=4, top=7)) == brute(rows, 4, top=7)


def test_nulls_empty_long_and_repeated_texts(spark):
    rows = [
        (1, None, "en"), (2, "", "en"), (None, "in the end in the end", None), (3, "in the end", "und"), (3, "in the end", "und"), (4, " \t.;", "de"), (5, "alone", ""),
        (6, "a b " * 50_000, "fr"), (7, "x" * 300_000 + " y", "fr"), (8, " zw ei drei " * 9, "de"), (9, "A-b A-b A-b", ""),
    ]
    assert results(collocations(spark.createDataFrame(rows, SCHEMA), least=2)) == brute(rows, 2)


def test_other_columns_are_ignored_and_an_empty_table_is_empty(spark):
    rows = [(i, "one two three", "en") for i in range(5)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("word", "n", "phrase", "a", "l", "r", "score", "rank", "size", "w", "cut", "part", "salt"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert results(collocations(docs, least=3)) == brute(rows, 3) == [("en", 1, "one two three", 5, 5, 5, 15, 3000)]
    assert results(collocations(spark.createDataFrame([], SCHEMA))) == []


def test_a_sequence_is_given_out_once_however_many_tasks_meet_it(spark):
    """The rows of the automata grow with the different sequences, not with these times the tasks."""
    from sparkscope.llm import phrases

    rng = random.Random(3)
    rows = [("en", " ".join(rng.choice("abcdef") for _ in range(8)), 8, 1) for _ in range(400)]
    runs = spark.createDataFrame(rows, "lang string, text string, words int, n long").repartition(16)
    found = phrases._shard_counts(spark, runs, 5, {}, 1 << 17, 1 << 12).collect()
    counts = Counter(tuple(t.split()[i : i + k]) for _, t, *_ in rows for k in range(2, 6) for i in range(9 - k))
    assert len(found) == len(counts) and {tuple(r["phrase"].split()): r["n"] for r in found} == counts


def test_counts_of_buckets_move_in_blocks_and_are_those_of_all_tasks(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.2, 40) % 3000) for _ in range(600)]
    rows = spark.createDataFrame([("en" if i % 3 else "de", t) for i, t in enumerate(texts)], "lang string, text string").repartition(6)
    buckets, least = 1 << phrases.LEAST_BITS, 7
    every = {1: np.full(buckets // 8, 255, np.uint8)}
    met = {}
    for i, text in enumerate(texts):
        ids = phrases._Ids("en" if i % 3 else "de", None).of(phrases.words(text.encode()))
        for b in phrases._bucket(phrases._mixed(ids[:-1], ids[1:]), buckets).tolist():
            met[b] = met.get(b, 0) + 1
    bits = phrases._link_bits(spark, rows, least, buckets, 2, every)
    assert np.flatnonzero(np.unpackbits(bits, bitorder="little")).tolist() == sorted(b for b, n in met.items() if n >= least)
    # With numbers: each text stands for several.
    weighted = phrases._link_bits(spark, rows.withColumn("n", F.lit(300).cast("long")), 300, buckets, 2, every)
    assert np.flatnonzero(np.unpackbits(weighted, bitorder="little")).tolist() == sorted(met)
    blocks = phrases._block_counts(spark, rows, least, buckets, 2, every)
    assert blocks.count() <= rows.rdd.getNumPartitions() * (buckets >> phrases._BLOCK_BITS) < len(met)


def test_what_is_left_of_a_text_is_one_row_no_longer_than_the_text(spark):
    """Rows grow with the texts, however many different runs of words these hold."""
    rng = random.Random(11)
    texts = ["".join(f"W{rng.randrange(60)}" + rng.choice([" ", " ", " ", "\t", ", ", ".\n"]) for _ in range(rng.randrange(300))) for _ in range(80)]
    texts += ["", " .,", "w1", None, "w1 " * 5000, texts[0], texts[0]]
    langs = ["en" if i % 3 else "de" for i in range(len(texts))]
    rows = phrases._rows(spark.createDataFrame([*zip(langs, texts, strict=True)], "lang string, text string").repartition(5), "text", "lang")
    bits = {1: np.full(1 << 15, 255, np.uint8), 2: np.random.default_rng(2).integers(0, 256, 1 << 15).astype(np.uint8)}
    wanted, runs = [], set()
    for lang, text in zip(langs, texts, strict=True):
        found = words((text or "").encode())
        own = [b" ".join(p).decode() for p, *_ in segments(found, phrases._Ids(lang, bits[1]).of(found), 2, {2: bits[2]}, len(found))]
        assert len("\n".join(own)) <= len(text or "")
        wanted += [(lang, "\n".join(own), sum(len(x.split()) for x in own))] if own else []
        runs.update((lang, x) for x in own)
    found = phrases._runs(spark, rows, bits).select("lang", "text", "words").collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert len(found) <= len(texts) < len(runs)
