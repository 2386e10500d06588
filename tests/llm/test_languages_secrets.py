"""Language ID against a plain computation, and both scans on texts made to be slow."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkscope.llm import languages, secrets

HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&[#\w]+;")


def test_visible_text_is_what_one_pattern_leaves():
    rng = random.Random(7)
    parts = [b"<", b">", b"<script", b"</script>", b"</SCRIPT >", b"<style a>", b"</style", b"<!--", b"-->", b"&amp;", b"&", b";", b" ", b"ab", b"<p>", b"<scripted>", b"\n", b"-"]
    for _ in range(20000):
        page = b"".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert languages.visible_text(page) == HIDDEN.sub(b" ", page), page


@pytest.mark.parametrize("unit", [b"<script ", b"<!-- ", b"<", b"&a", b"<style></scrip ", b"<html <html ", b"</script   ", b"<script></script <!--"])
def test_broken_pages_take_linear_time(unit):
    page = unit * (5_000_000 // len(unit))
    began = time.perf_counter()
    languages.visible_text(page)
    assert time.perf_counter() - began < 20


def test_the_declared_language_of_broken_pages(spark):
    pages = [(0, "<html " * 800_000, None), (1, "<html x " * 500_000 + " lang=fr", "fr"), (2, "<html>" * 500_000 + "<html lang='de'>", "de"), (3, "<html\tLANG = 'Es'" + " lang" * 700_000, "es"), (4, "<htmlx lang=fr>", None), (5, None, None), (6, "", None)]
    began = time.perf_counter()
    got = dict(spark.createDataFrame(pages, "n int, html string, l string").select("n", languages.markup_language(F.col("html"))).collect())
    assert got == {n: lang for n, _, lang in pages}
    assert time.perf_counter() - began < 60


def _grams(text):
    folded = "".join(chr(b + 32) if 65 <= b <= 90 else chr(b) if 97 <= b <= 122 or b >= 128 else " " for b in text.encode())
    folded = " " + " ".join(folded.split(" ")).strip() + " " if folded.split() else "  "
    folded = re.sub(" +", " ", folded) if folded.strip() else "  "
    return [folded[i : i + 3] for i in range(len(folded) - 2)]


def _slot(gram):
    a, b, c = map(ord, gram)
    return ((a << 16 | b << 8 | c) * 0x9E3779B1 & 0xFFFFFFFF) >> 16


def _posteriors(train, rows):
    """Bayes by hand: ``train`` is (text, language), ``rows`` are (text, declared, suffix, host)."""
    names = sorted({lang for _, lang in train if lang is not None})
    counts = {n: Counter(_slot(g) for text, lang in train if lang == n for g in _grams(text or "")) for n in names}
    total = {n: sum(counts[n].values()) + 0.1 * 65536 for n in names}
    likely = []
    for text, *_ in rows:
        grams = _grams(text or "")
        logs = [sum(math.log((counts[n][_slot(g)] + 0.1) / total[n]) for g in grams) * (min(len(grams), 60) / max(len(grams), 1)) for n in names]
        top = max(logs)
        shares = [math.exp(x - top) for x in logs]
        likely.append(([s / sum(shares) for s in shares], len(grams)))
    add = lambda vectors: [sum(x) for x in zip(*vectors)] or [0.0] * len(names)  # noqa: B905, E731
    told = [(v, *r[1:]) for (v, n), r in zip(likely, rows, strict=True) if n]
    whole = [x + 1 for x in add([t[0] for t in told])]
    corpus = [x / sum(whole) for x in whole]
    smooth = lambda own, wider, k: [(a + k * b) / (sum(own) + k) for a, b in zip(own, wider, strict=True)]
    suffixes, hosts, says = {}, {}, {}
    for s in {t[2] for t in told if t[2]}:
        suffixes[s] = smooth(add([t[0] for t in told if t[2] == s]), corpus, 20)
    for s, h in {(t[2], t[3]) for t in told if t[3]}:
        hosts[s, h] = smooth(add([t[0] for t in told if (t[2], t[3]) == (s, h)]), suffixes.get(s, corpus), 20)
    for d in {t[1] for t in told if t[1]}:
        says[d] = [(a + 5 / len(names)) / (b + 5) for a, b in zip(add([t[0] for t in told if t[1] == d]), whole, strict=True)]
    out = []
    for (v, n), (_, declared, suffix, host) in zip(likely, rows, strict=True):
        prior = hosts.get((suffix, host)) or suffixes.get(suffix) or corpus
        raw = [a * b * c for a, b, c in zip(v, prior, says.get(declared, [1.0] * len(names)), strict=True)]
        best = max(raw)
        out.append((names[raw.index(best)], best / sum(raw), n))
    return out


def test_evidence_against_a_plain_computation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    odd = [(9001, None, "en", "s"), (9002, "", None, None), (9003, " 12 %", None, ""), (9004, "zz", "fr", "new host"), (9001, None, "en", "s"), (None, "und der", "de", None)]
    docs = docs.select("doc_id", "text", "lang", "source").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    rows = docs.collect()
    model = languages.fit(docs, per_language=10**6)
    want = _posteriors([(r["text"], r["lang"]) for r in rows], [(r["text"], None, "", r["source"] or "") for r in rows])
    got = Counter((r["doc_id"], r["language"], round(r["confidence"], 3), r["n_trigrams"], r["accepted"]) for r in languages.identify_documents(docs, model).collect())
    assert got == Counter((r["doc_id"], lang, round(p, 3), n, n > 0 and p >= 0.5) for r, (lang, p, n) in zip(rows, want, strict=True))


def test_pages_against_a_plain_computation(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(80).select("page_id", "url", "html")
    odd = [(9001, None, None), (9002, "", ""), (9003, "https://a.de/x", "<html lang=de><p>zz"), (9003, "https://a.de/x", "<html lang=de><p>zz"), (None, "ftp://u@B.FR:8/", "le la")]
    pages = pages.union(spark.createDataFrame(odd, "page_id long, url string, html string"))
    train = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, labelled = pages.collect(), train.collect()

    def parts(url):
        found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
        host = found[1].lower() if found else ""
        return (m[1] if (m := re.search(r"\.([a-z]+)$", host)) else ""), host

    def declared(html):
        found = re.search(r"""(?i)<html[^>]*?\slang\s*=\s*["']?([A-Za-z]+)""", html or "")
        return found[1].lower() if found else None

    want = _posteriors([(r["text"], r["lang"]) for r in labelled], [(HIDDEN.sub(b" ", (r["html"] or "").encode()).decode("utf-8"), declared(r["html"]), *parts(r["url"])) for r in rows])
    got = Counter((r["page_id"], r["language"], round(r["confidence"], 3), r["n_trigrams"]) for r in languages.identify_pages(pages, languages.fit(train, per_language=10**6)).collect())
    assert got == Counter((r["page_id"], lang, round(p, 3), n) for r, (lang, p, n) in zip(rows, want, strict=True))


def test_every_label_is_a_language(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} " * 5, f"l{i:03d}") for i in range(90)], "doc_id long, text string, lang string")
    assert len(languages.fit(docs).languages) == 90


def test_a_very_long_text_is_judged_whole(spark):
    docs = spark.createDataFrame([(1, "the and that", "en"), (2, "der die und das", "de"), (3, "12 " * 1_500_000 + "der die und das " * 200_000, None)], "doc_id long, text string, lang string").withColumn("source", F.lit("s"))
    got = {r["doc_id"]: r for r in languages.identify_documents(docs, languages.fit(docs)).collect()}
    assert (got[3]["language"], got[3]["accepted"]) == ("de", True) and got[3]["n_trigrams"] == 200_000 * 16 - 1


def test_many_secrets_in_one_text_take_linear_time(spark):
    """A hex and an opaque token by turns, opaque ones inside of assignments, and words that open an assignment and nothing else."""
    hexes, tokens = "0123456789abcdef" * 2, "Ab1" * 10
    text = f"{hexes} {tokens} " * 75_000 + "token = " * 50_000 + f"token={tokens} " * 1000
    docs = spark.createDataFrame([(1, text, "s", "en"), (2, "é" + hexes, "s", "en"), (3, None, None, None)], "doc_id long, text string, source string, lang string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    assert time.perf_counter() - began < 60
    assert (got[1]["n_hex"], got[1]["n_assign"], got[1]["n_access"]) == (75_000, 1000, 0)
    assert got[1]["spans"].count("opaque:") == 75_000 and got[1]["base"].startswith("hex:0:32,hex:64:96")
    assert got[2]["spans"] == "hex:1:33" and got[3]["spans"] == ""


def test_repositories_tell_examples_too(spark):
    token, own = "Qx7" * 9, "Zk3" * 9
    rows = [(i, f"see {token}", "one owner", f"l{i}") for i in range(4)] + [(10 + i, f"see {own}", "one owner", f"l{i % 3}") for i in range(6)]
    got = defaultdict(set)
    for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect():
        got[r["doc_id"] < 10].add((r["spans"], r["n_live"], r["most_owners"], r["most_repositories"]))
    assert got == {True: {("", 0, 0, 0)}, False: {("opaque:4:31", 1, 1, 3)}}
