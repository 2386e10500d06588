"""Language identification by Bayesian evidence fusion.

A naive Bayes model over byte trigrams gives each text's likelihood per language. The corpus itself then tells how its
declared languages relate to its texts, and how its hosts and address suffixes lean: grouped sums of the texts' soft
assignments, a host's prior smoothed towards its suffix's and that towards the whole corpus's. The posterior multiplies them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, cut_lineage, text_bytes, text_slices

#: Labelled texts per language that the model is fitted on.
SAMPLE_PER_LANGUAGE = 400
SLOTS = 1 << 16
#: Bytes of text whose trigrams are looked up at once, so that what a step needs stays small beside the texts.
_PIECE = 1 << 18
#: A text counts as at most so many independent trigrams.
EFFECTIVE_TRIGRAMS = 60
#: Rows that the suffix's lean is worth within a host's, the corpus's within a suffix's, and evenness within a declaration.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 20.0, 5.0
#: Posterior below which a text's language counts as unknown.
LEAST_CONFIDENCE = 0.5

_ENTITY = re.compile(rb"&[#\w]+;")
_CODE = re.compile(rb"(?i)<(script|style)\b")
_CODE_END = {name: re.compile(rb"(?i)</" + name + rb"\s*>") for name in (b"script", b"style")}
_GAP = re.compile(rb" {2,}")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Model:
    """Log likelihoods ``table[slot, language]`` of hashed trigrams."""

    languages: list[str]
    table: np.ndarray = field(repr=False)


def visible_text(html: bytes) -> bytes:
    """A page without scripts, styles, comments, tags and entities, a space for each.

    What is never closed hides nothing but its own tag, and a ``<`` without any ``>`` behind it is text. Each kind of end is
    looked for once from where it may stand and never again where it was missed, so the time is linear in the page.
    """
    out, at, ended = [], 0, {b"script": True, b"style": True, b"-->": True}
    while (start := html.find(b"<", at)) >= 0:
        stop = -1
        if (code := _CODE.match(html, start)) and ended[name := code[1].lower()]:
            end = _CODE_END[name].search(html, code.end())
            ended[name], stop = end is not None, end.end() if end else -1
        elif ended[b"-->"] and html.startswith(b"<!--", start):
            end = html.find(b"-->", start + 4)
            ended[b"-->"], stop = end >= 0, end + 3 if end >= 0 else -1
        if stop < 0:
            stop = html.find(b">", start + 1) + 1
            if not stop:
                break
        out += (html[at:start], b" ")
        at = stop
    out.append(html[at:])
    return _ENTITY.sub(b" ", b"".join(out))


def _folded(text: bytes) -> bytes:
    """Letters in lower case; white space, digits and marks are one space, also before and after the text."""
    text = text.translate(_FOLD)
    # Words as objects would take many times a very long text.
    return b" " + (b" ".join(text.split()) if len(text) < CHUNK_BYTES else _GAP.sub(b" ", text).strip(b" ")) + b" "


def _trigrams(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed trigram slots of all texts and the texts they are of, piece by piece; white space alone holds no trigram."""
    folded = [_folded(t) for t in texts]
    buf, ends = np.frombuffer(b"".join(folded), np.uint8), np.cumsum([len(t) for t in folded])
    for i in range(0, len(buf) - 2, _PIECE):
        some = buf[i : i + _PIECE + 2].astype(np.uint32)
        code = some[:-2] << 16 | some[1:-1] << 8 | some[2:]
        own = np.searchsorted(ends, np.arange(i, i + len(code)), "right")
        inside = np.arange(i + 2, i + 2 + len(code)) < ends[own]
        yield ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)[inside], own[inside]


def fit(labelled: DataFrame, text_col: str = "text", language_col: str = "lang", key_col: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on at most ``per_language`` texts of each language, picked by a digest of their key; the bound is the parameter.

    Null languages are no labels; every other label is a language of the model. The driver gets the counts, at most 65,536
    for each of them. A first pass counts the labels, so that the second one's filter on the digest leaves about twice the
    sample before any text moves.
    """
    rows = labelled.select(F.col(language_col).alias("lang"), F.col(text_col).alias("text"), F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit(""))).alias("key")).filter("lang IS NOT NULL")
    common = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    languages = sorted(r["lang"] for r in common)
    if not languages:
        return Model([], np.zeros((SLOTS, 0), np.float32))
    # Of n digests that are as good as random, the share 2 p / n holds at least p but for one case in millions; then p is a bound.
    share = F.element_at(F.create_map(*[x for r in common for x in (F.lit(r["lang"]), F.lit(min(1.0, 2 * per_language / r["n"])))]), F.col("lang"))
    near = rows.filter(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") < share * F.lit(float(1 << 32)))
    sample = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key", "text"))).filter(F.col("n") <= per_language).drop("n", "key")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in text_slices(batches, "text"):
            names = np.array(batch.column("lang").to_pylist(), object)
            texts = text_bytes(batch, "text")
            for name in set(names):
                for slots, _ in _trigrams([t for t, own in zip(texts, names, strict=True) if own == name]):
                    sums[name] = sums.get(name, 0) + np.bincount(slots, minlength=SLOTS)
        for name, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "slot": pa.array(at.astype(np.int32)), "n": pa.array(n[at].astype(np.int64))})

    counts = sample.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = np.full((SLOTS, len(languages)), 0.1)
    place = {name: i for i, name in enumerate(languages)}
    for r in counts.toLocalIterator():
        table[r["slot"], place[r["lang"]]] += r["n"]
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def markup_language(html: Column) -> Column:
    """The language that a page's root element declares, wherever it stands; null where it declares none.

    First the root's tags, then their attributes: neither pattern looks twice at what it passed.
    """
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<html(?=[\s/>])[^>]*"), F.lit(0))
    told = F.transform(tags, lambda t: F.lower(F.regexp_extract(t, r"""(?i)\slang\s*=\s*["']?([A-Za-z]+)""", 1)))
    return F.get(F.filter(told, lambda x: x != ""), F.lit(0))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def text_evidence(rows: DataFrame, model: Model) -> DataFrame:
    """Replace ``text`` by ``n_trigrams`` and ``likely``, each language's share of the tempered likelihood; tags do not count
    where ``markup`` holds."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            texts = [visible_text(t) if m else t for t, m in zip(text_bytes(batch, "text"), batch.column("markup").to_pylist(), strict=True)]
            sums, counts = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
            for slots, own in _trigrams(texts):
                if len(own):
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    sums[own[first]] += np.add.reduceat(model.table[slots], first, axis=0, dtype=np.float64)
                    counts += np.bincount(own, minlength=len(texts))
            sums *= (np.minimum(counts, EFFECTIVE_TRIGRAMS) / np.maximum(counts, 1))[:, None]
            sums = np.exp(sums - sums.max(axis=1, keepdims=True, initial=-np.inf))
            share = sums / sums.sum(axis=1, keepdims=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(model.languages)), pa.array(share.ravel()))
            out = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "markup")}
            yield pa.RecordBatch.from_pydict(out | {"n_trigrams": pa.array(counts), "likely": lists})

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("text", "markup"))
    return rows.mapInArrow(score, f"{kept}, n_trigrams long, likely array<double>")


def _sums(n: int) -> list[Column]:
    return [F.sum(F.element_at("likely", i + 1)).alias(f"s{i}") for i in range(n)]


def _array(n: int, prefix: str = "s") -> Column:
    return F.array(*[F.col(f"{prefix}{i}") for i in range(n)])


def fuse(evidence: DataFrame, model: Model, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Add ``language, confidence, accepted`` to ``evidence`` (``declared, suffix, host, n_trigrams, likely``).

    A host's rows are summed before they move, and its prior joins them again over host and suffix, where Spark can split a
    hot host. Unknown declarations, suffixes and hosts (null or blank) fall back to evenness and the wider prior. Of
    languages with the same posterior the first by code point is named.
    """
    n = len(model.languages)
    if not n:
        return evidence.select("*", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = cut_lineage(evidence.withColumns({c: blank(c) for c in ("declared", "suffix", "host")}))
    told = rows.filter("n_trigrams > 0")
    hosts = cut_lineage(told.groupBy("suffix", "host").agg(*_sums(n)))
    sums = lambda df, *by: df.groupBy(*by).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
    whole = sums(hosts).first()
    total = [(whole[f"s{i}"] or 0.0) + 1.0 for i in range(n)]
    corpus = F.array(*[F.lit(x / sum(total)) for x in total])
    smoothed = lambda own, wider, weight: F.transform(F.zip_with(own, wider, lambda a, b: a + weight * b), lambda x: x / (F.aggregate(own, F.lit(0.0), lambda a, b: a + b) + weight))
    suffixes = sums(hosts.filter("suffix != ''"), "suffix").select("suffix", smoothed(_array(n), corpus, SUFFIX_WEIGHT).alias("by_suffix"))
    priors = hosts.filter("host != ''").join(suffixes, "suffix", "left").select("suffix", "host", smoothed(_array(n), F.coalesce("by_suffix", corpus), HOST_WEIGHT).alias("by_host"))
    # How often a text of each language declares this: the declaration's share of the language's texts, smoothed.
    even = F.array(*[F.lit(DECLARED_WEIGHT / n)] * n)
    says = told.filter("declared != ''").groupBy("declared").agg(*_sums(n)).select("declared", F.zip_with(F.zip_with(_array(n), even, lambda a, b: a + b), F.array(*[F.lit(x + DECLARED_WEIGHT) for x in total]), lambda a, b: a / b).alias("by_declared"))
    joined = rows.join(priors, ["suffix", "host"], "left").join(suffixes, "suffix", "left").join(says, "declared", "left")
    times = lambda a, b: F.zip_with(a, b, lambda x, y: x * y)
    ones = F.array(*[F.lit(1.0)] * n)
    raw = times(times(F.col("likely"), F.coalesce("by_host", "by_suffix", corpus)), F.coalesce("by_declared", ones))
    fused = joined.withColumn("raw", raw).withColumn("all", F.aggregate("raw", F.lit(0.0), lambda a, b: a + b)).withColumn("best", F.array_max("raw"))
    named = F.element_at(F.array(*[F.lit(x) for x in model.languages]), F.array_position("raw", F.col("best")).cast("int"))
    confidence = F.when(F.col("all") > 0, F.col("best") / F.col("all")).otherwise(F.lit(0.0))
    return fused.select(*evidence.columns, F.when(F.col("all") > 0, named).alias("language"), confidence.alias("confidence")).withColumn("accepted", (F.col("n_trigrams") > 0) & (F.col("confidence") >= least_confidence))


def identify_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", declared: Column | None = None) -> DataFrame:
    """``id_col, declared, host, suffix, n_trigrams, language, confidence, accepted`` for texts; the source acts as host.

    Nothing counts as declared unless a column says it: a label that the model learns from is no evidence for its own text.
    Null and empty texts hold no trigram and are not accepted. Very long texts are read whole, piece by piece. A null id,
    source or declaration is allowed. Repeated rows and rows with one id are judged each for itself; of tied languages the
    first by code point is named. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    told = F.lit("") if declared is None else F.lower(declared)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text"), F.lit(False).alias("markup"), told.alias("declared"), F.lit("").alias("suffix"), F.col("source").alias("host"))
    return fuse(text_evidence(rows, model), model).drop("likely").withColumnRenamed("id", id_col)


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id") -> DataFrame:
    """The same for web pages: declared by the markup, host and address suffix from the url, null where there is no url.

    Whole pages are read, in time linear in their length whatever is left open in them. Nulls, empty and very long pages, ties,
    repeated rows, empty tables and other columns are as in ``identify_documents``.
    """
    name = host(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col("html").alias("text"), F.lit(True).alias("markup"), markup_language(F.col("html")).alias("declared"), F.regexp_extract(name, r"\.([a-z]+)$", 1).alias("suffix"), name.alias("host"))
    return fuse(text_evidence(rows, model), model).drop("likely").withColumnRenamed("id", id_col)
