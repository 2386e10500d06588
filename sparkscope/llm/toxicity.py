"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A bounded sample of labelled rows tells which words and word beginnings stand out in toxic texts; this lexicon, what it is near
to, and how a text is written become some fifteen numbers for each text. Each training row is seen through the lexicon of the
other folds, and the probabilities that calibration starts from are those of trees grown on the other folds. Whole texts are
read, once.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, text_bytes, text_slices

#: Labelled rows of each label that the model is fitted on, and entries of the lexicon.
FIT_ROWS, LEXICON = 2000, 4000
SPLIT, HELD_OUT, FOLDS, LEAST_SCORE = 3, 1, 4, 0.7
#: Trees, their depth and rate, cuts of a feature, rows of a leaf, and what is added to a leaf's curvature.
ROUNDS, DEPTH, RATE, BINS, LEAST_ROWS, SMOOTH = 60, 3, 0.1, 32, 5, 1.0
#: Characters of a word's beginning that count as a stem.
STEMS = range(4, 8)
#: An entry's least deviation, its least ratio of frequencies (natural logarithm), and the texts that must hold it.
LEAST_Z, LEAST_RATIO, LEAST_TEXTS = 3.0, 1.5, 3
#: The share of the trees' own probability in a score, which orders what calibration holds equal.
TIE = 0.01
_CAP, _PRIOR, _NEAR, _SPAN = 3, 0.5, 5, 60
#: Second-person words of English, German, French, Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch tu te toi ton ta tes vous votre vos usted tú ti tus vosotros".split())
#: Signs that stand for letters, then signs put between them.
_LOOKALIKE = str.maketrans("013457@$!|", "oieastasii")
_BETWEEN = str.maketrans("", "", ".-_*'~+/")
_SIGNS = "@$|"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_STRETCHED = re.compile(r"(.)\1{2,}")
FEATURES = (
    "words", "weight", "hits", "kinds", "densest", "heaviest", "near_you", "you", "capitals", "shouted", "exclaimed", "marks", "digits", "hidden", "mixed", "stretched",
)


@dataclass
class Trees:
    """Complete binary trees: a row goes right where its feature exceeds the cut; ``base`` and the leaves add up to the log odds."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        odds, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            odds += leaf[at - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-odds))


@dataclass
class Model:
    """``steps`` are the calibration's probabilities (first row) and what they stand for (second row)."""

    lexicon: dict[str, float]
    trees: Trees | None
    steps: np.ndarray | None
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.prior)
        p = self.trees.probability(x)
        return np.clip((1 - TIE) * np.interp(p, *self.steps) + TIE * p, 0.0, 1.0)


def grow(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Trees:
    """Boost trees on the logistic loss: cuts at quantiles, those of the largest gain, leaves by one Newton step each."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    bins = [np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)]
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    inner, odds = 2**DEPTH - 1, np.full(len(y), base)
    trees = Trees(base, np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1)))
    for k in range(rounds):
        p = 1 / (1 + np.exp(-odds))
        slope, bend, at = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-9)
            for f, (own, c) in enumerate(zip(bins, cuts, strict=True)):
                sums = lambda v: np.cumsum(np.bincount((at - first) * (len(c) + 1) + own, v, nodes * (len(c) + 1)).reshape(nodes, -1), axis=1)  # noqa: B023, E731
                g, h, n = sums(slope), sums(bend), sums(None)
                gain = lambda g, h: g * g / (h + SMOOTH)
                won = gain(g[:, :-1], h[:, :-1]) + gain(g[:, -1:] - g[:, :-1], h[:, -1:] - h[:, :-1]) - gain(g[:, -1:], h[:, -1:])
                won[(n[:, :-1] < LEAST_ROWS) | (n[:, -1:] - n[:, :-1] < LEAST_ROWS)] = 0
                for node in np.flatnonzero(won.max(axis=1, initial=0) > best):
                    best[node] = won[node].max()
                    trees.feature[k, first + node], trees.cut[k, first + node] = f, c[won[node].argmax()]
            at = 2 * at + 1 + (x[np.arange(len(x)), trees.feature[k][at]] > trees.cut[k][at])
        leaves = at - inner
        trees.leaf[k] = rate * np.bincount(leaves, slope, inner + 1) / (np.bincount(leaves, bend, inner + 1) + SMOOTH)
        odds += trees.leaf[k][leaves]
    return trees


def isotonic(p: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing steps of least squares: neighbours that fall are pooled. Probabilities above, values below."""
    blocks: list[list[float]] = []
    values, place = np.unique(p, return_inverse=True)
    for v, total, n in zip(values.tolist(), np.bincount(place, y * weight).tolist(), np.bincount(place, weight).tolist(), strict=True):
        blocks.append([v, v, total, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, total, n = blocks.pop()
            blocks[-1][1:] = [high, blocks[-1][2] + total, blocks[-1][3] + n]
    ends = [(x, t / n) for low, high, t, n in blocks for x in ([low, high] if high > low else [low])]
    return np.array(ends).T


def entries(word: str) -> list[str]:
    """A word as itself, and its beginnings, each followed by a dash."""
    return [word, *[word[:n] + "-" for n in STEMS if len(word) > n]]


def readings(token: str) -> list[tuple[str, bool]]:
    """The words that a token may stand for, and whether it hides them: look-alikes, signs between letters, stretched letters."""
    core = token.strip(string.punctuation).lower()
    if core.isalpha():
        found = [(core, False)]
        if _STRETCHED.search(core):
            found.append((_STRETCHED.sub(r"\1", core), True))
        if len(core) + 1 >= len(token):
            # A sign at one end may stand for a letter; most words merely end in a mark.
            return found if token[0] not in _SIGNS and token[-1] not in _SIGNS else found + _shown(token.lower(), core)
    else:
        core, found = _EDGES.sub("", token).lower(), []
        if core.isalpha():
            found.append((core, False))
    return found + _shown(token.lower(), core) + (_shown(core, core) if core else [])


def _shown(text: str, core: str) -> list[tuple[str, bool]]:
    other = _EDGES.sub("", text.translate(_LOOKALIKE).translate(_BETWEEN))
    return [(other, True)] if other != core and other.isalpha() else []


def _tokens(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").split()


class Reader(dict):
    """Features of texts by a lexicon; tokens are looked into once and remembered, plain ones as 0."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon, self.told = lexicon, [(0.0, False, False, False, False, False, False)]
        # Most words begin like no entry: a single look tells.
        self.heads = {e.rstrip("-")[: STEMS[0]] for e in lexicon}

    def _weight(self, word: str) -> float:
        return max(self.lexicon.get(e, 0.0) for e in entries(word)) if word[: STEMS[0]] in self.heads else 0.0

    def __missing__(self, token: str) -> int:
        inner = token.strip(string.punctuation)
        low = inner.lower()
        if len(inner) > 1 and inner.isalpha() and low[: STEMS[0]] not in self.heads and not inner.isupper() and token[0] not in _SIGNS and token[-1] not in _SIGNS and low not in SECOND_PERSON and not _STRETCHED.search(token):
            self[token] = 0
            return 0
        best, hidden, you, single = 0.0, False, False, False
        for word, hides in readings(token):
            weight = self._weight(word)
            if weight > best:
                best, hidden = weight, hides
            you, single = you or word in SECOND_PERSON, single or len(word) == 1
        mixed = not inner.isalpha() and any(c.isalpha() for c in inner) and not inner.replace("'", "").replace("-", "").isalpha()
        self[token] = len(self.told)
        self.told.append((best, hidden, you, len(inner) > 2 and inner.isupper(), mixed, single, _STRETCHED.search(token) is not None))
        return len(self.told) - 1

    def _spelled(self, tokens: list[str], single: np.ndarray) -> float:
        """The weight of words spelled as single letters with blanks between them."""
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single.astype(np.int8), [0]])))
        found = 0.0
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if 4 <= end - start <= 40:
                word = "".join(_EDGES.sub("", t) for t in tokens[start:end]).lower()
                found += self._weight(word)
        return found

    def features(self, text: bytes) -> list[float]:
        if len(self) > 300_000:
            self.clear()
            self.told = self.told[:1]
        tokens, n_bytes = _tokens(text), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        n = len(tokens)
        if not n:
            return [0.0] * len(FEATURES)
        codes = np.fromiter(map(self.__getitem__, tokens), np.int64, n)
        used, place = np.unique(codes, return_inverse=True)
        table = np.array([self.told[c] for c in used.tolist()], np.float64)
        weight, hidden, you, shouted, mixed, single, stretched = table[place].T
        spelled = self._spelled(tokens, single > 0) if single.sum() >= 4 else 0.0
        hit = weight > 0
        sums = lambda x, span: (lambda c: c[np.minimum(np.arange(n) + span, n)] - c[:n])(np.concatenate([[0.0], np.cumsum(x)]))
        at, yous = np.flatnonzero(hit), np.concatenate([[0.0], np.cumsum(you)])
        near = (yous[np.minimum(at + _NEAR + 1, n)] - yous[np.maximum(at - _NEAR, 0)]) > 0
        upper, lower = n_bytes[65:91].sum(), n_bytes[97:123].sum()
        marks = n_bytes[33:48].sum() + n_bytes[58:65].sum() + n_bytes[91:97].sum() + n_bytes[123:127].sum()
        return [
            float(np.log1p(n)), (weight.sum() + spelled) / n, hit.sum() / n, float(np.log1p(len({t for t in used.tolist() if self.told[t][0] > 0}))), float(sums(hit.astype(float), _SPAN).max()), float(weight.max()),
            near.sum() / n, you.sum() / n, upper / max(upper + lower, 1), shouted.sum() / n, n_bytes[33] / n, marks / n, n_bytes[48:58].sum() / len(text), (hidden * hit).sum() / n + spelled / n, mixed.sum() / n, stretched.sum() / n]


def _read(rows: DataFrame, lexicons: dict[int, dict[str, float]]) -> DataFrame:
    """Replace ``text`` by ``features``, by the lexicon that ``fold`` names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = {k: Reader(v) for k, v in lexicons.items()}
        for batch in text_slices(batches, "text"):
            found = [readers[k].features(t) for k, t in zip(batch.column("fold").to_pylist(), text_bytes(batch, "text"), strict=True)]
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in batch.schema.names if c != "text"} | {"features": pa.array(found, pa.list_(pa.float64()))})

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(read, f"{kept}, features array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % SPLIT == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """At most ``rows`` texts of each label that are not held out, picked by a digest of their id: ``text, y, fold, weight``.

    ``weight`` is how many labelled rows one stands for. Rows are picked among the labels, so texts of no other row move.
    """
    told = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL").filter(~held_out(F.col("id")))
    once = told.groupBy("id").agg((F.max("y") > 0).cast("int").alias("y")).withColumn("key", F.xxhash64("id"))
    counts = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    # Twice the share that is wanted stays, so that the ranks that make the bound exact are over few rows.
    share = {y: min(1.0, 2 * rows / n) for y, n in counts.items()}
    near = F.lit(False)
    for y, part in share.items():
        near = near | ((F.col("y") == y) & (F.pmod(F.col("key"), F.lit(1 << 20)) < int(part * (1 << 20)) + 1))
    ranked = once.filter(near).withColumn("rank", F.row_number().over(Window.partitionBy("y").orderBy("key", "id"))).filter(F.col("rank") <= rows)
    weight = F.lit(1.0)
    for y, n in counts.items():
        weight = F.when(F.col("y") == y, F.lit(max(1.0, n / rows))).otherwise(weight)
    picked = ranked.select("id", "y", F.pmod(F.shiftright("key", 20), F.lit(FOLDS)).cast("int").alias("fold"), weight.alias("weight"))
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return cut_lineage(texts.join(F.broadcast(picked), "id").drop("id"))


def lexicons(sample: DataFrame, size: int = LEXICON) -> dict[int, dict[str, float]]:
    """For each fold the entries that stand out in the toxic texts of the others, with their weight; at -1 those of all folds.

    Of a text at most three places count for an entry, so that one that repeats itself tells no more than others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], list[int]] = {}

        def told() -> pa.RecordBatch:
            keys, n = list(held), np.array(list(held.values()), np.int64).reshape(len(held), 4)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), *[pa.array(c) for c in n.T]], names=["fold", "entry", "x0", "x1", "d0", "d1"])

        for batch in text_slices(batches, "text"):
            for fold, y, text in zip(batch.column("fold").to_pylist(), batch.column("y").to_pylist(), text_bytes(batch, "text"), strict=True):
                own: Counter = Counter()
                words = 0
                for token, n in Counter(_tokens(text)).items():
                    words += n
                    for word in {w for w, _ in readings(token)}:
                        for entry in entries(word):
                            own[entry] += n
                for entry, n in [*own.items(), ("", words)]:
                    at = held.setdefault((fold, entry), [0, 0, 0, 0])
                    at[y] += min(n, _CAP) if entry else n
                    at[2 + y] += 1
            if len(held) > 300_000:
                yield told()
                held.clear()
        yield told()

    counts = sample.select("fold", "y", "text").mapInArrow(count, "fold int, entry string, x0 long, x1 long, d0 long, d1 long").groupBy("entry", "fold").agg(*[F.sum(c).alias(c) for c in ("x0", "x1", "d0", "d1")])
    wide = cut_lineage(counts.groupBy("entry").pivot("fold", list(range(FOLDS))).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("x0", "x1", "d1")]).na.fill(0))
    words = wide.filter("entry = ''").first()
    found = {}
    for fold in (-1, *range(FOLDS)):
        others = [k for k in range(FOLDS) if k != fold]
        n0, n1 = (sum(words[f"{k}_{x}"] for k in others) + 1 for x in ("x0", "x1"))
        x0, x1, d1 = (sum((F.col(f"{k}_{x}") for k in others), F.lit(0)) for x in ("x0", "x1", "d1"))
        ratio = F.log((x1 + _PRIOR) / n1) - F.log((x0 + _PRIOR) / n0)
        z = ratio / F.sqrt(1 / (x1 + _PRIOR) + 1 / (x0 + _PRIOR))
        top = wide.filter("entry != ''").select("entry", d1.alias("d1"), ratio.alias("ratio"), z.alias("z")).filter((F.col("d1") >= LEAST_TEXTS) & (F.col("ratio") >= LEAST_RATIO) & (F.col("z") >= LEAST_Z))
        found[fold] = {r["entry"]: float(min(r["ratio"], 6.0)) for r in top.orderBy(F.desc("z"), "entry").limit(size).collect()}
    return found


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled texts of each label, none of them held out; the bound is the parameter.

    With one label or none there is nothing to learn, and the model is that label's share.
    """
    sample = training_rows(docs, labels, id_col, text_col, label_col, rows)
    counts = {r["y"]: r["w"] for r in sample.groupBy("y").agg(F.sum("weight").alias("w")).collect()}
    prior = counts.get(1, 0.0) / max(sum(counts.values()), 1.0)
    if len(counts) < 2:
        return Model({}, None, None, prior)
    by_fold = lexicons(sample)
    # At most ``rows`` short rows for each label, in an order of their own, so that sums don't depend on how they came.
    seen = sorted((r["fold"], r["y"], r["weight"], r["features"]) for r in _read(sample, by_fold).collect())
    fold, y, weight = (np.array([r[k] for r in seen], float) for k in range(3))
    x = np.array([r[3] for r in seen])
    trees, p = grow(x, y), np.zeros(len(y))
    for k in np.unique(fold):
        own, others = fold == k, y[fold != k]
        # A fold is judged by trees of the others where those have both labels, else by the trees of all.
        p[own] = (grow(x[~own], others) if 0 < others.sum() < len(others) else trees).probability(x[own])
    return Model(by_fold[-1], trees, isotonic(p, y, weight), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, held_out, score, predicted, features``.

    Only the text makes a score. Null and empty texts have a score too, that of a text without words. Very long texts are read
    whole, in one task each. A null id is not held out. Repeated rows and equal texts get equal scores. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.lexicon)
        for batch in text_slices(batches, "text"):
            found = [reader.features(t) for t in text_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(model.scores(np.array(found))), pa.array(found, pa.list_(pa.float64()))], names=["id", "held_out", "score", "features"])

    judged = rows.mapInArrow(judge, f"id {kind}, held_out boolean, score double, features array<double>")
    return judged.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= least_score).cast("int").alias("predicted"), "features")
