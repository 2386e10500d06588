"""Best-fit-decreasing packing of token sequences.

Pieces of one length are interchangeable, so the packing itself runs over the histogram of lengths (at most ``capacity``
rows, whatever the corpus) and over ranges of bins with equal contents. A segment tree over remaining capacities finds the
tightest open bins in logarithmic time. Spark then numbers the pieces within each length and joins them to their bins.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions, text_slices

CAPACITY = 4096
END_ID = 1
#: Distinct words whose ids a Python worker keeps; beyond that it starts anew.
CACHE_WORDS = 1_000_000


class WordIds:
    """Ids of white-space separated words, each encoded once by the tokenizer.

    The tokenizer drops white space and never joins what it separates, so a text's ids are its words' ids in order.
    """

    #: Fixed value: how the tokenizer cuts a word, after normalising it, before it merges characters.
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    WORDS_AT_ONCE = 512
    #: A single mark after a letter and before white space is a part of its own.
    MARK = re.compile(rb"(?<=[a-z])([.,])(?=[\x20\x09-\x0D]|$)")

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = regex.compile(self.PARTS)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        # Special tokens are told before letters are folded.
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.offsets = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words in one call and where each word ends, told by their parts: each ends with a closing token."""
        got = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        parts = np.cumsum([len(self.parts.findall(normalize("NFC", w).lower())) for w in words])
        closed = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(self.last[got]) + 1])
        if len(closed) - 1 == parts[-1] and closed[-1] == len(got):
            return got, closed[parts]
        # Special tokens and characters that the two libraries see otherwise: word by word.
        each = [self.tokenizer.encode(w, add_special_tokens=False).ids for w in words]
        return np.array([i for ids in each for i in ids], np.uint32), np.cumsum([len(ids) for ids in each])

    def learn(self, words: list[bytes]) -> None:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids, ends = [self.ids], [self.offsets]
        for i in range(0, len(texts), self.WORDS_AT_ONCE):
            got, end = self._together(texts[i : i + self.WORDS_AT_ONCE])
            ids.append(got)
            ends.append(ends[-1][-1] + end)
        base = len(self.known)
        self.known.update((w, base + k) for k, w in enumerate(words))
        self.ids, self.offsets = np.concatenate(ids), np.concatenate(ends)

    def _words(self, text: bytes) -> list[bytes]:
        """Words in fewer spellings: A-Z folded, as the tokenizer does itself, and single marks apart."""
        low = text.lower()
        return text.split() if any(s in low for s in self.special) else self.MARK.sub(rb" \1", low).split()

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text ends."""
        split = [self._words(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.clear()
        known = self.known
        if new := list(set().union(*split).difference(known)):
            self.learn(new)
        counts = np.array([len(w) for w in split], np.int64)
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        sizes = self.offsets[at + 1] - self.offsets[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.offsets[at] - (ends - sizes), sizes) + np.arange(total)]
        bounds = np.concatenate([np.zeros(1, np.int64), ends])
        return ids, bounds[np.cumsum(counts)]


_WORKERS: dict[str, WordIds] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise whole texts and cut those longer than ``capacity``: ``id_col, piece, start, length, ids`` (uint32, little-endian).

    Each document ends with ``END_ID``, so a null or empty text is one piece of one token. Null ids are kept as null.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _WORKERS.get(tokenizer_path) or _WORKERS.setdefault(tokenizer_path, WordIds(tokenizer_path))
        for batch in text_slices(batches, "text"):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            ids, ends = words.encode(texts)
            ids = np.insert(ids, ends, END_ID).astype("<u4")
            ends = ends + np.arange(1, len(ends) + 1)
            begins = np.concatenate([np.zeros(1, np.int64), ends[:-1]])
            n = -(-(ends - begins) // capacity)
            doc = np.repeat(np.arange(len(texts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = begins[doc] + piece * capacity
            stop = np.minimum(start + capacity, ends[doc])
            # Pieces are gapless, so the ids' bytes are the binary column's data and their starts its offsets.
            data = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(np.append(start, stop[-1:]).astype(np.int32) * np.int32(4)), pa.py_buffer(ids.tobytes())])
            keys = batch.column("id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([keys, pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(stop - start), data], names=["id", "piece", "start", "length", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "id long, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


class CapacityTree:
    """A segment tree over remaining capacities 0..size: which have open bins, and the least at or above a wanted one."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.used = [0] * (2 * self.leaves)

    def set(self, capacity: int, there: bool) -> None:
        at = self.leaves + capacity
        self.used[at] = int(there)
        while at > 1:
            at >>= 1
            self.used[at] = self.used[2 * at] | self.used[2 * at + 1]

    def tightest(self, wanted: int) -> int | None:
        at = self.leaves + wanted
        if self.used[at]:
            return wanted
        while at > 1:
            if not at & 1 and self.used[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Place ``counts`` pieces of each length: rows ``(length, first, end, per_bin, bin, offset)``.

    Pieces ``first`` to ``end`` (exclusive) of that length fill bins from ``bin`` on, ``per_bin`` in each, from ``offset``.
    The bins are those of best fit decreasing: after a piece, its own bin is the tightest as long as another one fits.
    """
    tree, open_bins, placed, bins = CapacityTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def put(left: int, start: int, n: int) -> None:
        if left and n:
            if not open_bins[left]:
                tree.set(left, True)
            open_bins[left].append((start, n))

    for length in sorted(counts, reverse=True):
        done, todo = 0, counts[length]
        while done < todo:
            left = tree.tightest(length)
            if left is None:
                n = -(-(todo - done) // (capacity // length))
                put(capacity, bins, n)
                bins += n
                continue
            start, n = open_bins[left].pop()
            if not open_bins[left]:
                tree.set(left, False)
            per = left // length
            full = min(n, (todo - done) // per)
            if full:
                placed.append((length, done, done + full * per, per, start, capacity - left))
                put(left - per * length, start, full)
                done += full * per
            rest = min(todo - done, per) if full < n else 0
            if rest:
                placed.append((length, done, done + rest, rest, start + full, capacity - left))
                put(left - rest * length, start + full, 1)
                done += rest
            put(left, start + full + bool(rest), n - full - bool(rest))
    return placed


def pack(pieces: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces`` (``id_col, piece, length`` and whatever else they have).

    ``pieces`` must be a written or checkpointed table, as it is read twice. The histogram is the only thing the driver
    gathers, and the placements, of which there are a few for each length, the only thing broadcast.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = sum(counts.values())
    placed = spark.createDataFrame(best_fit_decreasing(counts, capacity), "p_length long, first long, end long, per_bin long, bin long, p_offset long")
    share = 4 * shuffle_partitions(spark) / max(1, rows)
    ranges = spark.createDataFrame([(k, max(1, int(n * share))) for k, n in counts.items()], "length long, ranges long")
    salted = pieces.join(F.broadcast(ranges), "length").withColumn("salt", F.pmod(F.xxhash64(id_col, "piece"), F.col("ranges"))).drop("ranges")
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "salt").orderBy(id_col, "piece")
    numbered = salted.withColumn("within", F.row_number().over(within) - 1).join(offsets, ["length", "salt"]).withColumn("place", F.col("within") + F.col("before"))
    found = numbered.join(F.broadcast(placed), (F.col("length") == F.col("p_length")) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("end")))
    at = F.col("place") - F.col("first")
    keep = [c for c in pieces.columns]
    return found.select(*keep, (F.col("bin") + F.floor(at / F.col("per_bin"))).cast("long").alias("sequence_id"), (F.col("p_offset") + (at % F.col("per_bin")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack ``docs``: one row per piece, ids as their digest.

    Every row of ``docs`` is a document of its own, repeated or not; ties between pieces of one length go by id and piece.
    Null and empty texts are the end mark alone. A null id is allowed. A very long text is tokenised by one task and cut into
    as many pieces as it takes. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    pieces = token_pieces(docs, tokenizer_path, capacity, id_col, text_col)
    return pack(cut_lineage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")), capacity, id_col)
