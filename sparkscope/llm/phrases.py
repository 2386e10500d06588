"""Phrase collocations: repeated word sequences, scored by how little chance explains them.

At each place of the texts the longest frequent sequence of up to five words that ends there is taken. Equal ones are counted,
and those that end with the same two words meet in a generalised suffix automaton over words. A state's occurrences are those of
the states whose suffix links lead to it, and each state gives out its words' sequences of two to five words with their count:
one row for each, however many tasks there are. Whether a sequence is part of a longer one that occurs as often is told by the
counts of all.

A sequence that is frequent has frequent parts. So words are counted first, then pairs of what was frequent, in buckets by hash:
a bucket below the threshold holds nothing frequent. Only the runs of texts that frequent pairs link are kept, and counted in the
same way by three words and more; what ends at a place is cut by that before it enters an automaton. Sequences that share a bucket cost
time and never change a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions, text_bytes, text_slices

LEAST, MOST_WORDS, TOP, UNKNOWN = 100, 5, 2000, "und"
#: Words of different sequences that one shard's automata take, and places that are given out at once.
SHARD_WORDS, BLOCK_WORDS = 1 << 17, 1 << 12
#: Buckets of sequences, as powers of two: as many as hold an eighth of the threshold each or less, within these bounds. The
#: bitmaps that go to every task hold a bit for each, 128 MB at most.
LEAST_BITS, MOST_BITS = 18, 30
_PART_BITS = 18
#: Buckets that are counted together, as a power of two: a task's counts of these move as one row.
_BLOCK_BITS = 12
#: Languages up to which their word counts are broadcast.
SMALL = 100_000
_MARK = b"\xff"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))


def words(text: bytes) -> list[bytes]:
    """Words in lower case, with a mark (no byte of UTF-8) where a piece ends."""
    return text.translate(_FOLD).replace(_MARK, b" \xff ").split()


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray | None]]:
    """Words of the texts of one language in a slice of a batch, a mark after each text; how often each word counts, where the
    batch says it by ``n``."""
    for batch in text_slices(batches, "text"):
        texts: dict[str, list[int]] = {}
        all_ = text_bytes(batch, "text")
        times = batch.column("n").to_numpy() if "n" in batch.schema.names else None
        for i, name in enumerate(batch.column("lang").to_pylist()):
            texts.setdefault(name, []).append(i)
        for name, own in texts.items():
            found = words(b"\n".join([all_[i] for i in own]) + b"\n")
            # Texts that come with a number have words between single blanks and no marks.
            yield name, found, None if times is None else np.repeat(times[own], [all_[i].count(b" ") + 2 for i in own])


def _rows(docs: DataFrame, text_col: str, group_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(group_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def word_counts(rows: DataFrame) -> DataFrame:
    """``lang, word, n`` for ``lang, text``; the row without a word has all words of its language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, own in held.items():
                own.pop(_MARK, None)
                n = [*own.values(), sum(own.values())]
                found = pa.array([*own, None], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), found, pa.array(n, pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for name, found, _ in _by_language(batches):
            held.setdefault(name, Counter()).update(found)
            if sum(map(len, held.values())) > 200_000:
                yield from told()
        yield from told()

    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class _Ids(dict):
    """Hashes of a language's words, 0 for the mark and, where ``bits`` are given, for words whose bucket is not set."""

    def __init__(self, lang: str, bits: np.ndarray | None) -> None:
        super().__init__()
        self.seed, self.bits, self.last = xxhash.xxh32_intdigest(lang.encode()), bits if bits is None else bits.tobytes(), 0 if bits is None else len(bits) * 8 - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        own = xxhash.xxh64_intdigest(word, self.seed) or 1
        at = (own ^ own >> 31) & self.last
        if word == _MARK or (self.bits is not None and not self.bits[at >> 3] >> (at & 7) & 1):
            own = 0
        self[word] = own
        return own

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids ^ (ids >> np.uint64(31))) & np.uint64(buckets - 1)


def _set(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _bucket(ids, len(bits) * 8)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + b
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)


def _linked(ids: np.ndarray, size: int, bits: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the sequences of ``size`` words by their first word, which of them have frequent parts by the bitmaps of shorter
    ones, and for each word how many words end with it that are frequent, ``size`` at most."""
    known, mixed = ids != 0, ids
    reach = known.astype(np.int8)
    for n in range(2, size + 1):
        if len(mixed) < 2:
            return mixed[:0], known[:0], reach
        mixed, known = _mixed(mixed[:-1], ids[n - 1 :]), known[:-1] & known[1:]
        if n in bits:
            known = known & _set(bits[n], mixed)
        reach[n - 1 :][known] = n
    return mixed, known, reach


def _bitmap(spark: SparkSession, counts: DataFrame, buckets: int) -> np.ndarray:
    """Bits of the buckets in ``counts``, packed by the tasks: the driver gets an eighth of a byte for each bucket at most."""

    def pack(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << _PART_BITS, np.uint8)
        bits[table.column("bucket").to_numpy() & ((1 << _PART_BITS) - 1)] = 1
        return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    whole = np.zeros(buckets // 8, np.uint8)
    parted = counts.select("bucket", F.shiftright("bucket", _PART_BITS).cast("int").alias("part"))
    size = 1 << _PART_BITS - 3
    for row in parted.groupBy("part").applyInArrow(pack, "part int, bits binary").toLocalIterator():
        whole[row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return whole


def _word_bits(spark: SparkSession, frequent: DataFrame, buckets: int) -> np.ndarray:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [xxhash.xxh64_intdigest(w, xxhash.xxh32_intdigest(n.encode())) or 1 for n, w in zip(batch.column("lang").to_pylist(), text_bytes(batch, "word"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(_bucket(np.array(own, np.uint64), buckets).astype(np.int64))], names=["bucket"])

    return _bitmap(spark, frequent.select("lang", "word").mapInArrow(place, "bucket long"), buckets)


def _ids(held: dict[str, _Ids], name: str, bits: np.ndarray | None) -> _Ids:
    """A language's hashes, remembered for some languages."""
    return held.setdefault(name, _Ids(name, bits)) if name in held or len(held) < 64 else _Ids(name, bits)


def _block_counts(spark: SparkSession, rows: DataFrame, least: int, buckets: int, size: int, bits: dict[int, np.ndarray]) -> DataFrame:
    """``block, places, n``: how often the buckets of sequences of ``size`` words are met, ``least`` at most, by the bitmaps of
    what they consist of. A task makes an array for each block of buckets, not a row for each bucket."""
    sent = spark.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found, times, waiting = {}, [], [], 0

        def told() -> pa.RecordBatch:
            at, place = np.unique(np.concatenate(found), return_inverse=True)
            # Counts beyond the threshold say no more than the threshold.
            n = np.minimum(np.bincount(place, np.concatenate(times) if times else None), least).astype(np.uint32)
            own = (at >> np.uint64(_BLOCK_BITS)).astype(np.int32)
            cuts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own)).tolist()
            within = (at & np.uint64((1 << _BLOCK_BITS) - 1)).astype(np.uint16)
            parts = [pa.array([x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (within, n)]
            return pa.RecordBatch.from_arrays([pa.array(own[cuts[:-1]]), *parts], names=["block", "places", "n"])

        for name, own, weights in _by_language(batches):
            mixed, known, _ = _linked(_ids(held, name, sent.value.get(1)).of(own), size, {n: b for n, b in sent.value.items() if 1 < n < size})
            found.append(_bucket(mixed[known], buckets))
            if weights is not None:
                times.append(weights[: len(known)][known])
            waiting += len(found[-1])
            if waiting > 2_000_000:
                yield told()
                found, times, waiting = [], [], 0
        if waiting:
            yield told()

    return rows.mapInArrow(count, "block int, places binary, n binary")


def _link_bits(spark: SparkSession, rows: DataFrame, least: int, buckets: int, size: int, bits: dict[int, np.ndarray]) -> np.ndarray:
    """The bitmap of sequences of ``size`` words that may occur ``least`` times, from those of what they consist of."""

    def add(table: pa.Table) -> pa.Table:
        places, n = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("places", np.uint16), ("n", np.uint32)))
        enough = np.flatnonzero(np.bincount(places, n) >= least)
        return pa.table({"bucket": pa.array(enough + (table.column("block")[0].as_py() << _BLOCK_BITS), pa.int64())})

    counts = _block_counts(spark, rows, least, buckets, size, bits).groupBy("block").applyInArrow(add, "bucket long")
    return _bitmap(spark, counts, buckets)


def segments(found: list[bytes], ids: np.ndarray, most: int, bits: dict[int, np.ndarray], block: int = BLOCK_WORDS) -> Iterator[tuple[tuple[bytes, ...], int, bool, int]]:
    """Word sequences that hold each frequent one of up to ``most`` words once: their words, how many at their start are there
    for what follows only, whether more of the run follows, and the place of the first.

    A sequence goes on as long as all that ends with its next word, up to ``most`` words, is frequent; else the next one begins
    with the frequent words before that word. Long ones are cut at ``block`` words, the words before a cut standing once more
    before what comes after it.
    """
    if len(ids) < 2:
        return
    reach = _linked(ids, most, bits)[2].astype(np.int64)
    full = np.minimum(np.concatenate([[0], reach[:-1]]) + 1, most)
    cuts = np.flatnonzero((reach < full) | (np.arange(len(reach)) == 0))
    ends = np.append(cuts[1:], len(reach))
    goes_on = np.append(reach[cuts[1:]] > 1, False)
    contexts = np.maximum(reach[cuts] - 1, 0)
    starts = cuts - contexts + (reach[cuts] == 0)
    some = ends - starts > 1
    for start, end, context, more in zip(starts[some].tolist(), ends[some].tolist(), contexts[some].tolist(), goes_on[some].tolist(), strict=True):
        if end - start <= block + context:
            yield tuple(found[start:end]), context, more, start
            continue
        for at in range(start + context, end, block):
            before = min(most - 1, at - start)
            yield tuple(found[at - before : min(at + block, end)]), before, more or at + block < end, at - before


def _runs(spark: SparkSession, rows: DataFrame, bits: dict[int, np.ndarray]) -> DataFrame:
    """``lang, text, words``: what is left of each text, its runs of words that frequent pairs link, a line each, and how many
    words these are.

    A row for each text at most, no longer than the text itself, so that rows and bytes are bounded by the input's whatever is
    frequent, and none moves between tasks.
    """
    sent = spark.sparkContext.broadcast(bits)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Ids] = {}
        for batch in text_slices(batches, "text"):
            texts: dict[str, list[bytes]] = {}
            for name, text in zip(batch.column("lang").to_pylist(), text_bytes(batch, "text"), strict=True):
                texts.setdefault(name, []).append(text)
            langs, left, counts = [], [], []
            for name, own in texts.items():
                found, ends = [], []
                for text in own:
                    found += words(text + b"\n")
                    ends.append(len(found))
                linked = _linked(_ids(held, name, sent.value[1]).of(found), 2, {2: sent.value[2]})[2] > 1
                # A run goes from the word before the first linked one to the last. Marks are never linked, so it lies in one text.
                turns = np.diff(linked.astype(np.int8), prepend=0, append=0)
                starts, stops = np.flatnonzero(turns > 0) - 1, np.flatnonzero(turns < 0)
                runs = [b" ".join(found[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
                before = np.append(0, np.cumsum(stops - starts)).tolist()
                cuts = [0, *np.searchsorted(starts, ends).tolist()]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a < b:
                        langs.append(name)
                        left.append(b"\n".join(runs[a:b]))
                        counts.append(before[b] - before[a])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(left, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "text", "words"])

    return cut_lineage(rows.mapInArrow(cut, "lang string, text string, words long"))


class Automaton:
    """A generalised suffix automaton over weighted word sequences."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count, self.seen = [-1], [0], [0], [((), 0)]
        self.cut: set[int] = set()

    def _state(self, length: int, follows: dict[bytes, int], seen: tuple) -> int:
        self.next.append(follows)
        self.link.append(0)
        self.length.append(length)
        self.count.append(0)
        self.seen.append(seen)
        return len(self.next) - 1

    def _split(self, before: int, word: bytes, state: int) -> int:
        """The state of ``before`` and ``word`` alone, parted from a state that also holds longer sequences."""
        own = self._state(self.length[before] + 1, dict(self.next[state]), self.seen[state])
        self.link[own], self.link[state] = self.link[state], own
        while before >= 0 and self.next[before].get(word) == state:
            self.next[before][word] = own
            before = self.link[before]
        return own

    def add(self, sequence: tuple[bytes, ...], weight: int, context: int = 0, more: bool = False) -> None:
        """Count a sequence ``weight`` times; what ends within its first ``context`` words is not counted. Where ``more`` follows,
        nothing at its end is open to the right."""
        last, follow, link, length = 0, self.next, self.link, self.length
        for i, word in enumerate(sequence):
            known = follow[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._split(last, word, known)
            else:
                own = self._state(length[last] + 1, {}, (sequence, i))
                at = last
                while at >= 0 and word not in follow[at]:
                    follow[at][word] = own
                    at = link[at]
                if at >= 0:
                    known = follow[at][word]
                    link[own] = known if length[known] == length[at] + 1 else self._split(at, word, known)
                last = own
            if i >= context:
                self.count[last] += weight
        if more:
            self.cut.add(last)

    def phrases(self, most: int = MOST_WORDS) -> Iterator[tuple[tuple[bytes, ...], int, bool, bool]]:
        """Sequences of two to ``most`` words, their counts, and whether they are open to the left and right: whether no longer
        one by a word has all of their occurrences."""
        link, length, count = self.link, self.length, self.count
        longest = [0] * len(count)
        for state in sorted(range(1, len(count)), key=length.__getitem__, reverse=True):
            up = link[state]
            if state in self.cut:
                self.cut.add(up)
            count[up] += count[state]
            longest[up] = max(longest[up], count[state])
        for state in range(1, len(count)):
            n = count[state]
            if not n or length[state] < 2 or length[link[state]] >= most:
                continue
            right = state not in self.cut and all(count[x] < n for x in self.next[state].values())
            words_, end = self.seen[state]
            for size in range(max(2, length[link[state]] + 1), min(length[state], most) + 1):
                yield words_[end + 1 - size : end + 1], n, size == length[state] and longest[state] < n, right


def _ends(spark: SparkSession, runs: DataFrame, most: int, bits: dict[int, np.ndarray], block: int) -> DataFrame:
    """``lang, text, n``: the longest frequent sequence that ends at each place of the runs, and how often it does.

    A row for each place, not for each sequence and task, so that rows grow with the runs' words at most.
    """
    sent = spark.sparkContext.broadcast(bits)

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, _Ids] = {}
        for name, own, weights in _by_language(batches):
            reach = _linked(_ids(held, name, None).of(own), most, sent.value)[2]
            times = np.ones(len(own), np.int64) if weights is None else weights
            places = np.flatnonzero(reach > 1)
            for at in range(0, len(places), block):
                last = places[at : at + block]
                sizes = reach[last].tolist()
                texts = [b" ".join(own[end - size : end]) for end, size in zip((last + 1).tolist(), sizes, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts), pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(times[last])], names=["lang", "text", "n"])

    met = runs.select(*[c for c in ("lang", "text", "n") if c in runs.columns]).mapInArrow(longest, "lang string, text string, n long")
    return met.groupBy("lang", "text").agg(F.sum("n").alias("n"))


def _shard_counts(spark: SparkSession, runs: DataFrame, most: int, bits: dict[int, np.ndarray], shard_words: int, block: int) -> DataFrame:
    """``lang, phrase, size, n``: what ends alike meets in one automaton, so a sequence is given out once, or once more
    where its endings fill several shards."""

    def enumerate_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, Automaton] = {}
        size = 0

        def told() -> Iterator[pa.RecordBatch]:
            for name, automaton in waiting.items():
                out = list(automaton.phrases(most))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(out), pa.string()), pa.array([b" ".join(p) for p, *_ in out], pa.binary()).cast(pa.string()), pa.array([len(p) for p, *_ in out], pa.int32()),
                     pa.array([n for _, n, *_ in out], pa.int64())],
                    names=["lang", "phrase", "size", "n"])
            waiting.clear()

        for batch in batches:
            for name, text, n in zip(batch.column("lang").to_pylist(), text_bytes(batch, "text"), batch.column("n").to_pylist(), strict=True):
                sequence = tuple(text.split(b" "))
                # Counted at its end alone: suffix links hand its count to all that end there.
                waiting.setdefault(name, Automaton()).add(sequence, n, len(sequence) - 1, True)
                size += len(sequence)
                if size >= shard_words:
                    yield from told()
                    size = 0
        yield from told()

    alike = F.substring_index("text", " ", -2)
    ends = _ends(spark, runs, most, bits, block).select("lang", alike.alias("end"), "text", "n").repartition("lang", "end").sortWithinPartitions("lang", "end")
    return ends.select("lang", "text", "n").mapInArrow(enumerate_shards, "lang string, phrase string, size int, n long")


def _bounded(df: DataFrame, most: int = SMALL) -> DataFrame:
    """Broadcast where it has at most ``most`` rows; ``df`` is written already."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _part(first: Callable[[Column], Column], size: Callable[[Column], Column]) -> Column:
    return F.array_join(F.slice("w", first(F.col("cut")), size(F.col("cut"))), " ")


def _buckets(n: int, least: int) -> int:
    return 1 << min(max((8 * int(n) // least).bit_length(), LEAST_BITS), MOST_BITS)


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", least: int = LEAST, most: int = MOST_WORDS, top: int = TOP, shard_words: int = SHARD_WORDS, block: int = BLOCK_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of each language by score.

    Words stand between blanks and tabs within pieces that end at ``. , ; : ! ?`` and line ends. ``a`` counts all places of a
    phrase of two to ``most`` words, overlapping ones too, at least ``least``; ``n`` all words of the language; ``l`` and ``r``
    the parts at the cut of the lowest ``score``, a thousand times ``a n / (l r)`` rounded down, the first cut of equals. A
    phrase within a longer one that occurs as often goes. Ties go by ``a``, then the phrase's bytes.

    A null language is ``und``, together with texts that say so; an empty name is a language. Null and empty texts have no
    words, and a language without words or frequent phrases no rows. Very long texts are read whole, a piece without any mark as
    one. Repeated rows count each time. Null ids don't matter. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    spark, rows = docs.sparkSession, _rows(docs, text_col, group_col)
    counted = cut_lineage(word_counts(rows).filter((F.col("n") >= least) | F.col("word").isNull()))
    totals, frequent = counted.filter("word IS NULL").select("lang", "n"), counted.filter("word IS NOT NULL")
    whole = totals.agg(F.sum("n")).first()[0] or 0
    buckets = _buckets(whole, least)
    bits = {1: _word_bits(spark, frequent, buckets)}
    bits[2] = _link_bits(spark, rows, least, buckets, 2, bits)
    runs = _runs(spark, rows, bits)
    buckets = _buckets(runs.agg(F.sum("words")).first()[0] or 0, least)
    bits = {}
    for size in range(3, most + 1):
        bits[size] = _link_bits(spark, runs.filter(F.col("words") >= size), least, buckets, size, bits)
    shards = _shard_counts(spark, runs, most, bits, shard_words, block)
    candidates = cut_lineage(shards.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a")).filter(F.col("a") >= least))
    known = cut_lineage(frequent.select("lang", F.col("word").alias("part"), F.col("n").alias("f")).unionByName(candidates.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))))

    # Counts are those of all texts here: each candidate meets the longer ones by a word on either side.
    shorter = F.expr("explode(array(substring_index(phrase, ' ', 1 - size), substring_index(phrase, ' ', size - 1)))")
    longer = candidates.filter("size > 2").select("lang", shorter.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held_by"))
    within = candidates.filter(F.col("size") < most).join(cut_lineage(longer), ["lang", "phrase"]).filter("held_by >= a").select("lang", "phrase")
    kept = candidates.join(within, ["lang", "phrase"], "left_anti")

    # Both sides of the joins are written or plain, so that Spark can split the part that begins or ends a third of all phrases.
    cuts = kept.select("lang", "phrase", "a", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    parts = cuts.select("lang", "phrase", "a", "cut", _part(lambda c: F.lit(1), lambda c: c).alias("first"), _part(lambda c: c + 1, lambda c: F.size("w") - c).alias("rest"))
    joined = parts.join(known.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    scored = joined.join(_bounded(totals), "lang").withColumn("above", wide("a") * wide("n") * F.lit(1000)).withColumn("below", wide("l") * wide("r")).withColumn("score", F.expr("above div below"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are picked among its parts' best, twice, before they meet in one task.
    salted = lowest.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(shuffle_partitions(spark)))).withColumn("few", F.col("salt") % 32)
    for keys in (("lang", "salt"), ("lang", "few"), ("lang",)):
        salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= top)
    return salted.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
