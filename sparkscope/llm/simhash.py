"""SimHash near-dedup by anchor-point covering.

The anchors are a covering code: nine perfect Hamming(7,4) codes side by side, over 63 of the 64 bits. Each of the nine
blocks has a code word within one bit, so every point has an anchor within the covering radius of nine. For two fingerprints
at most ``t`` bits apart, take a point halfway and its nearest anchor: both exceed the anchor's radius, counted by blocks, by
at most half of ``t``, rounded up. So fingerprints are replicated to all anchors with that excess (the radius plus half the
threshold from either side; the radius plus the whole threshold from one side would hold the same pairs in many more rows),
and the pairs of an anchor are compared exactly. Only distinct fingerprints are replicated, and an anchor gives out a
spanning forest of its links, never all its pairs.

A few bits on 64 are far stricter than a similarity of 0.8, where fingerprints differ in about ten. ``similar_groups`` takes
that similarity: its fingerprints have several words, each table of anchors covers a few blocks of them, and the number of
tables follows from the wanted share of found pairs, so that it is the same at every size. Anchors only propose: the shingles
of what they connect are compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions, text_bytes, text_slices
from .substrings import Words, _mixed

SEED = 42
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCKS, _BITS = 9, 7
#: Similar pairs: excess over an anchor's radius, share of pairs at the wanted similarity that are found, standard deviations that
#: a pair's differing bits may exceed their mean, words of a fingerprint at least and those compared, and rows of an anchor.
EXCESS, FOUND, DEVIATIONS, WIDE_WORDS, COMPARED_WORDS, ANCHOR_ROWS = 1, 0.98, 3.0, 8, 4, 64
#: Fingerprints that a part of a table should hold; larger groups of an anchor are joined by a forest.
PART_ROWS, SMALL_ANCHOR = 1 << 16, 64
#: Connected texts are compared in cells of about so many; from a larger component, so many of its texts are in all of its cells.
CELL_TEXTS, LEADERS = 1024, 32
#: Ids of documents lie below; from here on nodes without an id are numbered.
_NO_ID = 1 << 62


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of each run of ``size`` words, A-Z in lower case, joined by single spaces; of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.translate(_LOWER).split()
    if not words:
        return []
    if len(words) <= size:
        return [xxh64_intdigest(b" ".join(words), SEED)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1] + 1])
    return [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)]


#: For each byte a word whose eight bytes are the byte's bits: sums of up to 255 of them don't overflow.
_SPREAD = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).copy().view("<u8").ravel()


def _majorities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes the word of the bits that more than half of them have; 0 for an empty run."""
    out, full = np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    if not len(full):
        return out
    n, starts = counts[full], (np.cumsum(counts) - counts)[full]
    pieces = -(-n // 255)
    own = np.repeat(np.arange(len(full)), pieces)
    at = starts[own] + 255 * (np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    sums = np.add.reduceat(_SPREAD[hashes.astype("<u8").view(np.uint8).reshape(-1, 8)], at, axis=0)
    votes = np.add.reduceat(sums.view(np.uint8).reshape(len(own), 64), np.cumsum(pieces) - pieces, axis=0, dtype=np.int64)
    out[full] = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp``: bit by bit, 1 where more than half of the shingles' hashes have it; 0 for a text without words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            hashes = [shingle_hashes(t or b"", shingle_words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            counts = np.array([len(h) for h in hashes], np.int64)
            fp = _majorities(np.fromiter((x for h in hashes for x in h), np.uint64, int(counts.sum())), counts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(compute, "id long, fp long").withColumnRenamed("id", id_col)


def _code_words() -> np.ndarray:
    """The 16 words of the Hamming code: bits at places 1..7 whose places XOR to zero."""
    syndrome = [0] * 128
    for v in range(1, 128):
        low = v & -v
        syndrome[v] = syndrome[v ^ low] ^ low.bit_length()
    return np.array([v for v in range(128) if not syndrome[v]], np.int64)


def _away() -> np.ndarray:
    """By how many bits each value of a block exceeds the radius of one around each code word."""
    return np.maximum(np.bitwise_count(np.arange(128)[:, None] ^ _code_words()[None, :]).astype(np.int64) - 1, 0)


def _cover(values: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ``(row, anchor, left)`` of rows of blocks' values whose excess over the anchor's radius is at most ``left``."""
    away, most = _away(), int(left.max(initial=0))
    options = {(v, k): np.flatnonzero(away[v] <= k) for v in range(128) for k in range(most + 1)}
    row, anchor = np.arange(len(values)), np.zeros(len(values), np.int64)
    size = np.array([[len(options[v, k]) for k in range(most + 1)] for v in range(128)])
    at = np.cumsum(size.ravel()) - size.ravel()
    flat = np.concatenate([options[v, k] for v in range(128) for k in range(most + 1)])
    for block in range(values.shape[1]):
        value = values[row, block]
        n = size[value, left]
        pick = flat[np.repeat(at[value * (most + 1) + left] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        value, row, anchor, left = (np.repeat(x, n) for x in (value, row, anchor, left))
        anchor, left = anchor << 4 | pick, left - away[value, pick]
    return row, anchor, left


def anchors(fp: np.ndarray, excess: int) -> tuple[np.ndarray, np.ndarray]:
    """All ``(row, anchor)`` where a fingerprint exceeds the blocks' radius of one by at most ``excess`` bits in all."""
    shifts = np.uint64(_BITS) * np.arange(_BLOCKS, dtype=np.uint64)
    values = (fp[:, None] >> shifts[None, :] & np.uint64(127)).astype(np.int64)
    row, anchor, _ = _cover(values, np.full(len(fp), excess))
    return row, anchor


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join all of ``fp`` (distinct) within ``max_bits`` of each other through one another, one for each but a root."""
    links, open_ = [], np.arange(len(fp))
    while len(open_):
        front, root, open_ = open_[:1], open_[0], open_[1:]
        while len(front) and len(open_):
            reached = np.zeros(len(open_), bool)
            for i in range(0, len(front), 64):
                reached |= (np.bitwise_count(fp[front[i : i + 64], None] ^ fp[open_][None, :]) <= max_bits).any(axis=0)
            front, open_ = open_[reached], open_[~reached]
            links += [(root, x) for x in front]
    return links


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``a, b``, some of them repeated, that connect all pairs at most ``max_bits`` apart of the distinct fingerprints ``fps.fp``."""
    excess = (max_bits + 1) // 2

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for i in range(0, len(fp), 4096):
                row, anchor = anchors(fp[i : i + 4096].view(np.uint64), excess)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[i : i + 4096][row])], names=["anchor", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; the last anchor's rows wait for the next batch."""
        rest_a, rest_f = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def linked(a: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            sizes = np.diff(np.append(starts, len(a)))
            two = starts[sizes == 2]
            near = two[np.bitwise_count(f[two].view(np.uint64) ^ f[two + 1].view(np.uint64)) <= max_bits]
            left, right = [f[near]], [f[near + 1]]
            for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
                if found := np.array(_forest(f[s : s + n].view(np.uint64), max_bits), np.int64).reshape(-1, 2).T.tolist():
                    left.append(f[s : s + n][found[0]])
                    right.append(f[s : s + n][found[1]])
            x, y = np.concatenate(left), np.concatenate(right)
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            a, f = np.concatenate([rest_a, batch.column("anchor").to_numpy()]), np.concatenate([rest_f, batch.column("fp").to_numpy()])
            if not len(a):
                continue
            last = int(np.searchsorted(a, a[-1]))
            if last:
                yield linked(a[:last], f[:last])
            rest_a, rest_f = a[last:], f[last:]
        if len(rest_a):
            yield linked(rest_a, rest_f)

    spread = fps.select("fp").repartition(shuffle_partitions(fps.sparkSession)).mapInArrow(replicate, "anchor long, fp long")
    return spread.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, "a long, b long")


def _all_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` of the distinct links ``u > v`` has one ``v`` only, and no ``v`` is a ``u``: nothing is left to connect."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("v", F.lit(0), F.lit(1)))
    held = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
    return not held.agg(F.max((F.col("below") > 0) & (F.col("below") + F.col("above") > 1)).alias("open")).first().open


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``), the root being the component's least node.

    Large stars and small stars in turn until all components are stars: a logarithmic number of rounds, each a few joins
    and aggregates that combine before they shuffle; repeated links are dropped once a round, as neither step makes more
    links than it was given. The driver sees only whether a node is left that belongs to no star.
    """
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    while not _all_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def near_groups(docs: DataFrame, shingle_words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, fingerprint`` (hex), ``component_id``, the smallest id reachable over links.

    Fingerprints link at ``max_bits`` or fewer differing bits. Null and empty texts have fingerprint zero and link like any
    other. Rows with a null id take part; where a whole component has none, its ``component_id`` is null. Repeated rows and
    ties, texts with one fingerprint, get the same component. Very long texts are read whole, each alone in its step. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    printed = cut_lineage(fingerprints(docs, shingle_words, id_col, text_col))
    fps = cut_lineage(printed.groupBy("fp").agg(F.min(id_col).alias("least_id")))
    roots = components(links(fps, max_bits))
    rooted = cut_lineage(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "component_id")
    return printed.join(by_fp, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def differing_share(similarity: float) -> float:
    """Mean share of differing bits between the fingerprints of two shingle sets of one size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def shared_anchor_chance(blocks: int, share: float, excess: int = EXCESS) -> float:
    """How often two fingerprints with this share of differing bits have an anchor over ``blocks`` blocks in common: a simulation."""
    away, rng, n = _away(), np.random.default_rng(0), 1 << 15
    both = {(i, j): ((away <= i).astype(np.int64) @ (away <= j).astype(np.int64).T) > 0 for i in range(excess + 1) for j in range(excess + 1)}
    reached = {k: np.ones(n, bool) for k in both}
    for _ in range(blocks):
        a = rng.integers(0, 128, n)
        b = a ^ ((rng.random((n, _BITS)) < share) << np.arange(_BITS)).sum(axis=1)
        reached = {(x, y): np.logical_or.reduce([reached[x - i, y - j] & both[i, j][a, b] for i in range(x + 1) for j in range(y + 1)]) for x, y in both}
    return float(reached[excess, excess].mean())


def table_plan(rows: int, similarity: float, found: float = FOUND) -> np.ndarray:
    """A row of blocks for each table: blocks enough for an anchor to hold a few rows, and tables enough to find the wanted share
    of pairs, those that ``most_bits`` loses included. No two tables share a block, so their misses do not coincide."""
    blocks = max(2, math.ceil(math.log2(max(2, 12 * rows / ANCHOR_ROWS)) / 4))
    within = (1 + math.erf(DEVIATIONS / math.sqrt(2))) / 2
    tables = math.ceil(math.log(1 - found / within) / math.log(1 - shared_anchor_chance(blocks, differing_share(similarity))))
    return np.random.default_rng(SEED).permutation(tables * blocks).reshape(tables, blocks)


def plan_words(plan: np.ndarray) -> int:
    """Words of a fingerprint that holds all blocks of the plan."""
    return max(WIDE_WORDS, math.ceil(plan.size * _BITS / 64))


def most_bits(similarity: float) -> int:
    """Differing bits among the compared words up to which a pair of this similarity counts as found."""
    share, bits = differing_share(similarity), 64 * COMPARED_WORDS
    return math.floor(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def _rolled_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and how many each text has; shingles as in ``shingle_hashes``."""
    joined = [b" ".join(t.translate(_LOWER).split()) for t in texts]
    full = np.array([i for i, t in enumerate(joined) if t], np.int64)
    words = Words([joined[i] for i in full], size)
    length = np.bincount(words.doc, minlength=len(full))
    begin = np.cumsum(length) - length
    # A text with fewer words than a shingle has is one of its own.
    short = np.flatnonzero(length < size)
    at = np.concatenate([words.at, begin[short]])
    hashes = np.concatenate([words.runs(size, words.at), *(words.runs(int(length[d]), begin[d : d + 1]) + length[d : d + 1].astype(np.uint64) for d in short)])
    counts = np.zeros(len(texts), np.int64)
    counts[full] = np.maximum(length - size + 1, 1)
    return hashes[np.argsort(at, kind="stable")], counts


def wide_fingerprints(docs: DataFrame, shingle_words: int, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, fp, shingles, text_key``: the fingerprint over ``words`` independent 64-bit hashes of each shingle, as
    little-endian bytes; the same number for equal shingles, and for equal texts."""
    keys = np.random.default_rng(SEED).integers(0, 2**63, words, dtype=np.uint64)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            out, sums = np.zeros((len(ids), words), np.uint64), np.zeros(len(ids), np.uint64)
            at = 0
            for part in text_slices(iter([batch]), "text"):
                hashes, counts = _rolled_hashes(text_bytes(part, "text"), shingle_words)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes), dtype=np.uint64)])
                ends = np.cumsum(counts)
                sums[at : at + part.num_rows] = total[ends] - total[ends - counts]
                for k in range(words):
                    x = (hashes ^ keys[k]) * np.uint64(0xBF58476D1CE4E5B9)
                    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    out[at : at + part.num_rows, k] = _majorities(x ^ (x >> np.uint64(32)), counts)
                at += part.num_rows
            data = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.arange(len(ids) + 1, dtype=np.int32) * np.int32(8 * words)), pa.py_buffer(out.astype("<u8").tobytes())])
            yield pa.RecordBatch.from_arrays([ids, data, pa.array(sums.view(np.int64)), batch.column("text_key")], names=["id", "fp", "shingles", "text_key"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return rows.mapInArrow(compute, "id long, fp binary, shingles long, text_key long").withColumnRenamed("id", id_col)


def _shingle_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """Replace ``text`` by ``held``, the sorted hashes of its distinct shingles."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            hashes, counts = _rolled_hashes(text_bytes(part, "text"), shingle_words)
            sets = [np.unique(x).tobytes() for x in np.split(hashes, np.cumsum(counts)[:-1])]
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("group"), pa.array(sets, pa.binary())], names=["node", "group", "held"])

    return texts.select("node", "group", "text").mapInArrow(compute, "node long, group long, held binary")


def _block_values(fp: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Values of the given blocks of fingerprints, which are rows of words."""
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
    own = bits[:, (blocks[:, None] * _BITS + np.arange(_BITS)).ravel()].reshape(len(fp), len(blocks), _BITS)
    return (own.astype(np.int64) << np.arange(_BITS)).sum(axis=2)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _wide_forest(fp: np.ndarray, most: int) -> np.ndarray:
    """Links ``(root, member)`` that join all of ``fp`` within ``most`` bits of each other through one another."""
    links, open_ = [], np.arange(len(fp))
    while len(open_):
        front, root, open_ = open_[:1], open_[0], open_[1:]
        while len(front) and len(open_):
            next_: list[np.ndarray] = []
            for one in front:
                near = _apart(fp[open_], fp[one]) <= most
                next_.append(open_[near])
                open_ = open_[~near]
                if not len(open_):
                    break
            front = np.concatenate(next_)
            links.append(np.stack([np.full(len(front), root), front], axis=1))
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def _stars(n: int, pairs: np.ndarray) -> np.ndarray:
    """For links among 0..n-1 the least member of each one's component, by lowering labels until nothing changes."""
    label = np.arange(n)
    while len(pairs):
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], low)
        np.minimum.at(new, pairs[:, 1], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def _near_in_table(fp: np.ndarray, values: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """Pairs of rows that have an anchor in common and differ in at most ``most`` bits, or links that join them."""
    row, anchor, _ = _cover(values, left)
    order = np.lexsort((row, anchor))
    row, anchor = row[order], anchor[order]
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(anchor)))
    small = np.repeat(sizes <= SMALL_ANCHOR, sizes)
    found, at, step = [], np.flatnonzero(small), 1
    while len(at):
        at = at[at + step < len(anchor)]
        at = at[anchor[at + step] == anchor[at]]
        near = at[_apart(fp[row[at]], fp[row[at + step]]) <= most]
        found.append(np.stack([row[near], row[near + step]], axis=1))
        step += 1
    for s, n in zip(starts[sizes > SMALL_ANCHOR].tolist(), sizes[sizes > SMALL_ANCHOR].tolist(), strict=True):
        members = row[s : s + n]
        found.append(members[_wide_forest(fp[members], most)])
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def similar_links(fps: DataFrame, plan: np.ndarray, most: int, rows: int) -> DataFrame:
    """Links ``a, b`` between nodes of ``fps`` (``node, fp``, distinct) at most ``most`` bits apart that share an anchor.

    A part is a table and the first code words of its anchors: a fingerprint goes once to each part that has an anchor of
    its own, as the table's blocks and the compared words, and the part finds the rest of the anchors. A part gives out one
    link for each of its nodes at most; links of several parts may repeat.
    """
    lead, blocks, words = 1, plan.shape[1], plan_words(plan)
    while lead < blocks and rows * (1 + 2.625 * lead) / 16**lead > PART_ROWS:
        lead += 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), "<u8").reshape(-1, words)
            node = batch.column("node").to_numpy().view(np.uint64)[:, None]
            for table, own in enumerate(plan):
                values = _block_values(fp, own)
                packed = (values << _BITS * np.arange(blocks)).sum(axis=1).view(np.uint64)[:, None]
                data = np.concatenate([node, packed, fp[:, :COMPARED_WORDS]], axis=1)
                row, code, _ = _cover(values[:, :lead], np.full(len(fp), EXCESS))
                order = np.argsort(code, kind="stable")
                codes, first = np.unique(code[order], return_index=True)
                blobs = [data[p].tobytes() for p in np.split(row[order], first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array((table << 4 * lead) + codes), pa.array(blobs, pa.binary())], names=["part", "data"])

    def find(key: tuple, held: pa.Table) -> pa.Table:
        part = key[0].as_py()
        code = part & (1 << 4 * lead) - 1
        data = np.frombuffer(b"".join(held.column("data").to_pylist()), np.uint64).reshape(-1, COMPARED_WORDS + 2)
        data = data[np.argsort(data[:, 0].view(np.int64), kind="stable")]
        node, fp = data[:, 0].view(np.int64), np.ascontiguousarray(data[:, 2:])
        values = data[:, 1].view(np.int64)[:, None] >> _BITS * np.arange(blocks) & 127
        used = sum(_away()[values[:, k], code >> 4 * (lead - 1 - k) & 15] for k in range(lead))
        star = _stars(len(node), _near_in_table(fp, values[:, lead:], EXCESS - used, most))
        linked = np.flatnonzero(star != np.arange(len(node)))
        return pa.table({"a": pa.array(node[star[linked]]), "b": pa.array(node[linked])})

    return fps.select("node", "fp").mapInArrow(deal, "part long, data binary").groupBy("part").applyInArrow(find, "a long, b long")


def _exact_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Links that join all of ``sets`` of at least this Jaccard similarity of each other through one another."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    distinct, label = np.unique(np.concatenate(sets), return_inverse=True)
    held, links = np.zeros(len(distinct), bool), []
    open_, flat, place = np.arange(len(sets)), label, np.repeat(np.arange(len(sets)), sizes)
    while len(open_) > 1:
        front, flat, place, open_ = [int(open_[0])], flat[sizes[open_[0]] :], place[sizes[open_[0]] :] - 1, open_[1:]
        while front and len(open_):
            one = front.pop()
            own = label[ends[one] - sizes[one] : ends[one]]
            held[own] = True
            common = np.bincount(place[held[flat]], minlength=len(open_))
            held[own] = False
            near = common >= similarity * (sizes[one] + sizes[open_] - common) - 1e-9
            if near.any():
                links.append(np.stack([np.full(near.sum(), one), open_[near]], axis=1))
                front += open_[near].tolist()
                rest = ~near[place]
                flat, place, open_ = flat[rest], (np.cumsum(~near) - 1)[place[rest]], open_[~near]
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def _compared(celled: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` that join the similar nodes of a group within each cell (``owner, cells``)."""

    def compare(table: pa.Table) -> pa.Table:
        node, group = table.column("node").to_numpy(), table.column("group").to_numpy()
        held = [np.frombuffer(x, np.uint64) for x in table.column("held").to_pylist()]
        order = np.argsort(group, kind="stable")
        found = [np.zeros((0, 2), np.int64)]
        for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            found.append(node[own[_exact_links([held[i] for i in own], similarity)]])
        pairs = np.concatenate(found)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return celled.select("node", "group", "held", "owner", F.explode("cells").alias("cell")).groupBy("owner", "cell").applyInArrow(compare, "a long, b long")


def exact_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``a, b`` that join the nodes of a group (``node, group, held``) whose sets have this Jaccard similarity.

    Small groups share cells. A large one is cut into cells, each with the group's leaders, through which most similar nodes
    are joined. What is then outside the group's largest component is compared with all of the group, cell by cell.
    """
    cut = lambda n: F.ceil(n / F.lit(CELL_TEXTS)).cast("long")
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    large = sets.groupBy("group").agg(F.count("*").alias("n")).filter(F.col("n") > CELL_TEXTS)
    large = cut_lineage(large)
    cells, own = cut(F.col("n")), lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n)
    leads = own(F.greatest(F.floor(F.col("n") / LEADERS), F.lit(1)), 1) == 0
    shared = F.pmod(F.xxhash64("group"), F.lit(4 * shuffle_partitions(sets.sparkSession)).cast("long"))
    where = F.when(F.col("n").isNull(), F.array(shared)).when(leads, each(cells)).otherwise(F.array(own(cells, 0)))
    tagged = sets.join(F.broadcast(large), "group", "left").withColumn("owner", F.when(F.col("n").isNotNull(), F.col("group")))
    first = cut_lineage(_compared(tagged.withColumn("cells", where), similarity))
    if large.isEmpty():
        return first
    # What is joined so far goes on as stars, so that it is connected once only.
    roots = components(first)
    stars = roots.filter("node != root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    placed = tagged.filter(F.col("n").isNotNull()).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("group", "root").agg(F.count("*").alias("k"))
    most = cut_lineage(sizes.groupBy("group").agg(F.max(F.struct("k", "root")).alias("main"), F.sum("k").alias("all")).filter(F.col("all") > F.col("main.k")))
    if most.isEmpty():
        return stars
    parts = cut(F.col("all") - F.col("main.k"))
    among = F.transform(each(parts), lambda j: own(cells, 0) * parts + j)
    against = F.when(F.col("root") != F.col("main.root"), F.transform(each(cells), lambda i: i * parts + own(parts, 2))).otherwise(F.array().cast("array<bigint>"))
    rest = placed.join(F.broadcast(most), "group").withColumn("cells", F.array_union(among, against))
    return stars.union(_compared(rest, similarity))


def similar_groups(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, found: float = FOUND, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, component_id``, the smallest id reachable over links of similar texts.

    Texts link when the Jaccard similarity of their shingles is at least ``similarity``; of the pairs with this similarity
    at least the share ``found`` is proposed by their fingerprints. Null and empty texts are one group. Ids lie below 2^62.
    Rows with a null id take part; a component of them alone has a null ``component_id``. Repeated rows, and rows with one id
    and text, get the same component; ties go to the smaller id. Very long texts are read whole, their shingles' hashes held
    by one task. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.count()
    plan = table_plan(rows, similarity, found)
    printed = cut_lineage(wide_fingerprints(docs, shingle_words, plan_words(plan), id_col, text_col))
    # A node is its least id, so that a component's root is the smallest id too. Nodes without an id come after all others.
    first = F.min(F.struct(F.coalesce(id_col, F.lit(_NO_ID)).alias("id"), "text_key")).alias("first")
    fps = cut_lineage(printed.groupBy("fp", "shingles").agg(F.min(id_col).alias("least_id"), first).select("fp", "shingles", "first", F.coalesce("least_id", F.lit(_NO_ID) + F.monotonically_increasing_id()).alias("node")))
    proposed = components(similar_links(fps, plan, most_bits(similarity), rows))
    members = fps.join(proposed, "node").select("node", F.col("root").alias("group"), F.col("first.id").alias("_id"), F.col("first.text_key").alias("_key"))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64(text_col).alias("_key"), F.col(text_col).alias("text"))
    sets = cut_lineage(_shingle_sets(texts.join(members, ["_id", "_key"]).dropDuplicates(["node", "_key"]), shingle_words))
    roots = components(exact_links(sets, similarity))
    root = F.coalesce("root", "node")
    by_fp = fps.join(roots, "node", "left").select("fp", "shingles", F.when(root < _NO_ID, root).alias("component_id"))
    return printed.join(by_fp, ["fp", "shingles"]).select(id_col, "component_id")
