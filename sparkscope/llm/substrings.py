"""Substring dedup with prefix-partitioned suffix trees.

Texts are dealt into blocks by a hash of their id. A suffix starts at each word; only its first ``min_words`` words matter.
 1. Each block names its anchors, the least five-word hash of every window, and the frequent prefixes at them. What several
    documents hold has its anchors in several documents; a suffix without a shared anchor is a leaf of its own.
 2. The other suffixes travel by their anchors: equal windows have the same one, so the words around an anchor hold all
    suffixes that it stands for, once. They go to groups by a variable-length prefix at the anchor: its first word, or as
    many as it takes for the prefix to be too rare to fill a group. Where all words of an anchor are frequent, its windows
    travel one by one, by further words: those to the right of the anchor, then those to its left. Each block sends equal words around an anchor once,
    with their smallest document, so that hot passages are combined before they move.
 3. A group cuts the suffixes out again and sorts them, neighbours share their path in the tree, and the nodes at least
    ``min_words`` deep are the repeats. Each gives its smallest document back to the blocks below it.
 4. The blocks remove the words under repeats that a smaller document holds.
Digests only propose what may be equal: wherever suffixes are taken for one, in a group or in a block, their words are compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress, groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, shuffle_partitions, text_bytes, text_slices

MIN_WORDS = 13
ANCHOR_WORDS = 5
#: Bytes of text in a block, and so of suffixes in a group, that a task should hold at most.
BLOCK_BYTES = 256 << 20
#: A prefix is frequent when more than one in so many suffixes for each group starts with it; and at most one in 65,536.
GROUP_SHARE = 16
MOST_PREFIXES = 1 << 16
SLOT_BITS = 20
_PACK_BYTES = 32 << 20
_HASH_BYTES = 1 << 20
#: Places that are hashed or compared at once, so that what a step needs stays small beside the texts.
_PLACES = 1 << 18
_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_LAST_ID = np.iinfo(np.int64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = _U(pow(int(_BASE), -1, 2**64))
    return tuple(np.cumprod(np.concatenate([[_U(1)], np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))


class Words:
    """The words of some texts, one after another, and hashes over runs of them."""

    def __init__(self, texts: list[bytes], min_words: int) -> None:
        self.data = b"\n".join(texts) + b"\n" if texts else b""
        self.buf = buf = np.frombuffer(self.data, np.uint8)
        # Places of words, bytes and texts: half the memory where four bytes hold them.
        place = np.int32 if len(buf) < 2**31 else np.int64
        self.ends = np.flatnonzero((buf == 32) | (buf == 10)).astype(place)
        self.starts = np.concatenate([np.zeros(1, place), self.ends[:-1] + place(1)]) if len(self.ends) else self.ends
        stops = buf[self.ends] == 10
        self.doc = np.cumsum(stops, dtype=place) - stops
        self.min_words = min_words
        self.words = self._word_hashes(buf)
        n = max(0, len(self.words) - min_words + 1)
        self.at = np.flatnonzero(self.doc[:n] == self.doc[min_words - 1 :][:n]).astype(place) if n else np.zeros(0, place)

    def _word_hashes(self, buf: np.ndarray) -> np.ndarray:
        out, first = np.zeros(len(self.starts), np.uint64), 0
        power, inverse = _powers(_HASH_BYTES)
        while first < len(self.starts):
            base = int(self.starts[first])
            last = max(first + 1, int(np.searchsorted(self.ends, base + _HASH_BYTES - 1, "right")))
            n = int(self.ends[last - 1] - base)
            if n > _HASH_BYTES and len(power) <= n:
                power, inverse = _powers(n)
            sums = np.concatenate([[_U(0)], np.cumsum((buf[base : base + n].astype(np.uint64) + _U(1)) * power[:n], dtype=np.uint64)])
            s, e = self.starts[first:last].astype(np.int64) - base, self.ends[first:last].astype(np.int64) - base
            out[first:last] = _mixed((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
            first = last
        return out

    def runs(self, size: int, at: np.ndarray) -> np.ndarray:
        """Hashes of the ``size`` words from each place."""
        out = np.zeros(len(at), np.uint64)
        for i in range(0, len(at), _PLACES):
            some, h = at[i : i + _PLACES], np.zeros(len(at[i : i + _PLACES]), np.uint64)
            for k in range(size):
                h = h * _STEP + self.words[some + k]
            out[i : i + _PLACES] = _mixed(h)
        return out

    def differ(self, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Whether the ``sizes`` words from places ``a`` and ``b`` differ, byte by byte."""
        length = self.ends[a + sizes - 1].astype(np.int64) - self.starts[a]
        out = length != self.ends[b + sizes - 1].astype(np.int64) - self.starts[b]
        for i in range(0, len(a), _PLACES >> 4):
            own = i + np.flatnonzero(~out[i : i + (_PLACES >> 4)])
            if len(own):
                n = length[own]
                first = np.cumsum(n) - n
                along = np.arange(int(n.sum())) - np.repeat(first, n)
                apart = self.buf[np.repeat(self.starts[a[own]].astype(np.int64), n) + along] != self.buf[np.repeat(self.starts[b[own]].astype(np.int64), n) + along]
                out[own] = np.logical_or.reduceat(apart, first)
        return out

    def equals(self, digests: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each set of equal runs of words, and the number of each run's set: digests propose, words decide."""
        _, one, number = np.unique(digests, return_index=True, return_inverse=True)
        other = np.flatnonzero(one[number] != np.arange(len(at)))
        odd = other[self.differ(at[other], at[one[number[other]]], sizes[other]) | (sizes[other] != sizes[one[number[other]]])]
        if len(odd):
            # Digests that coincide by chance: such runs are told apart by their words themselves.
            known: dict[bytes, int] = {}
            for i, text in zip(odd.tolist(), self.texts_at(at[odd], sizes[odd]), strict=True):
                if text not in known:
                    known[text] = len(one)
                    one = np.append(one, i)
                number[i] = known[text]
        return one, number

    def texts_at(self, at: np.ndarray, sizes: np.ndarray | int) -> list[bytes]:
        """The bytes of the ``sizes`` words from each place."""
        return [self.data[a:b] for a, b in zip(self.starts[at].tolist(), self.ends[at + sizes - 1].tolist(), strict=True)]


class Block(Words):
    """The words of a block's documents."""

    def __init__(self, blobs: list[bytes], min_words: int) -> None:
        ids, texts, unpacked = [], [], zstandard.ZstdDecompressor()
        for blob in blobs:
            raw = unpacked.decompress(blob)
            n = int.from_bytes(raw[:8], "little")
            head = np.frombuffer(raw, np.int64, 3 * n, 8)
            ends = np.cumsum(head[2 * n :])
            ids.append(np.where(head[n : 2 * n] > 0, head[:n], _LAST_ID))
            body = raw[8 + 24 * n :]
            texts += [body[e - k : e] for e, k in zip(ends.tolist(), head[2 * n :].tolist(), strict=True)]
        whole = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        # In an order of their own, so that a place means the same whenever and from whichever rows' order the block is built.
        order = sorted(range(len(texts)), key=lambda i: (whole[i], texts[i]))
        self.ids, self.texts = whole[order], [texts[i] for i in order]
        texts = self.texts
        self.full = np.array([i for i, t in enumerate(texts) if t], np.int64)
        super().__init__([texts[i] for i in self.full], min_words)

    @property
    def anchor_words(self) -> int:
        return min(ANCHOR_WORDS, self.min_words)

    @property
    def anchor_windows(self) -> int:
        """Windows that an anchor may stand for."""
        return self.min_words - self.anchor_words + 1

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each window, the least hash of its runs of ``ANCHOR_WORDS`` words and the place of the first such run."""
        out, where, wide = np.zeros(len(self.at), np.uint64), np.zeros_like(self.at), self.anchor_windows
        for i in range(0, len(self.at), _PLACES):
            at = self.at[i : i + _PLACES]
            first = int(at[0])
            least = self.runs(self.anchor_words, np.arange(first, int(at[-1]) + wide))
            place, span = np.arange(first, first + len(least)).astype(at.dtype), 1
            while span < wide:
                step = min(span, wide - span)
                later = least[step:] < least[:-step]
                least, place = np.where(later, least[step:], least[:-step]), np.where(later, place[step:], place[:-step])
                span += step
            out[i : i + _PLACES], where[i : i + _PLACES] = least[at - first], place[at - first]
        return out, where

    def around(self, size: int, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Hashes of ``size`` words of windows: from the anchor's place to the window's end, then leftwards from the anchor."""
        out = np.zeros(len(at), np.uint64)
        for i in range(0, len(at), _PLACES):
            some, h = place[i : i + _PLACES], np.zeros(len(at[i : i + _PLACES]), np.uint64)
            right = at[i : i + _PLACES] + self.min_words - some
            for k in range(size):
                h = h * _STEP + self.words[np.where(k < right, some + k, some - 1 - (k - right))]
            out[i : i + _PLACES] = _mixed(h)
        return out

    def smallest(self, told: np.ndarray, by: np.ndarray) -> np.ndarray:
        """For each window the smallest id that holds its words: in this block, or by what is ``told`` (places, and their ids)."""
        digest, out = self.runs(self.min_words, self.at), np.full(len(self.at), _LAST_ID)
        slices = 1 + len(digest) // _PLACES
        share = (digest >> _U(33)) % _U(slices)
        told = np.searchsorted(self.at, told)
        for k in range(slices):
            own = np.flatnonzero(share == k)
            one, number = self.equals(digest[own], self.at[own], np.full(len(own), self.min_words))
            least = np.full(len(one), _LAST_ID)
            np.minimum.at(least, number, self.ids[self.full[self.doc[self.at[own]]]])
            here = share[told] == k
            np.minimum.at(least, number[np.searchsorted(own, told[here])], by[here])
            out[own] = least[number]
        return out


def _packed(docs: DataFrame, blocks: int) -> DataFrame:
    """``block, blob``: documents of a block, words joined by single spaces, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        held: dict[int, list[tuple[int, int, bytes]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for block, rows in held.items():
                head = np.array([[r[0] for r in rows], [r[1] for r in rows], [len(r[2]) for r in rows]], np.int64)
                blob = press.compress(len(rows).to_bytes(8, "little") + head.tobytes() + b"".join(r[2] for r in rows))
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "blob": pa.array([blob], pa.binary())})

        for batch in text_slices(batches, "text"):
            rows = zip(batch.column("block").to_pylist(), batch.column("id").to_pylist(), text_bytes(batch, "text"), strict=True)
            for block, key, text in rows:
                words = b" ".join(text.split())
                held.setdefault(block, []).append((key or 0, int(key is not None), words))
                size += len(words)
            if size > _PACK_BYTES:
                yield from out()
                held, size = {}, 0
        yield from out()

    rows = docs.select(F.col("id"), F.col("text"), F.pmod(F.xxhash64("id", F.octet_length("text")), F.lit(blocks)).cast("int").alias("block"))
    return rows.mapInArrow(pack, "block int, blob binary")


def _blobs(table: pa.Table) -> list[bytes]:
    return table.column("blob").to_pylist()


def _by(keys: np.ndarray, n: int) -> list[np.ndarray]:
    """Places of each key 0..n-1."""
    order = np.argsort(keys, kind="stable")
    return np.split(order, np.searchsorted(keys[order], np.arange(1, n)))


def _slots(h: np.ndarray) -> np.ndarray:
    return (h >> _U(64 - SLOT_BITS)).astype(np.int64)


def _census(block: Block, at: np.ndarray, place: np.ndarray, share: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per prefix length: hashed slots that at least ``share`` of the prefixes at the anchors fall into, and how many do. Beyond
    the anchor's words windows count (``at``, and ``place`` of their anchors), as many as an anchor may have for each."""
    out = []
    once = place[np.concatenate([[True], place[1:] != place[:-1]])] if len(place) else place
    least = max(2, math.ceil(share * len(once)))
    for size in range(1, block.min_words):
        if size == block.anchor_words + 1:
            own = np.isin(place, once)
            at, once, least = at[own], place[own], least * block.anchor_windows
        slot = _slots(block.around(size, at, once) if size > block.anchor_words else block.runs(size, once))
        counts = np.bincount(slot, minlength=1 << SLOT_BITS)
        heavy = counts >= least
        out.append((size, np.flatnonzero(heavy), counts[heavy]))
        more = heavy[slot]
        once = once[more]
        if size > block.anchor_words:
            at = at[more]
        if not len(once):
            break
    return out


def _survey(packed: DataFrame, buckets: int, share: float, min_words: int) -> DataFrame:
    """``block, data``: each block's shared anchors; under block -size the frequent slots of that prefix length."""

    def name(table: pa.Table) -> pa.Table:
        block = Block(_blobs(table), min_words)
        anchor, place = block.anchors()
        census = [np.stack([np.full(len(s), size), s, n]) for size, s, n in _census(block, block.at, place, share / 2)]
        change = np.concatenate([[True], place[1:] != place[:-1]]) if len(anchor) else np.zeros(0, bool)
        anchor, place = anchor[change], place[change]
        doc = block.doc[place]
        order = np.argsort(anchor, kind="stable")
        anchor, doc = anchor[order], doc[order]
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]])) if len(anchor) else np.zeros(0, np.int64)
        many = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        # The lowest bit tells that several documents of this block hold the anchor.
        value = anchor[first] & ~_U(1) | many.astype(np.uint64)
        parts = _by(((value >> _U(33)) % _U(buckets)).astype(np.int64), buckets)
        census = np.concatenate(census, axis=1) if census else np.zeros((3, 0), np.int64)
        dealt = _by(census[1] % buckets, buckets)
        return pa.table({
            "bucket": pa.array(range(buckets), pa.int32()), "block": pa.array([table.column("block")[0].as_py()] * buckets, pa.int32()), "n": pa.array([len(place)] * buckets, pa.int64()),
            "data": pa.array([value[p].tobytes() for p in parts], pa.binary()), "census": pa.array([census[:, p].tobytes() for p in dealt], pa.binary()),
        })

    def share_out(table: pa.Table) -> pa.Table:
        values = [np.frombuffer(x, np.uint64) for x in table.column("data").to_pylist()]
        blocks = table.column("block").to_numpy()
        of, value = np.repeat(np.arange(len(values)), [len(v) for v in values]), np.concatenate(values)
        key = value & ~_U(1)
        order = np.argsort(key, kind="stable")
        key, many, of = key[order], (value[order] & _U(1)) > 0, of[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(key)))
        kept = np.repeat((sizes > 1) | np.logical_or.reduceat(many, first), sizes) if len(first) else np.zeros(0, bool)
        parts = _by(of[kept], len(values))
        key = key[kept]
        out_block, out_data = blocks.tolist(), [key[p].tobytes() for p in parts]
        census = np.concatenate([np.frombuffer(x, np.int64).reshape(3, -1) for x in table.column("census").to_pylist()], axis=1)
        at, number = np.unique(census[:2], axis=1, return_inverse=True)
        total = np.bincount(number.ravel(), weights=census[2], minlength=at.shape[1])
        anchor_words = min(ANCHOR_WORDS, min_words)
        frequent = at[:, total >= share * sum(table.column("n").to_pylist()) * np.where(at[0] > anchor_words, min_words - anchor_words + 1, 1)]
        for size in np.unique(frequent[0]).tolist():
            out_block.append(-size)
            out_data.append(frequent[1][frequent[0] == size].tobytes())
        return pa.table({"block": pa.array(out_block, pa.int32()), "data": pa.array(out_data, pa.binary())})

    named = packed.groupBy("block").applyInArrow(name, "bucket int, block int, n long, data binary, census binary")
    return cut_lineage(named.groupBy("bucket").applyInArrow(share_out, "block int, data binary"))


def _suffixes(packed: DataFrame, shared: DataFrame, frequent: dict[int, np.ndarray], groups: int, min_words: int) -> DataFrame:
    """``part, block, data``: words around shared anchors, by the variable-length prefix there, once for each block."""

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: dict[str, list] = {"part": [], "block": [], "data": []}
        if left.num_rows:
            block = Block(_blobs(left), min_words)
            known = np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in right.column("data").to_pylist())]))
            anchor, place = block.anchors()
            anchor &= ~_U(1)
            near = np.searchsorted(known, anchor)
            near[near == len(known)] = 0
            kept = known[near] == anchor if len(known) else np.zeros(len(anchor), bool)
            at, place = block.at[kept], place[kept]
            # Windows of one anchor stand in a row: from the first window's start to the last one's end.
            first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.zeros(0, np.int64)
            windows = np.diff(np.append(first, len(at)))
            begin, place = at[first], place[first]
            ends = block.runs(min_words, begin) * _STEP + block.runs(min_words, begin + windows - 1)
            one, number = block.equals(_mixed(ends * _STEP + windows.astype(np.uint64)), begin, windows.astype(np.int64) + min_words - 1)
            least = np.full(len(one), _LAST_ID)
            np.minimum.at(least, number, block.ids[block.full[block.doc[begin]]])
            begin, place, windows = begin[one], place[one], windows[one]
            part, open_ = np.zeros(len(begin), np.int64), np.arange(len(begin))
            for size in range(1, block.anchor_words + 1):
                h = block.runs(size, place[open_])
                more = np.isin(_slots(h), frequent[size]) if size in frequent and size < min_words else np.zeros(len(h), bool)
                part[open_[~more]] = (h[~more] >> _U(11)) % _U(groups)
                open_ = open_[more]
                if not len(open_):
                    break
            if len(open_):
                # The anchor itself is frequent: its windows go one by one, each distinct one once.
                n = windows[open_]
                single = np.repeat(begin[open_], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(begin.dtype)
                anchored, holder = np.repeat(place[open_], n), np.repeat(least[open_], n)
                one, number = block.equals(block.runs(min_words, single), single, np.full(len(single), min_words))
                lowest = np.full(len(one), _LAST_ID)
                np.minimum.at(lowest, number, holder)
                single, anchored, own, left_ = single[one], anchored[one], np.zeros(len(one), np.int64), np.arange(len(one))
                for size in range(block.anchor_words + 1, min_words + 1):
                    h = block.around(size, single[left_], anchored[left_])
                    more = np.isin(_slots(h), frequent[size]) if size in frequent and size < min_words else np.zeros(len(h), bool)
                    own[left_[~more]] = (h[~more] >> _U(11)) % _U(groups)
                    left_ = left_[more]
                    if not len(left_):
                        break
                whole = np.setdiff1d(np.arange(len(begin)), open_)
                begin, part = np.concatenate([begin[whole], single]), np.concatenate([part[whole], own])
                windows, least = np.concatenate([windows[whole], np.ones(len(single), windows.dtype)]), np.concatenate([least[whole], lowest])
            press = zstandard.ZstdCompressor(3)
            for k, p in enumerate(_by(part, groups)):
                if len(p):
                    p = p[np.argsort(least[p], kind="stable")]
                    text = b"\n".join(block.texts_at(begin[p], windows[p] + min_words - 1))
                    rows["part"].append(k)
                    rows["block"].append(left.column("block")[0].as_py())
                    rows["data"].append(press.compress(len(p).to_bytes(8, "little") + np.diff(least[p], prepend=0).tobytes() + begin[p].astype(np.int64).tobytes() + text))
        return pa.table({"part": pa.array(rows["part"], pa.int32()), "block": pa.array(rows["block"], pa.int32()), "data": pa.array(rows["data"], pa.binary())})

    return packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send, "part int, block int, data binary")


def _deep_nodes(suffixes: list[bytes]) -> Iterator[list[int]]:
    """Leaves below each node of full depth that has several: runs of equals among the sorted suffixes."""
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    for _, leaves in groupby(order, key=suffixes.__getitem__):
        below = list(leaves)
        if len(below) > 1:
            yield below


def _repeats(sent: DataFrame, min_words: int) -> DataFrame:
    """``block, data``: places of repeats in blocks and their smallest document, for blocks that do not hold it."""

    def grow(table: pa.Table) -> pa.Table:
        unpack, texts, ids, of, begin = zstandard.ZstdDecompressor(), [], [], [], []
        blocks = table.column("block").to_pylist()
        for k, packed in enumerate(table.column("data").to_pylist()):
            raw = unpack.decompress(packed)
            n = int.from_bytes(raw[:8], "little")
            ids.append(np.cumsum(np.frombuffer(raw, np.int64, n, 8)))
            begin.append(np.frombuffer(raw, np.int64, n, 8 + 8 * n))
            texts += raw[8 + 16 * n :].split(b"\n")
            of.append(np.full(n, k))
        words = Words(texts, min_words)
        text_of = words.doc[words.at]
        doc, of = np.concatenate(ids)[text_of], np.concatenate(of)[text_of]
        first = np.flatnonzero(np.concatenate([[True], words.doc[1:] != words.doc[:-1]])) if len(words.doc) else np.zeros(0, np.int64)
        place = np.concatenate(begin)[text_of] + words.at - first[text_of]
        ids = doc.tolist()
        told, least = [], []
        for below in _deep_nodes(words.texts_at(words.at, min_words)):
            smallest = min([ids[i] for i in below])
            more = [i for i in below if ids[i] > smallest]
            told += more
            least += [smallest] * len(more)
        told, least = np.array(told, np.int64), np.array(least, np.int64)
        place, of = place[told], of[told]
        order = np.argsort(of, kind="stable")
        place, least, of = place[order], least[order], of[order]
        parts = np.split(np.arange(len(of)), np.searchsorted(of, np.arange(1, len(blocks))))
        data = [place[p].tobytes() + least[p].tobytes() for p in parts]
        return pa.table({"block": pa.array(blocks, pa.int32()), "data": pa.array(data, pa.binary())})

    return sent.groupBy("part").applyInArrow(grow, "block int, data binary")


def _removed(packed: DataFrame, repeats: DataFrame, min_words: int) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        block = Block(_blobs(left), min_words)
        replies = [(raw, len(raw) // 16) for raw in right.column("data").to_pylist()]
        told = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(raw, np.int64, n) for raw, n in replies)])
        by = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(raw, np.int64, n, 8 * n) for raw, n in replies)])
        starts = block.at[block.smallest(told, by) < block.ids[block.full[block.doc[block.at]]]]
        step = np.zeros(len(block.words) + 1, np.int32)
        np.add.at(step, starts, 1)
        np.add.at(step, starts + min_words, -1)
        covered = np.cumsum(step)[:-1] > 0
        n_words = np.zeros(len(block.texts), np.int64)
        n_words[block.full] = np.bincount(block.doc, minlength=len(block.full))
        n_removed = np.zeros(len(block.texts), np.int64)
        n_removed[block.full] = np.bincount(block.doc[covered], minlength=len(block.full)) if covered.any() else 0
        kept, spans, first = list(block.texts), [[]] * len(block.texts), np.cumsum(n_words) - n_words
        for i in np.flatnonzero(n_removed).tolist():
            mask = covered[first[i] : first[i] + n_words[i]]
            kept[i] = b" ".join(compress(kept[i].split(b" "), (~mask).tolist()))
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
            spans[i] = [{"start": a, "length": b - a} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)]
        ids = pa.array(block.ids, mask=block.ids == _LAST_ID)
        return pa.table([ids, pa.array(n_words), pa.array(n_removed), pa.array(kept, pa.binary()).view(pa.string()), pa.array(spans, schema.field("spans").type)], schema=schema)

    return packed.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(remove, "id long, n_words long, n_removed long, kept string, spans array<struct<start:long,length:long>>")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, n_removed, kept, spans``.

    A word goes when a window of ``min_words`` words of its document covers it whose words also start in a document with a
    smaller id. ``kept`` joins the other words by single spaces, ``spans`` lists the runs of removed words. A null or empty
    text has no words. Rows with the same id are no smaller than each other, so rows repeated with one id stay whole (ties
    remove nothing); null ids come after all others. A very long text is read whole: it lies in one block, whose words that
    block's task holds, and its suffixes travel like any others. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # As many blocks and groups as keep each within a task's memory, and no fewer than the session's partitions.
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = max(shuffle_partitions(docs.sparkSession), math.ceil(size / BLOCK_BYTES))
    share = 1 / min(MOST_PREFIXES, GROUP_SHARE * parts)
    packed = _packed(rows, parts)
    survey = _survey(packed, parts, share, min_words)
    # About 1 / share slots for each prefix length, 65,536 whatever the input: a bounded list for the tasks.
    frequent: dict[int, np.ndarray] = {}
    for row in survey.filter("block < 0").collect():
        frequent[-row["block"]] = np.concatenate([frequent.get(-row["block"], np.zeros(0, np.int64)), np.frombuffer(row["data"], np.int64)])
    sent = _suffixes(packed, survey.filter("block >= 0"), frequent, parts, min_words)
    return _removed(packed, _repeats(sent, min_words), min_words).withColumnRenamed("id", id_col)
