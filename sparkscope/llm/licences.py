"""License scan: fixed phrases, and an exact set-similarity join of text blocks with license templates.

Template tokens are ordered by their frequency in the whole corpus, rarest first. A block that contains a share ``t`` of a
template's tokens must hold one of the template's first ``n - ceil(t n) + 1`` tokens (prefix), at least ``ceil(t n)`` tokens
(length), and its first common token must leave enough of the template behind it (position). What is left is compared exactly.
Templates are whole license texts cut into pieces and short notices. Variants differ by a token or two, far less than the
threshold: a piece counts only with the tokens that tell it from the others.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, text_slices

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Public notices and license texts, by label. Longer texts are cut into pieces that fit into half a block.
TEMPLATES = {
    "gpl-3": "this work is licensed under the gnu general public license version 3",
    "apache-2.0": "licensed under the apache license version 2 0",
    "cc-by-4.0": "licensed under cc by 4 0",
    "cc-by-sa-4.0": "licensed under cc by sa 4 0",
    "cc-by-nc-4.0": "licensed under cc by nc 4 0",
    "cc-by-nd-4.0": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-4.0": "licensed under cc by nc sa 4 0",
    "cc-by-nc-nd-4.0": "licensed under cc by nc nd 4 0",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "all-rights": "all rights reserved no part of this publication may be reproduced",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
}
#: Containment that a block must reach.
THRESHOLD = 0.8
#: Blocks have so many words and start every half of that, so that each passage of half a block lies within one.
BLOCK_WORDS = 64

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Piece:
    """A passage of a template as a set of tokens. ``needed`` are those that tell it from blocks of other labels' texts which
    alone would meet its threshold; ``within`` are the pieces that hold all of its tokens and more: where one of these is found, this
    one says less and gives no label."""

    label: str
    tokens: frozenset[str]
    needed: frozenset[str]
    within: frozenset[int]


def pieces(templates: dict[str, str], threshold: float) -> list[Piece]:
    """Templates cut evenly into passages of at most half a block; a passage that another label shares as a whole is left out,
    as it tells neither of them."""
    cut = []
    for label, text in templates.items():
        words = text.split()
        n = max(1, math.ceil(len(words) / (BLOCK_WORDS // 2)))
        cut += [(label, frozenset(words[len(words) * i // n : len(words) * (i + 1) // n])) for i in range(n)]
    cut = [(label, own) for label, own in cut if own and not any(own == other and label != name for name, other in cut)]
    words = {label: text.split() for label, text in templates.items()}
    windows = {label: [frozenset(w[i : i + BLOCK_WORDS]) for i in range(max(1, len(w) - BLOCK_WORDS + 1))] for label, w in words.items()}
    found = []
    for label, own in cut:
        rivals = [window for name, all_ in windows.items() if name != label for window in all_ if len(own & window) >= threshold * len(own) - 1e-9]
        within = frozenset(i for i, (_, other) in enumerate(cut) if own < other)
        found.append(Piece(label, own, frozenset().union(*(own - rival for rival in rivals)), within))
    return found


def folded_words(text: bytes) -> list[bytes]:
    """Words of letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.translate(_FOLD).split()


def _phrase_places(words: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """Each place's first word and label, in order; the blanks before a place are counted once for all places of a text."""
    joined = b" " + b" ".join(words) + b" "
    found, labels = [], []
    for phrase, label in phrases.items():
        at = joined.find(phrase)
        while at >= 0:
            found.append(at)
            labels.append(label)
            at = joined.find(phrase, at + 1)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32) if found else ()
    return sorted(zip(np.searchsorted(blanks, found).tolist(), labels, strict=True))


def token_frequencies(docs: DataFrame, tokens: set[bytes]) -> dict[str, int]:
    """How often each of the template tokens occurs in the whole corpus; the driver gets one row per token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in text_slices(batches, "text"):
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                seen.update(filter(tokens.__contains__, folded_words(text or b"")))
        yield pa.RecordBatch.from_pydict({"token": pa.array([k.decode() for k in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


_SCANNED = "id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<block:int,tokens:array<string>>>"


def scan_licences(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    ``blocks`` lists every piece of a template that some block contains to at least ``threshold`` with all tokens that tell it
    from other labels, as ``(block, label, containment)``. ``labels`` adds to the phrases' labels those of these pieces, but
    for a piece whose tokens another piece found in the block has all of; ``score`` is the best containment of such a piece, 0
    where there is none. Null and empty texts have no words, null first and last word, empty labels. A null id is allowed. A
    very long text is cut into blocks like any other, its words held by one task. Repeated rows are scanned each for itself.
    Of pieces with equal containment all give their labels. An empty table gives an empty result. Other columns are ignored,
    whatever their names.
    """
    spark = docs.sparkSession
    wanted = {f" {k} ".encode(): v for k, v in (PHRASES if phrases is None else phrases).items()}
    known = pieces(TEMPLATES if templates is None else templates, threshold)
    vocabulary = {t.encode() for p in known for t in p.tokens}
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    often = token_frequencies(rows, vocabulary)
    order = [sorted(p.tokens, key=lambda t: (often.get(t, 0), t)) for p in known]
    least = [math.ceil(threshold * len(s) - 1e-9) for s in order]
    prefixes = [s[: len(s) - n + 1] for s, n in zip(order, least, strict=True)]
    prefix = {t.encode() for s in prefixes for t in s}
    half = BLOCK_WORDS // 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
                            ("blocks", pa.list_(pa.struct([("block", pa.int32()), ("tokens", pa.list_(pa.string()))])))])
        for batch in text_slices(batches, "text"):
            out = []
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                words = folded_words(text or b"")
                hit = not prefix.isdisjoint(words)
                places = _phrase_places(words, wanted) if words else []
                starts = {b for i, w in enumerate(words) if w in prefix for b in (i // half - 1, i // half) if b >= 0} if hit else ()
                blocks = [{"block": b, "tokens": sorted(t.decode() for t in vocabulary.intersection(words[b * half : b * half + BLOCK_WORDS]))} for b in sorted(starts)]
                out.append({"id": key, "n_words": len(words), "n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None, "base_labels": sorted({x for _, x in places}), "blocks": blocks})
            yield pa.RecordBatch.from_pylist(out, schema)

    scanned = cut_lineage(rows.mapInArrow(scan, _SCANNED).withColumn("row", F.monotonically_increasing_id()))
    # The index has a row for each prefix token of each piece: bounded by the templates given.
    index = spark.createDataFrame([(t, k, p.label, i, len(p.tokens), least[k], order[k], sorted(p.needed), sorted(p.within)) for k, p in enumerate(known) for i, t in enumerate(prefixes[k])],
                                  "token string, piece int, label string, position int, size int, least int, template array<string>, needed array<string>, within array<int>")
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.block", "b.tokens").filter(F.size("tokens") >= min(least, default=1))
    probed = blocks.withColumn("token", F.explode("tokens")).join(F.broadcast(index), "token")
    candidates = probed.filter((F.size("tokens") >= F.col("least")) & (F.col("size") - F.col("position") >= F.col("least")))
    # A block meets a piece in several prefix tokens: only the first common one counts, which drops the repeats.
    first = F.array_min(F.transform(F.array_intersect("template", "tokens"), lambda t: F.array_position(F.col("template"), t))) - 1
    exact = candidates.filter(F.col("position") == first).withColumn("common", F.size(F.array_intersect("template", "tokens"))).filter(F.col("common") >= F.col("least"))
    exact = exact.filter(F.size(F.array_except("needed", "tokens")) == 0)
    told = exact.groupBy("row", "block").agg(F.collect_list(F.struct("piece", "label", (F.col("common") / F.col("size")).alias("containment"), "within")).alias("m"))
    most = F.filter("m", lambda x: ~F.arrays_overlap(x["within"], F.transform("m", lambda y: y["piece"])))
    per_block = told.select("row", F.transform("m", lambda x: F.struct(F.col("block"), x["label"].alias("label"), x["containment"].alias("containment"))).alias("listed"), most.alias("kept"))
    found = per_block.groupBy("row").agg(
        F.array_distinct(F.flatten(F.collect_list(F.transform("kept", lambda x: x["label"])))).alias("found"), F.max(F.array_max(F.transform("kept", lambda x: x["containment"]))).alias("best"), F.sort_array(F.flatten(F.collect_list("listed"))).alias("matches"))
    none = F.array().cast("array<string>")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("found", none)))
    return scanned.drop("blocks").join(found, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"), F.coalesce("matches", F.array().cast("array<struct<block:int,label:string,containment:double>>")).alias("blocks"))
