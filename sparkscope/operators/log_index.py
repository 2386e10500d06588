"""An inverted index for log search (D2, I10, C9): postings by token, with positions, in folders by the token's hash.

A search reads the folders of its tokens alone, and there the row groups that hold them, as files are sorted by token. The rarest
token's postings come first; those of a phrase's others are joined to them by log and column and their positions intersected. The
logs themselves are read for what is found only. ``search_logs`` scans and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.log_text import fts_phrases, fts_text
from ..plans.window import TimeWindow
from .filters import inclusive
from .log_search import LogFilter, search_logs

BUCKETS = 64
#: Postings up to which the rarest token's are broadcast.
SMALL = 100_000
FIELDS = ("body", "attrs_text")
#: Texts whose tokens a Python worker holds at once.
SLICE_ROWS = 32
_PLACES = pa.list_(pa.int32())


def _bucket(token: str | None = None):
    return F.pmod(F.xxhash64("token" if token is None else F.lit(token)), F.lit(BUCKETS)).cast("int")


def _placed(texts: DataFrame) -> DataFrame:
    """``bucket, id, timestamp, field, tokens, starts, positions`` of normal texts: one row for what a text has in a bucket, its
    tokens between blanks, the places of all of them, and where among these each token's start, the end being the last start.

    A text's tokens are grouped where the text is, as no other row has any of them.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                at, buckets, tokens, starts, positions = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    places: dict[str, list[int]] = {}
                    for position, token in enumerate(text.split(" ")):
                        places.setdefault(token, []).append(position)
                    own: dict[int, list[str]] = {}
                    for token in places:
                        own.setdefault(xxhash.xxh64_intdigest(token.encode(), 42) % BUCKETS, []).append(token)
                    at += [i] * len(own)
                    buckets += own
                    for held in own.values():
                        tokens.append(" ".join(held))
                        starts.append(list(accumulate((len(places[t]) for t in held), initial=1)))
                        positions.append([p for t in held for p in places[t]])
                kept = part.select(["id", "timestamp", "field"]).take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *kept.columns, pa.array(tokens, pa.string()), pa.array(starts, _PLACES), pa.array(positions, _PLACES)], names=["bucket", "id", "timestamp", "field", "tokens", "starts", "positions"])

    kept = ", ".join(f"{name} {texts.schema[name].dataType.simpleString()}" for name in ("id", "timestamp", "field"))
    return texts.mapInArrow(place, f"bucket int, {kept}, tokens string, starts array<int>, positions array<int>")


def postings(logs: DataFrame) -> DataFrame:
    """``bucket, id, timestamp, field, tokens, starts, positions`` of logs with ``id, timestamp`` and any of the searched columns."""
    fields = F.array(*[F.struct(F.lit(i).alias("field"), F.trim(fts_text(F.col(c))).alias("text")) for i, c in enumerate(FIELDS) if c in logs.columns])
    texts = logs.select("id", "timestamp", F.explode(fields).alias("f")).select("id", "timestamp", "f.field", F.col("f.text").alias("text")).filter("text != ''")
    return _placed(texts)


def write(logs: DataFrame, path: str, mode: str = "append") -> None:
    """Add logs to the index at ``path``; files of a bucket are sorted by token, and those of a frequent token are several.

    What moves is a row for each text and bucket; these become rows of tokens where they are written.
    """
    start = lambda i: F.get("starts", i)
    each = F.transform(F.split("tokens", " "), lambda t, i: F.struct(t.alias("token"), F.slice("positions", start(i), start(i + 1) - start(i)).alias("positions")))
    rows = postings(logs).hint("rebalance", "bucket").select("bucket", "id", "timestamp", "field", F.inline(each)).select("token", "id", "timestamp", "field", "positions", "bucket")
    rows.sortWithinPartitions("bucket", "token", "id").write.mode(mode).partitionBy("bucket").option("parquet.block.size", 8 << 20).parquet(path)


def _of(spark: SparkSession, path: str, tokens: list[str]) -> DataFrame:
    """The postings of some tokens: their folders, then the row groups that may hold them."""
    buckets = [r[0] for r in spark.range(1).select(F.explode(F.array(*[_bucket(t) for t in tokens]))).collect()]
    return spark.read.parquet(path).filter(F.col("bucket").isin(sorted(set(buckets))) & F.col("token").isin(tokens)).drop("bucket")


def _starts(rows: DataFrame, token: str, offsets: list[int], name: str) -> DataFrame:
    """Where a phrase would begin for one of its tokens to stand where it does, at all of its places in the phrase."""
    begun = lambda offset: F.transform("positions", lambda p: p - offset)
    starts = begun(offsets[0])
    for offset in offsets[1:]:
        starts = F.array_intersect(starts, begun(offset))
    return rows.filter(F.col("token") == token).select("id", "timestamp", "field", starts.alias(name)).filter(F.size(name) > 0)


def _with_phrase(rows: DataFrame, phrase: str, sizes: dict[str, int]) -> DataFrame:
    """Logs (``id, timestamp``) that hold a phrase within one column."""
    places: dict[str, list[int]] = {}
    for i, token in enumerate(phrase.split()):
        places.setdefault(token, []).append(i)
    rarest, *others = sorted(places, key=lambda t: (sizes.get(t, 0), t))
    found = _starts(rows, rarest, places[rarest], "starts")
    for token in others:
        more = _starts(rows, token, places[token], "more").drop("timestamp")
        held = F.broadcast(found) if sizes.get(rarest, 0) <= SMALL else found
        found = held.join(more, ["id", "field"]).withColumn("starts", F.array_intersect("starts", "more")).filter(F.size("starts") > 0).drop("more")
    return found.select("id", "timestamp").dropDuplicates(["id"])


def find(spark: SparkSession, path: str, query: str, window: TimeWindow | None = None) -> DataFrame | None:
    """``id, timestamp`` of the logs that hold every phrase of a query, within a window; None where no term is usable."""
    phrases = sorted(set(fts_phrases(query)))
    if not phrases:
        return None
    rows = _of(spark, path, sorted({t for p in phrases for t in p.split()}))
    rows = rows if window is None else rows.filter(inclusive(window))
    sizes = {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.count("*").alias("n")).collect()}  # a row for each token asked for
    order = sorted(phrases, key=lambda p: (min(sizes.get(t, 0) for t in p.split()), p))
    found = _with_phrase(rows, order[0], sizes)
    for phrase in order[1:]:
        found = found.join(_with_phrase(rows, phrase, sizes).select("id"), "id", "left_semi")
    return found


def search(logs: DataFrame, path: str, query: str | None = None, window: TimeWindow | None = None, wanted: LogFilter = LogFilter(), limit: int = 50) -> DataFrame:
    """What ``search_logs`` gives, by the index; logs are told apart by ``id``."""
    spark, limit = logs.sparkSession, max(1, min(limit, 200))
    found = find(spark, path, query or "", window)
    if found is None:
        return search_logs(logs, None, window, wanted, limit)
    if wanted == LogFilter():
        # The index knows the order: at most two hundred ids are left to fetch.
        found = F.broadcast(found.orderBy(F.desc("timestamp"), F.desc("id")).limit(limit))
    rows = wanted.apply(logs if window is None else logs.filter(inclusive(window)))
    return rows.join(found.select("id"), "id", "left_semi").orderBy(F.desc("timestamp"), F.desc("id")).limit(limit)


def read_bytes(spark: SparkSession, path: str, query: str) -> tuple[int, int]:
    """Bytes of the folders that a query's tokens lie in, and of the whole index."""
    jvm, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.Path(path)
    files = at.getFileSystem(conf)
    tokens = sorted({t for p in fts_phrases(query) for t in p.split()})
    asked = {r[0] for r in spark.range(1).select(F.explode(F.array(*[_bucket(t) for t in tokens]))).collect()} if tokens else set()
    sizes = {x.getPath().getName(): files.getContentSummary(x.getPath()).getLength() for x in files.listStatus(at) if x.isDirectory()}
    return sum(n for name, n in sizes.items() if name.removeprefix("bucket=") in {str(b) for b in asked}), sum(sizes.values())
