"""Ingest envelopes: decompression (A5), splitting and validation (A1, A2), routing of items (A3, A4), OTLP chunks."""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql_text import once

#: Item types that are accepted and not stored, and names of housekeeping transactions.
IGNORED_TYPES = ("session", "sessions", "client_report", "statsd", "metric_buckets", "replay_event", "replay_recording", "profile", "profile_chunk")
HOUSEKEEPING = ("SolidCable::", "ActiveStorage::")
CHUNK_BYTES = 1_000_000
#: Rows whose values a Python worker holds at once.
SLICE_ROWS = 32
_ITEM = "item_index: int, item_type: string, item_headers: string, payload: string, envelope_headers: string, error: string"


class InvalidEnvelope(ValueError):
    """The whole envelope is dropped."""


def split_envelope(body: str) -> tuple[dict, list[tuple[dict, str]]]:
    """Headers and ``(item headers, payload)``: a payload has its declared byte length, else it ends with its line."""
    raw = body.encode("utf-8", "surrogatepass")
    if not raw.strip():
        raise InvalidEnvelope("empty body")
    first, _, rest = raw.partition(b"\n")
    headers, items, at = _header(first), [], 0
    while at < len(rest):
        end = rest.find(b"\n", at)
        line = rest[at : end if end >= 0 else len(rest)]
        at = (end if end >= 0 else len(rest)) + 1
        if not line.strip():
            continue
        head = _header(line)
        length = head.get("length")
        if length is None:
            end = rest.find(b"\n", at)
            end = end if end >= 0 else len(rest)
        elif isinstance(length, int) and not isinstance(length, bool) and length > 0:
            end = min(at + length, len(rest))
        else:
            raise InvalidEnvelope(f"invalid length: {length}")
        items.append((head, rest[at:end].decode("utf-8", "replace")))
        at = end + 1
    return headers, items


def _header(line: bytes) -> dict:
    try:
        found = json.loads(line)
    except ValueError as error:
        raise InvalidEnvelope(f"header is no JSON: {error}") from None
    if not isinstance(found, dict):
        raise InvalidEnvelope("header is no object")
    return found


def validated(headers: dict, items: list[tuple[dict, str]]) -> list[tuple[dict, str]]:
    if headers.get("sent_at"):
        try:
            datetime.fromisoformat(str(headers["sent_at"]).replace("Z", "+00:00"))
        except ValueError:
            raise InvalidEnvelope(f"invalid sent_at: {headers['sent_at']}") from None
    if not items:
        raise InvalidEnvelope("no items")
    for i, (head, payload) in enumerate(items):
        if not head.get("type"):
            raise InvalidEnvelope(f"item {i} has no type")
        if not payload.strip():
            raise InvalidEnvelope(f"item {i} has no payload")
    return items


class ParseEnvelope:
    """One row for each item of an envelope, or a single row with the error that rejects it."""

    def eval(self, body: str) -> Iterator[tuple]:
        try:
            headers, items = split_envelope(body or "")
            items = validated(headers, items)
        except InvalidEnvelope as error:
            yield None, None, None, None, None, str(error)
            return
        for i, (head, payload) in enumerate(items):
            yield i, str(head["type"]), json.dumps(head), payload, json.dumps(headers), None


def parse_envelopes(envelopes: DataFrame, body: str = "body") -> DataFrame:
    """Other columns of ``envelopes`` with one row per item; rows with an ``error`` are for quarantine."""
    # Made here, as workers that import this module have no session.
    parse = F.udtf(ParseEnvelope, returnType=_ITEM)
    return envelopes.lateralJoin(parse(F.col(body).outer())).drop(body)


def decompress(bodies: Column) -> Column:
    """Text of a body that is plain, gzip, zlib or zstd, by its first bytes; null where it can't be read."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            if raw[:2] == b"\x1f\x8b":
                raw = gzip.decompress(raw)
            elif raw[:4] == b"\x28\xb5\x2f\xfd":
                import zstandard

                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            elif raw[:1] == b"\x78" and int.from_bytes(raw[:2], "big") % 31 == 0:
                raw = zlib.decompress(raw)
            return raw.decode("utf-8")
        except (OSError, EOFError, ValueError, zlib.error):
            return None

    return by_slices(one, pa.binary(), pa.string())(bodies)


def by_slices(one: Callable, *types: pa.DataType) -> Callable[..., Column]:
    """A column function of a row's values, with the result's type last: a batch is taken some rows at a time, so that values
    are Python objects for these alone."""

    def each(*columns: pa.Array) -> pa.Array:
        columns = [c.cast(t) for c, t in zip(columns, types, strict=False)]
        slices = (zip(*(c.slice(at, SLICE_ROWS).to_pylist() for c in columns), strict=True) for at in range(0, len(columns[0]), SLICE_ROWS))
        return pa.concat_arrays([pa.array([one(*values) for values in rows], types[-1]) for rows in slices] or [pa.array([], types[-1])])

    return lambda *columns: F.arrow_udf(each, {pa.string(): "string", pa.binary(): "binary"}[types[-1]], F.ArrowUDFType.SCALAR)(*columns)


def route(items: DataFrame, store_events: bool = True, store_transactions: bool = True, store_logs: bool = False) -> DataFrame:
    """A3, A4: each item's ``sink`` (events, transactions, logs, check_ins, dropped) and ``event_id``.

    The id is the payload's, else the envelope's; events and transactions without one are dropped.
    """
    kind = F.col("item_type")

    def routed(data: Column) -> Column:
        text = lambda path: F.try_variant_get(data, path, "string")
        own = F.coalesce(text("$.event_id"), F.get_json_object("envelope_headers", "$.event_id"))
        housekeeping = once(F.coalesce(text("$.transaction"), F.lit("")), lambda name: F.greatest(*[name.startswith(p) for p in HOUSEKEEPING]))
        sink = (
            F.when(F.col("error").isNotNull(), "dropped")
            .when(kind.isin("log", "otel_log"), F.lit("logs" if store_logs else "dropped"))
            .when(kind == "check_in", F.when(F.trim(text("$.monitor_slug")) != "", "check_ins").otherwise("dropped"))
            .when(kind.isin(*IGNORED_TYPES) | own.isNull(), "dropped")
            .when(kind == "event", F.lit("events" if store_events else "dropped"))
            .when((kind == "transaction") & ~housekeeping, F.lit("transactions" if store_transactions else "dropped"))
            .otherwise("dropped")
        )
        return F.struct(own.alias("event_id"), sink.alias("sink"))

    # A payload is parsed once for its id and its sink.
    told = items.withColumn("_told", once(F.try_parse_json("payload"), routed))
    return told.withColumn("event_id", F.col("_told.event_id")).withColumn("sink", F.col("_told.sink")).drop("_told")


def otlp_chunks(payload: dict, limit: int = CHUNK_BYTES) -> Iterator[dict]:
    """A payload in pieces of at most ``limit`` bytes of records, each in its resource and scope; a larger record alone."""
    for resource in payload.get("resourceLogs") or []:
        for scope in resource.get("scopeLogs") or []:
            held, size = [], 0
            wrap = lambda records: {"resourceLogs": [{**resource, "scopeLogs": [{**scope, "logRecords": records}]}]}  # noqa: B023, E731
            for record in scope.get("logRecords") or []:
                n = len(json.dumps(record).encode())
                if held and size + n > limit:
                    yield wrap(held)
                    held, size = [], 0
                held.append(record)
                size += n
            if held:
                yield wrap(held)


class ChunkOtlp:
    """One row for each piece of a payload: its place, text, records, and whether a record alone exceeds the limit."""

    def eval(self, payload: str, limit: int) -> Iterator[tuple]:
        try:
            parsed = json.loads(payload or "")
        except ValueError:
            return
        if not isinstance(parsed, dict):
            return
        for i, chunk in enumerate(otlp_chunks(parsed, limit)):
            records = chunk["resourceLogs"][0]["scopeLogs"][0]["logRecords"]
            yield i, json.dumps(chunk), len(records), len(records) == 1 and len(json.dumps(records[0]).encode()) > limit


def otlp_chunk_rows(items: DataFrame, limit: int = CHUNK_BYTES) -> DataFrame:
    """Items (``payload``) with ``chunk_index, payload, record_count, rejected`` for each piece; what is no JSON gives
    none. A record beyond the limit is a piece of its own and rejected."""
    chunk = F.udtf(ChunkOtlp, returnType="chunk_index: int, chunk: string, record_count: int, rejected: boolean")
    return items.lateralJoin(chunk(F.col("payload").outer(), F.lit(limit))).withColumn("payload", F.col("chunk")).drop("chunk")
