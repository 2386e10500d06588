"""Legacy archive converter: ARC files of version 1 and 2 to WARC 1.1, and a reader of the result.

An ARC file opens with a version block whose last line names the fields of every record header; records are then cut by
their declared lengths, never by a search for the next header. The converter makes what ARC lacks: record identifiers,
ISO timestamps, record types and payload digests. Equal payloads are stored once: the record with the largest key is the
response, the others are revisits that refer to it and hold only its HTTP head.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_folder, cut_lineage, text_slices

#: The header fields of the two versions of the ARC format, in order.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
ARC_BYTES = 4 << 20
#: Uncompressed bytes of a WARC file; a longer record has a file of its own.
WARC_BYTES = 32 << 20
#: Bytes that a reader inflates or gives out at once, and compressed ones that it takes for it.
_CHUNK, _FED = 1 << 20, 1 << 16
_KEY = re.compile(rb"(?im)^X-Record-Key: (-?\d+)\r?$")
_LENGTH = re.compile(rb"(?im)^Content-Length: (\d+)\r?$")
_UNSAFE = re.compile(r"[\x00-\x20\x7F]")


def _arc_start(name: str, version: int, date: str) -> bytes:
    body = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body)}\n".encode() + body


def _arc_record(version: int, name: str, offset: int, url: str, date: str, block: bytes) -> bytes:
    extra = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"\n{url} 0.0.0.0 {date} text/html{extra} {len(block)}\n".encode() + block


def pages_to_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "20240101000000") -> DataFrame:
    """ARC files of about 4 MB as rows ``archive, content``, of either version in turn; a null page is an empty payload."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in text_slices(batches, "html", ARC_BYTES):
            version = 1 + (part + made) % 2
            name = f"pages-{part:06d}-{made:06d}.arc"
            made += 1
            parts = [_arc_start(name, version, date)]
            offset = len(parts[0])
            for key, url, html in zip(batch.column("id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").cast(pa.binary()).to_pylist(), strict=True):
                payload = html or b""
                mark = "" if key is None else f"X-Record-Key: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mark}Content-Length: {len(payload)}\r\n\r\n".encode()
                safe = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "about:blank"
                parts.append(_arc_record(version, name, offset, safe, date, head + payload))
                offset += len(parts[-1])
            yield pa.RecordBatch.from_pydict({"archive": [name], "content": pa.array([b"".join(parts)], pa.binary())})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(write, "archive string, content binary")


def arc_records(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """``(version, offset, fields, block)`` of each record, cut by the declared lengths; a short last block is an error."""
    fields, version, at = ARC_FIELDS[1].split(), 1, 0
    while at < len(content):
        if content[at : at + 1] == b"\n":
            at += 1
            continue
        end = content.index(b"\n", at)
        line = content[at:end].decode("utf-8")
        first = line.startswith("filedesc://")
        # The version block's own header has its version's fields, which only its body names: the length comes last in both.
        length = int(line.rsplit(" ", 1)[1])
        block = content[end + 1 : end + 1 + length]
        if len(block) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are left")
        if first:
            about = block.decode("utf-8").split("\n")
            version, fields = int(about[0].split(" ")[0]), about[1].split(" ")
        else:
            values = line.rsplit(" ", len(fields) - 1)
            if len(values) != len(fields):
                raise ValueError(f"record at {at} has {len(values)} of {len(fields)} fields")
            yield version, at, dict(zip(fields, values, strict=True)), block
        at = end + 1 + length


def record_uuid(key: int, name: str) -> str:
    """A UUID of version 8 that holds the key in its last 64 free bits, so that identifiers can be read back as keys."""
    bits = key & (2**64 - 1)
    high = int.from_bytes(hashlib.sha1(name.encode()).digest()[:7], "big")
    value = (high >> 8 << 80) | (8 << 76) | ((high & 0xFF) << 66) | (bits >> 62 << 64) | (2 << 62) | (bits & (2**62 - 1))
    return str(uuid.UUID(int=value))


def uuid_key(text: str) -> int:
    value = uuid.UUID(text.removeprefix("<urn:uuid:").removesuffix(">")).int
    bits = ((value >> 64 & 3) << 62) | (value & (2**62 - 1))
    return bits - 2**64 if bits >> 63 else bits


def _split_http(block: bytes) -> tuple[bytes, bytes]:
    head, mark, payload = block.partition(b"\r\n\r\n")
    return (head + mark, payload) if mark else (b"", block)


_PARSED = "key long, record_id string, url string, ip string, warc_date string, digest string, payload_bytes long, head string, payload string"


def _parse_archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, content in zip(batch.column("archive").to_pylist(), batch.column("content").to_pylist(), strict=True):
            rows: dict[str, list] = {k.split()[0]: [] for k in _PARSED.split(", ")}
            for _, at, fields, block in arc_records(content):
                head, payload = _split_http(block)
                found = _KEY.search(head)
                key = int(found[1]) if found else None
                d = fields["Archive-date"].ljust(14, "0")
                own = key if key is not None else int.from_bytes(hashlib.sha1(f"{name}:{at}".encode()).digest()[:8], "big")
                values = (key, f"<urn:uuid:{record_uuid(own, fields['URL'])}>", fields["URL"], fields["IP-address"], f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload), head, payload)
                for column, value in zip(rows.values(), values, strict=True):
                    column.append(value)
            # HTTP heads and pages are text here; their bytes pass through unchanged.
            for k in ("head", "payload"):
                rows[k] = pa.array(rows[k], pa.binary()).view(pa.string())
            for k in ("key", "payload_bytes"):
                rows[k] = pa.array(rows[k], pa.int64())
            for k in ("record_id", "url", "ip", "warc_date", "digest"):
                rows[k] = pa.array(rows[k], pa.string())
            yield pa.RecordBatch.from_pydict(rows)


def _warc_files(file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records to whole files of at most ``file_bytes`` uncompressed, or one longer record, a gzip member for each record."""

    def archive(members: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary()).view(pa.string())], names=["value"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for record in batch.column("value").cast(pa.binary()).to_pylist():
                if held and size + len(record) > file_bytes:
                    yield archive(held)
                    held, size = [], 0
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                held.append(press.compress(record) + press.flush())
                size += len(record)
        if held:
            yield archive(held)

    return write


def arc_to_warc(archives: DataFrame, path: str, min_bytes: int = 0, file_bytes: int = WARC_BYTES) -> None:
    """Convert ARC files (``archive, content``) to WARC files under ``path``, bounded by bytes, each record a gzip member.

    Of records with equal payloads of at least ``min_bytes`` bytes that with the largest key is a response (null keys come
    last); the others become revisits. Only one row for each digest is aggregated; the records themselves move once.
    """
    records = archives.mapInArrow(_parse_archives, _PARSED)
    # A hot payload's partial rows meet as one row for each task. What is kept of the digests that occur twice is written, as an
    # aggregate between shuffle and join would bar Spark from splitting a hot digest's records over tasks.
    kept = F.max(F.struct("key", "record_id", "url", "warc_date")).alias("kept")
    keep = archives.mapInArrow(_parse_archives, _PARSED).filter(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), kept).filter("n > 1").drop("n")
    joined = records.join(cut_lineage(keep), "digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("kept.record_id").isNotNull() & (F.col("kept.record_id") != F.col("record_id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.col("kept.record_id")),
            line("WARC-Refers-To-Target-URI", F.col("kept.url")),
            line("WARC-Refers-To-Date", F.col("kept.warc_date")),
        )).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    # A record ends with two line ends. The text writer puts a separator after each file's only row: a member without content,
    # so that a reader sees nothing of it.
    files = joined.select(F.concat(record, F.lit("\r\n\r\n")).alias("value")).mapInArrow(_warc_files(file_bytes), "value string")
    nothing = gzip.compress(b"", mtime=0).decode("latin-1")
    files.write.option("encoding", "ISO-8859-1").option("lineSep", nothing).option("maxRecordsPerFile", 1).text(path)


def _inflated(content: bytes) -> Iterator[bytes]:
    """A plain or gzipped file piece by piece, whatever its members are."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    view, at, fed, member, begun = memoryview(content), 0, b"", zlib.decompressobj(31), False
    while True:
        if not len(fed):
            fed, at = view[at : at + _FED], at + _FED
            if not len(fed) and not begun:
                return
            ended = not len(fed)
        piece, begun = member.decompress(fed, _CHUNK), True
        if piece:
            yield piece
        if member.eof:
            fed, member, begun = member.unused_data, zlib.decompressobj(31), False
        elif ended and not piece:
            raise ValueError("a gzip member ends early")
        else:
            fed = member.unconsumed_tail


def warc_records(content: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """``(offset, headers, block)`` of each record of a WARC file, plain or gzipped, cut by the declared lengths. Of the
    inflated file only the record at hand is held."""
    chunks, held, at = _inflated(content), bytearray(), 0

    def more(n: int, mark: bytes = b"") -> int:
        """Read on until ``n`` bytes are held, or until the mark is; where it stands."""
        start = 0
        while (end := held.find(mark, start)) < 0 if mark else len(held) < n:
            start = max(0, len(held) - len(mark))
            piece = next(chunks, None)
            if piece is None:
                raise ValueError(f"record at {at} does not end where it declares")
            held.extend(piece)
        return end if mark else n

    while True:
        while not held:
            piece = next(chunks, None)
            if piece is None:
                return
            held.extend(piece)
        end = more(0, b"\r\n\r\n")
        first, *lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        stop = end + 4 + int(headers["content-length"])
        more(stop + 4)
        if held[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where it declares")
        yield at, headers, bytes(held[end + 4 : stop])
        at += stop + 4
        del held[: stop + 4]


_WARC = "file string, offset long, record_id string, record_type string, warc_date string, target_uri string, payload_digest string, refers_to string, key long, refers_to_key long, declared_bytes long, payload binary"


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files under ``path``; ``payload`` is null for revisits, ``declared_bytes`` holds either's length."""

    kinds = [x.split() for x in _WARC.split(", ")]
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, arrow[k]) for v, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in kinds])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows, size = [], 0
                for at, h, block in warc_records(content):
                    head, payload = _split_http(block)
                    key, length, refers = _KEY.search(head), _LENGTH.search(head), h.get("warc-refers-to")
                    rows.append((PurePosixPath(path).name, at, h["warc-record-id"], h["warc-type"], h["warc-date"], h["warc-target-uri"], h["warc-payload-digest"].removeprefix("sha1:"), refers,
                                 uuid_key(h["warc-record-id"]) if key else None, uuid_key(refers) if refers else None, int(length[1]) if length else None, payload if h["warc-type"] == "response" else None))
                    size += len(block)
                    if size > _CHUNK:
                        yield as_batch(rows)
                        rows, size = [], 0
                if rows:
                    yield as_batch(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, _WARC)


def archive_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"


def convert_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Pages to ARC, ARC to WARC, and back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Null html is an empty payload, a null url ``about:blank``. A row with a null id keeps a null ``page_id`` and never
    wins over one that has an id. Of rows repeated with one id and payload, all but those with the winning record's
    identifier are revisits; identical rows share an identifier and so their type. Of ties, records with one key, payload and
    different urls, that with the largest identifier is the response. A very long page has an archive of its own. An empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    spark = pages.sparkSession
    path = archive_folder(spark)
    arc_to_warc(pages_to_arc(pages), path, min_bytes)
    read = read_warc(spark, path)
    size = F.coalesce(F.octet_length("payload").cast("long"), F.col("declared_bytes"))
    result = cut_lineage(read.select(F.col("key").alias("page_id"), size.alias("payload_bytes"), "payload_digest", "record_type", F.col("refers_to_key").alias("refers_to")))
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(files, True)
    return result
