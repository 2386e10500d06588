"""ARC and WARC: exact round trips."""

import base64
import hashlib
from collections import defaultdict

from sparkscope.llm import web_archive

SCHEMA = "page_id long, url string, html string, key long, content string, digest string"
ROWS = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a b/\n", ""), (5, "http://a/5", "\r\n\r\nWARC/1.1\r\n\r\n"), (-6, "http://a/6", "é" * 5000),
        (7, "http://a/7", "\n"), (7, "http://a/7", "\n"), (9, "http://a/9", "filedesc://x 0 0 0 5\n12345"), (2**62 + 5, "http://big/", "big")]


def _check(rows, got, least):
    by = defaultdict(list)
    for key, _, html in rows:
        by[html or ""].append(key)
    assert sorted(r["page_id"] for r in got) == sorted(r[0] for r in rows)
    texts = {r[0]: r[2] or "" for r in rows}
    for r in got:
        payload = texts[r["page_id"]].encode()
        winner = max(by[payload.decode()])
        revisit = len(payload) >= least and r["page_id"] != winner
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("revisit", winner) if revisit else ("response", None))


def test_cases(spark):
    pages = spark.createDataFrame([r + (5, "clash", "clash") for r in ROWS], SCHEMA).repartition(2)
    _check(ROWS, web_archive.convert_pages(pages).collect(), 0)
    _check(ROWS, web_archive.convert_pages(pages, min_bytes=4).collect(), 4)
    assert web_archive.convert_pages(pages.filter("false")).count() == 0


def test_null_id(spark):
    pages = spark.createDataFrame([(None, "http://a/1", "x", 5, "", ""), (3, "http://a/2", "x", 5, "", "")], SCHEMA)
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"]) for r in web_archive.convert_pages(pages).collect()) == [(0, "revisit", 3), (3, "response", None)]


def test_small_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    _check([(r["page_id"], r["url"], r["html"]) for r in pages.collect()], web_archive.convert_pages(pages).collect(), 0)


def test_payloads_survive(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>\r\n\r\n") for i in range(50)], "page_id long, url string, html string")
    path = web_archive.archive_folder(spark)
    web_archive.arc_to_warc(web_archive.pages_to_arc(pages), path)
    got = {r["key"]: (bytes(r["payload"]).decode(), r["target_uri"], r["warc_date"]) for r in web_archive.read_warc(spark, path).collect()}
    assert got == {i: (f"<p>{i}</p>\r\n\r\n", f"http://h/{i}", "2024-01-01T00:00:00Z") for i in range(50)}


def test_both_arc_versions():
    for version in (1, 2):
        name = "x.arc"
        content = web_archive._arc_start(name, version, "20010203040506") + web_archive._arc_record(version, name, 9, "http://a/", "20010203040506", b"line\nhttp://b/ 0 0 0 4\n")
        ((v, _, fields, block),) = web_archive.arc_records(content)
        assert (v, fields["URL"], fields["Archive-date"], block) == (version, "http://a/", "20010203040506", b"line\nhttp://b/ 0 0 0 4\n")


def test_keys_in_identifiers():
    for key in (0, 1, -1, 2**63 - 1, -(2**63), 2**62 + 12345):
        assert web_archive.uuid_key(f"<urn:uuid:{web_archive.record_uuid(key, 'http://a/')}>") == key


def test_files_are_bounded_by_bytes_with_a_member_for_each_record(spark):
    import gzip
    import zlib
    from pathlib import Path

    rng = __import__("random").Random(3)
    pages = spark.createDataFrame([(i, f"http://h/{i}", "".join(rng.choices("abcdefgh<> ", k=20_000))) for i in range(60)] + [(100, "http://h/long", "x" * 9_000_000)], "page_id long, url string, html string").coalesce(1)
    path = web_archive.archive_folder(spark)
    web_archive.arc_to_warc(web_archive.pages_to_arc(pages), path, file_bytes=100_000)
    files = [f.read_bytes() for f in Path(path.removeprefix("file:")).glob("part-*")]
    assert len(files) >= 12
    for content in files:
        assert len(gzip.decompress(content)) <= 100_000 or content.count(b"\x1f\x8b\x08") == 2
        records = list(web_archive.warc_records(content))
        assert records == list(web_archive.warc_records(gzip.decompress(content)))
        member = zlib.decompressobj(31)
        assert len(list(web_archive.warc_records(member.decompress(content)))) == 1 and member.eof
    assert web_archive.read_warc(spark, path).count() == 61


def test_broken_files_are_errors():
    import gzip

    import pytest

    whole = gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n")
    assert [b for _, _, b in web_archive.warc_records(whole + gzip.compress(b"") + whole)] == [b"abc", b"abc"]
    for bad in (whole[:-12], whole + whole[:9], gzip.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), gzip.compress(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(ValueError):
            list(web_archive.warc_records(bad))
