"""Long repetitive texts and hot keys: linear time, and joins that Spark splits."""

import time

import pytest

from sparkscope.llm.licences import PHRASES, _phrase_places, scan_licences
from sparkscope.llm.secrets import scan_secrets
from sparkscope.llm.web_archive import convert_pages

#: So that what is skewed at scale is skewed here.
SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def small(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_places_of_phrases():
    wanted = {f" {k} ".encode(): v for k, v in PHRASES.items()}
    words = b"x cc by cc by mit license gnu general public license cc".split()
    assert _phrase_places(words, wanted) == [(1, "cc-by"), (3, "cc-by"), (5, "mit"), (7, "gpl")]
    assert _phrase_places([b"cc"], wanted) == []


def test_a_long_repetitive_license_text_takes_seconds(spark):
    docs = spark.createDataFrame([(1, "cc by " * 800_000), (2, None)], "doc_id long, text string")
    began = time.perf_counter()
    found = {r["doc_id"]: r for r in scan_licences(docs).collect()}
    assert time.perf_counter() - began < 60
    assert (found[1]["n_base"], found[1]["first_word"], found[1]["last_word"], found[2]["n_base"]) == (800_000, 0, 1_599_998, 0)


def test_a_widely_copied_secret_is_split_over_tasks(small):
    docs = small.range(6000).selectExpr("id AS doc_id", "concat(repeat(' ', CAST(xxhash64(id) % 50 + 50 AS INT)), 'token = ', CASE WHEN id % 20 > 0 THEN 'sharedvalue0001' ELSE sha2(CAST(id AS STRING), 256) END) AS text", "CAST(id % 7 AS STRING) AS source", "'en' AS lang")
    found = scan_secrets(docs.repartition(6))
    rows = found.collect()
    assert sum(r["n_assign"] for r in rows) == 6000 and {r["most_owners"] for r in rows if r["doc_id"] % 20} == {7}
    # Equal values shrink when they are shuffled, so that it takes most rows to make a part the largest in bytes.
    assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()


def test_copies_of_a_page(small):
    pages = small.range(400).selectExpr("id AS page_id", "concat('http://h/', id) AS url", "CASE WHEN id % 2 = 0 THEN repeat('copy ', 200) ELSE concat('page ', id) END AS html")
    rows = {r["page_id"]: r for r in convert_pages(pages).collect()}
    assert rows[398]["record_type"] == "response" and all(rows[i]["record_type"] == "revisit" and rows[i]["refers_to"] == 398 for i in range(0, 398, 2))
    assert all(rows[i]["record_type"] == "response" and rows[i]["refers_to"] is None for i in range(1, 400, 2))
