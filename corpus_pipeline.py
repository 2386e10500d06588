"""A corpus pipeline of five stages: language ID, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept; all but the last return the columns
of ``documents``. ``run`` writes each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.llm.common import checkpoint_folder
from sparkscope.llm.exact_dedup import exact_groups, normalised
from sparkscope.llm.languages import fit, identify_documents
from sparkscope.llm.mixing import mix
from sparkscope.llm.packing import pack_documents
from sparkscope.llm.queries import tokenizer_path
from sparkscope.llm.simhash import similar_groups

#: Near-dedup of the pipeline: words in a shingle, and the similarity of their shingles from which texts are copies.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def _only(docs: DataFrame, kept: DataFrame, *on: str) -> DataFrame:
    """Rows of ``docs`` whose ``on`` columns, null or not, are among those of ``kept``."""
    names = kept.select(*[F.col(c).alias(f"_{c}") for c in on]).distinct()
    same = F.lit(True)
    for c in on:
        same = same & docs[c].eqNullSafe(names[f"_{c}"])
    return docs.join(names, same, "left_semi")


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language can't be told: no letters, or no language with half of the posterior.

    Null and empty texts go, as they hold no letters. Null ids, languages and sources are allowed. Very long texts are judged
    whole. Rows with one id are judged each for itself, and all of them stay where one does; of tied languages the first by
    code point counts. An empty table gives an empty result. All columns of ``docs`` are returned, further ones too.
    """
    judged = identify_documents(docs, fit(docs))
    return _only(docs, judged.filter("accepted"), "doc_id")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of equal texts: that with the smallest id, and of rows repeated with it one.

    A null text equals an empty one. Null ids come after all others. Of ties, rows with one id and text, any one stays. Very
    long texts are compared whole. An empty table gives an empty result. All columns of ``docs`` are returned.
    """
    kept = exact_groups(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    marked = docs.withColumn("sha", F.sha2(normalised(), 256))
    rest = _only(marked, kept, "doc_id", "sha")
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()
    return (rest.dropDuplicates(["doc_id", "sha"]) if (ids.most or 0) > 1 else rest).drop("sha")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each group of similar texts the document with the smallest id.

    Null and empty texts are one group. Rows repeated with the id that stays all stay, exact copies being the stage before's
    matter; so do rows with a null id in a group without any id. Very long texts are compared whole. An empty table gives an
    empty result. All columns of ``docs`` are returned.
    """
    groups = similar_groups(docs, SHINGLE_WORDS, SIMILARITY)
    return _only(docs, groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))), "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document for its whole epochs; the one at a source's cut ends with the last word of the budget.

    Null and empty texts have no words and are not in the mix. A null source is one of its own, null ids are allowed. Rows
    repeated with one id, source and size share what was taken of one of them. A very long text is cut like any other. An
    empty table gives an empty result. All columns of ``docs`` are returned, ``n_chars`` being that of the cut text.
    """
    taken = mix(docs).filter("taken > 0").select(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("source").alias("_source"), F.col("taken").alias("_taken")).dropDuplicates(["_id", "_source", "_size"])
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    sized = docs.withColumn("_words", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    joined = sized.join(taken, sized["doc_id"].eqNullSafe(taken["_id"]) & sized["source"].eqNullSafe(taken["_source"]) & (sized["_words"] == taken["_size"]))
    whole = F.floor(F.col("_taken") / F.col("_size")).cast("int")
    rest = (F.col("_taken") % F.col("_size")).cast("int")
    copies = F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    each = joined.withColumn("_cut", F.explode(copies))
    text = F.when(F.col("_cut") == 0, F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.greatest(F.col("_cut"), F.lit(1))), " "))
    return each.withColumn("text", text).withColumn("n_chars", F.when(F.col("_cut") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into sequences of 4096 tokens: one row per piece.

    Null and empty texts are one token, the end mark. Null ids and repeated rows are packed each for itself; a very long text
    gives many pieces. Pieces of one length are interchangeable, so ties only number sequences differently. An empty table
    gives an empty result.
    """
    return pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Trained and tokenised stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
