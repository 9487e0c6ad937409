"""A training corpus from `documents`: five stages, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castwork.llm import langid, packing, pii_crf, simhash, suffix_dedup
from castwork.llm.common import shared_dir

#: A document is rejected when no language could be named (no letters, or nothing learned) or when less than this
#: share of its letters lies in spans of its main language.
LEAST_SHARE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known, as labelled by the model learned from the stage's own input. Columns of
    the documents that are named like the labels go round them and come out as they were."""
    own = {c: f"_own_{c}" for c in docs.columns if c in ("held_out", "lang_pred", "score")}
    found = langid.identify(docs.withColumnsRenamed(own), langid.fit(docs.select("doc_id", "text", "lang")))
    kept = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.select(*(F.col(own.get(c, c)).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near duplicates (3-word shingles, 3 bits)."""
    return simhash.deduplicate(docs, words=3, max_distance=3)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that start more than once go from the texts."""
    return suffix_dedup.remove_repeats(docs, length=200)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data found by the patterns and the field replaced by its kind."""
    return pii_crf.redacted(docs, pii_crf.fit(docs.select("doc_id", "text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens: a row per piece."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


STAGES = [("language_id", language_id), ("simhash_near_dedup", near_dedup), ("suffix_array_dedup", substring_dedup), ("pii", private_data), ("packing", pack)]

#: SQL expresses none of the stages; tests/llm holds each, and the whole run, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table; each stage's output is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/castwork-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{base}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
