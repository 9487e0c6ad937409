"""The training-data operators as queries over the driver's tables, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bloom_lm, bpe_table, crosspoly, divergence, langid, mixing, packing, pii_crf, prefix_trie, simhash, suffix_dedup, warc, winnow


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, max_distance=3, seed=42)


def op2_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_crf.find(docs, pii_crf.fit(docs))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.nearest(_table(spark, sf_dir, "embeddings"), k=10, every=100)


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), folds=4, fold=2)
    return langid.identify(docs.select("doc_id", "text"), model, folds=4, fold=2).drop("text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("word_bpe_49k.json"), capacity=2048)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(_table(spark, sf_dir, "pages"), least=100)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), length=200).drop("spans")


def op9_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(_table(spark, sf_dir, "documents").select("doc_id", "text"), folds=7, fold=2)


def op10_bpe_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_table.token_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"), _tokenizer("byte_bpe_50k.json"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = prefix_trie.turn_lists(_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_nodes(prefix_trie.rebuilt(lists, family=5, modulus=9)).drop("path")


def op12_sainte_lague(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op13_rle_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=10, most=10)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_pii_crf, op3_winnowing, op4_cross_polytope, op5_langid, op6_packing, op7_warc, op8_suffix_dedup, op9_bloom_lm, op10_bpe_table, op11_prefix_trie, op12_sainte_lague, op13_rle_divergence)}

ORACLES = {
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             f AS (SELECT html, min(page_id) AS first_id FROM p WHERE strlen(html) >= 100 GROUP BY html)
        SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
               CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id IS NOT NULL AND p.page_id IS DISTINCT FROM f.first_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.html = f.html
    """,
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_sainte_lague": mixing.SQL,
    "op13_rle_divergence": divergence.SQL,
}
