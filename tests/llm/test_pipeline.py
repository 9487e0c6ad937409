"""The corpus pipeline on the smallest tables, and its registration."""

from __future__ import annotations

import corpus_pipeline
from castwork.llm import langid, queries

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    assert {f"op{n}_" for n in range(1, 14)} == {k.split("_")[0] + "_" for k in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


def test_stages_follow_each_other(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert docs.count() <= n
            n = docs.count()
    assert docs.select("doc_id").distinct().count() == n
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_a_corpus_of_one_language_passes_language_id_whole(spark):
    texts = ["the cat sat on the mat", "a dog ran over the hill", "rain fell on the town all day"]
    docs = spark.createDataFrame([(i, texts[i % 3] + f" {i}", "en") for i in range(40)], "doc_id bigint, text string, lang string")
    found = langid.identify(docs, langid.fit(docs)).collect()
    assert {(r.lang_pred, r.score) for r in found} == {("en", 1.0)}
    assert corpus_pipeline.language_id(spark, docs, SF).count() == 40
