"""The pipeline on a small table, and its registration."""

import corpus_pipeline


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    docs = docs.unionByName(docs.limit(5)).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) doc_id, CAST(NULL AS STRING) text, 'en' lang, 's' source, 0L n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    ids = [r[0] for r in docs.select("doc_id").collect()]
    assert ids and len(ids) == len(set(ids))
    assert docs.filter("size(samples) = 0").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(f"{sf}/documents.parquet").limit(0), sf).count() == 0, name
