"""The pipeline's stages on the smallest table."""

import corpus_pipeline
from leasegrain.session import staged

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_have_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, FOLDER), "test-stage")
        counts.append(docs.count())
        assert name == "token-ID / binary output" or docs.columns == columns
        if name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
            held = lambda t: any(x in t for x in items)
            assert not any(held(r.text) for r in docs.collect())
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect() if held(r.text)}
    assert counts[1] == counts[0] and counts[2] < counts[1] and counts[3] <= counts[2] and counts[5] == counts[4]
