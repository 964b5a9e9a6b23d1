"""The pipeline's stages on small tables."""

from __future__ import annotations

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert out.count() == docs.count() and {"doc_id", "ids", "decoded"} <= set(out.columns)


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
