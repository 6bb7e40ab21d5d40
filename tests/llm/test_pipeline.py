"""The pipeline's stages in order, their effect and their columns."""

import corpus_pipeline
from gleaner.llm.common import cut

SF001 = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_duplicates", "mixing", "packing"]
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = cut(stage(spark, now, SF001))
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF001).collect()
    total = sum(r["length"] for r in packed)
    assert total == sum({(r["sequence_id"], r["offset"]): r["length"] for r in packed}.values())
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF001).drop("sequence_id", "offset", "sequence_tokens").collect())) == sorted(
        (r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in packed
    )


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF001)
    assert docs.count() == 0
