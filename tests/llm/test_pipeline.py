"""The corpus pipeline: its stages in order, and what they leave, against plain versions."""

import pytest

pytest.importorskip("corpus_pipeline")

from tests.llm import brute
from twinlake.llm import toxicity


def test_stages(spark, tmp_path):
    import corpus_pipeline

    src = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_join", "secret_scans", "source_mixing", "curve_packing"]
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{src}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score_toxicity(docs, model).where("predicted = 1").collect()}
    kept = corpus_pipeline.drop_toxic(spark, docs, src)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert {d for d, _ in rows} == {r.doc_id for r in docs.collect()} - rejected
    first = corpus_pipeline.drop_near_copies(spark, kept, src)
    assert {r.doc_id for r in first.collect()} == {d for d, (_, c) in brute.ngram_join(rows).items() if d == c}
    out = corpus_pipeline.run(spark, src)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0
