"""The pipeline against a brute-force version of its decisions, and the contract of its stages."""

import os
import sys

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
sys.path.insert(0, os.path.dirname(__file__))
from test_text_ops import contaminated  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "line_dedup":
            assert set(after) == set(before)
        else:
            assert all(after[i] == before[i] for i in after)
        if name == "benchmark_decontamination":
            assert set(before) - set(after) == {x[0] for x in contaminated(list(before.items()), [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]) if x[-1]}
    assert docs.count() == corpus_pipeline.run(spark, SF).count()
