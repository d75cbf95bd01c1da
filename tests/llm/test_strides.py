"""Stages that go through batches in strides: a worker lays out a stride's texts at once, not those of 10,000 rows."""

import pyarrow as pa
import pytest

import corpus_pipeline
from keyloom.llm import common, surrogates


def test_strides_bound_the_bytes_of_a_slice_and_lose_no_row():
    texts = ["x" * 30, None, "", "y" * 200, "é" * 20, "z", None, "w" * 50]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["doc_id", "text"])
    for most in (1, 50, 71, 10_000):
        cut = list(common.strides(iter([batch, batch.slice(0, 0), batch.slice(3)]), most))
        assert [r for c in cut for r in c.to_pylist()] == batch.to_pylist() + batch.slice(3).to_pylist()
        for c in cut:
            assert c.num_rows == 1 or sum(len((t or "").encode()) for t in c.column(1).to_pylist()) <= most


@pytest.mark.parametrize("name", ["toxicity", "decontamination", "pii", "sentencepiece"])
def test_stages_hand_on_strides(spark, sf, monkeypatch, name):
    spark.conf.set(surrogates.SETTING, "k")
    docs, runs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), []
    given = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, *more: runs.append(run) or given(self, run, *more))
    dict(corpus_pipeline.STAGES)[name](spark, docs, sf)
    texts = [None, *(f"word{i} and more of it " * 13_000 for i in range(9)), ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    out = list(runs[-1](iter([batch])))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(len(texts)))
    assert all(sum(len(texts[i] or "") for i in b.column(0).to_pylist()) <= common.STRIDE for b in out)
