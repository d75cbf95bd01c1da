"""The pipeline against a brute-force version of its stages over the driver's smallest tables."""

import re

import numpy as np
import pytest

import corpus_pipeline
from keyloom.llm import decontaminate, pieces, segment, simhash, surrogates, toxicity

from tests.llm.test_operators import DOCS, slow_scan
from tests.llm.test_similar import slow_firsts


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {n: spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "benchmark")}


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "sentencepiece"]


def test_run_equals_brute_force(spark, sf, tables):
    weights = toxicity.train(tables["documents"], tables["labels"])
    rows = {r["doc_id"]: r["text"] for r in tables["documents"].collect()}
    clean = {i: t for i, t in rows.items() if weights.score(t and t.encode()) < 0.5}
    clean_rows = list(clean.items())
    single = dict(clean_rows[at] for at in slow_firsts(clean_rows))
    items = [(r["item_id"], r["text"]) for r in tables["benchmark"].collect()]
    scanned = {r[0]: r for r in slow_scan(list(single.items()), items)}
    kept = {i for i, r in scanned.items() if not r[5] and r[2] <= 0.5 * r[1]}
    spark.conf.set(surrogates.SETTING, "k")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(out) == kept and 0 < len(kept) <= len(single) < len(rows)
    spelled = segment.Encoder(segment.Lattice(pieces.scored_pieces(pieces.model_path())))
    scrub = surrogates.Surrogates(b"k")
    for i in kept:
        text = single[i]
        if scanned[i][2]:
            assert slow_scan([(i, spelled.decode(out[i]["ids"]))], items)[0][2] == 0
        else:
            assert spelled.decode(out[i]["ids"]) == surrogates.rewrite(text, scrub)[0]
        assert out[i]["restored"]


def test_a_run_goes_on_behind_the_last_whole_stage(spark, sf, tmp_path, monkeypatch):
    ran = []
    stages = [(name, lambda s, d, f, n=name: ran.append(n) or d.limit(5)) for name, _ in corpus_pipeline.STAGES]
    broken = [*stages[:2], (stages[2][0], lambda *_: 1 / 0), *stages[3:]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", broken)
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, sf, str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    assert corpus_pipeline.run(spark, sf, str(tmp_path)).count() == 5
    assert ran == ["toxicity", "simhash", "decontamination", "pii", "sentencepiece"]


def test_documents_without_anything_pass_untouched(spark, sf):
    docs = spark.createDataFrame([(10_000 + i, " ".join(f"w{(i * 7919 + k * k) % 5003}x" for k in range(60)), "en", "s", 1) for i in range(20)], DOCS)
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, sf)
        assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, docs.collect()))


def test_what_is_cut_out_no_longer_matches():
    items = [(1, " ".join(f"item{k}" for k in range(30)))]
    automaton = decontaminate.Automaton([(1, items[0][1].encode().split())])
    text = ("before it all " * 20 + items[0][1] + " after").encode()
    hit, _ = automaton.matches(decontaminate.words_of(text))
    left = decontaminate.cut_spans(text, hit)
    assert not re.search("item", left) and slow_scan([(1, left)], items)[0][2] == 0
    assert simhash.fingerprint(left.encode()) and np.asarray(hit).sum() == 30
