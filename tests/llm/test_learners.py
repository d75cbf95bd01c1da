"""The learners of language ID and toxicity against plain versions of their methods, and the bounds of their samples."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from keyloom.llm import language, toxicity


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(31)
    parts = {"aa": ["tion", "the", "ing", "ed"], "bb": ["ung", "sch", "keit", "ed"], "cc": ["ció", "ñas", "que", "ing"]}
    return [(i, " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(rng.randrange(1, 12))), lang) for i, lang in enumerate(list(parts) * 25)]


def slow_spectrum(text):
    points = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text]
    mask, out = 0xFFFFFFFF, set()
    m = [int(x) for x in language.MIX]
    for i in range(len(points)):
        code = points[i] * m[0] & mask
        if points[i]:
            out.add((code * m[0] & mask) >> 12)
        for n in range(1, min(4, len(points) - i)):
            code = (code * m[1] + points[i + n] * m[2] + m[3]) & mask
            out.add((code * m[0] & mask) >> 12)
    return out


def test_spectra(tongues):
    for text in [t for _, t, _ in tongues[:20]] + ["a", "ab", "a1b", "Ü é!"]:
        assert set(language.spectrum(text).tolist()) == slow_spectrum(text)


@pytest.mark.parametrize("weights", [1 << 24, 3 * 60])
def test_language_model_against_kernel_ridge_regression(spark, tongues, monkeypatch, weights):
    monkeypatch.setattr(language, "LANDMARKS", 12)
    monkeypatch.setattr(language, "MAX_WEIGHTS", weights)
    docs = spark.createDataFrame(tongues, "doc_id long, text string, lang string")
    model = language.train(docs)
    # the same by explicit features: which n-grams each text has, all of the training set, ridge in the map's space
    learned = [(i, t, lang) for i, t, lang in tongues if zlib.crc32(str(i).encode()) % 4 != 2]
    by_hash = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(doc_id)").collect()}
    learned.sort(key=lambda r: (r[2], by_hash[r[0]]))
    marks = [slow_spectrum(t) for lang in ("aa", "bb", "cc") for _, t, l in [r for r in learned if r[2] == lang][:4] for lang_ in [l]]
    counts = defaultdict(int)
    for s in marks:
        for g in s:
            counts[g] += 1
    grams = set(sorted(counts, key=lambda g: (-counts[g], g))[: weights // 3])
    cut = lambda s: s & grams
    kernel = lambda a, b: len(cut(a) & cut(b)) / math.sqrt(max(1, len(cut(a)) * len(cut(b))))
    k_mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(k_mm)
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    x = np.array([[kernel(slow_spectrum(t), m) for m in marks] for _, t, _ in learned]) @ root
    y = np.array([[float(lang == l) for l in ("aa", "bb", "cc")] for _, _, lang in learned])
    ridge = np.linalg.solve(x.T @ x + language.RIDGE * np.eye(x.shape[1]), x.T @ y)
    for _, text, _ in tongues:
        want = np.array([kernel(slow_spectrum(text), m) for m in marks]) @ root @ ridge
        (lang,), (score,) = model.predict([text])
        best = ("aa", "bb", "cc")[int(want.argmax())]
        assert score == pytest.approx(min(1, max(0, want.max())), abs=1e-4) and (lang == best or np.sort(want)[-1] - np.sort(want)[-2] < 1e-4)


def test_repeated_ids_and_long_texts_stay_within_the_sample(spark, tongues, monkeypatch):
    monkeypatch.setattr(language, "MARK_GRAMS", 30)
    rows = tongues + [(1, f"tion {i}", "aa") for i in range(300)] + [(2000, "ungschkeit" * 5000, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.langs == ["aa", "bb", "cc"] and model.predict(["tion the ing tioning"])[0] == ["aa"]


class SlowFtrl:
    """FTRL-proximal as in its paper, with dictionaries."""

    def __init__(self):
        self.z, self.n = defaultdict(float), defaultdict(float)

    def weight(self, i):
        shrunk = 0.0 if i == toxicity.BIAS else toxicity.L1
        if abs(self.z[i]) <= shrunk:
            return 0.0
        return -(self.z[i] - math.copysign(shrunk, self.z[i])) / ((toxicity.BETA + math.sqrt(self.n[i])) / toxicity.ALPHA + toxicity.L2)

    def learn(self, at, label):
        w = {i: self.weight(i) for i in at}
        g = 1 / (1 + math.exp(-max(-40, min(40, sum(w.values()))))) - label
        for i in at:
            sigma = (math.sqrt(self.n[i] + g * g) - math.sqrt(self.n[i])) / toxicity.ALPHA
            self.z[i] += g - sigma * w[i]
            self.n[i] += g * g


def test_ftrl_against_dictionaries(monkeypatch):
    monkeypatch.setattr(toxicity, "L1", 0.7)
    rng = random.Random(32)
    rows = [(sorted(rng.sample(range(60), rng.randrange(1, 9))), rng.randrange(2)) for _ in range(300)]
    fast, slow = toxicity.Ftrl(), SlowFtrl()
    for _ in range(toxicity.EPOCHS):
        for at, label in rows:
            fast.learn(np.array([*at, toxicity.BIAS]), label)
            slow.learn([*at, toxicity.BIAS], label)
    fitted = fast.fitted()
    wanted = {i: slow.weight(i) for i in range(60) if slow.weight(i)}
    assert dict(zip(fitted.index.tolist(), fitted.value.tolist())) == pytest.approx(wanted)
    assert fitted.bias == pytest.approx(slow.weight(toxicity.BIAS)) and 0 < len(wanted) < 60


def rows_of(spark, n):
    rng = random.Random(33)
    words = [f"w{i}" for i in range(50)]
    return [(i, " ".join(rng.choices(words, k=30)) + (" idiot moron" if i % 5 == 0 else "")) for i in range(n)]


def test_training_equals_a_plain_one(spark):
    rows = rows_of(spark, 400)
    docs = spark.createDataFrame(rows + rows[:30], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows] * 2, "doc_id long, toxic int")
    fitted = toxicity.train(docs, labels)
    order = {r[0]: r[1] for r in docs.selectExpr("doc_id", "xxhash64(1, doc_id)").collect()}
    seen = [(sorted(set(toxicity.features(t.encode()).tolist())), int(i % 5 == 0)) for i, t in sorted(rows, key=lambda r: order[r[0]]) if zlib.crc32(str(i).encode()) % 5]
    slow = SlowFtrl()
    for _ in range(toxicity.EPOCHS):
        for at, label in seen:
            slow.learn([*at, toxicity.BIAS], label)
    wanted = {i: w for i in list(slow.z) if i != toxicity.BIAS and (w := slow.weight(i))}
    assert wanted and dict(zip(fitted.index.tolist(), fitted.value.tolist())) == pytest.approx(wanted)


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows = rows_of(spark, 60)
    docs = spark.createDataFrame(rows + [(1, f"repeated id {i}") for i in range(500)] + [(3, "long " * 50_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    sizes = []

    def fit(batches):
        import pyarrow as pa

        texts = [t for b in batches for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([[len(texts)]], pa.list_(pa.int64())), pa.array([[float(sum(map(len, texts)))]]), pa.array([0.0])], names=["index", "value", "bias"])

    monkeypatch.setattr(toxicity, "_fit", fit)
    for sample, size in ((40, 1 << 27), (10_000, 5000), (10_000, 1 << 27)):
        told = toxicity.train(docs, labels, sample, size)
        sizes.append((int(told.index[0]), int(told.value[0])))
    assert sizes[0][0] == 40 and sizes[1][1] <= 5000 and sizes[1][0] > 10 and sizes[2][0] > 300
