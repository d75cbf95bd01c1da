"""Toxicity scores by logistic regression, trained with FTRL-proximal over hashed word n-grams and skip-grams.

A text is lower-cased (A-Z) and cut into the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Its features are the
presence of words, pairs of neighbours, and pairs with one or two words between them, hashed to 2^20
coordinates. FTRL-proximal gives each coordinate its own rate, and its L1 term keeps only a few of them: the
fitted weights are a short sorted list, at most 2^20 pairs, and are broadcast for scoring.

Training sees at most `SAMPLE` labelled rows and `SAMPLE_BYTES` of their texts, those with the smallest hash of their doc_id; held-out rows
(crc32 of the id modulo 5 is 0) never. So the one task that learns holds a bounded number of features, however long or often repeated
the texts are. Scores depend on the text alone.

Defined results: a null or empty text scores as the bias alone; a label or doc_id that is null is not learned
from; equal rows are learned from once, different texts or labels of one doc_id each; without a usable label nothing
is toxic (scores near 0). An empty documents table gives an empty result. Extra columns are ignored by `score` and kept by `keep_clean`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM, durable, fold, map_columns, raw, remainder, strides

BITS, FOLDS, SAMPLE, SAMPLE_BYTES, EPOCHS = 20, 5, 24_000, 1 << 27, 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
BIAS = 1 << BITS
#: Multipliers of a pair's words, for each distance between them.
PAIRS = {1: (0x9E3779B1, 0x85EBCA77), 2: (0xC2B2AE3D, 0x27D4EB2F), 3: (0x165667B1, 0xD3A2646C | 1)}


def features(text: bytes | None) -> np.ndarray:
    """Coordinates of all n-grams and skip-grams of a text, repeats included."""
    words = text.translate(ALNUM).split() if text else []
    h = np.fromiter(map(zlib.crc32, words), dtype=np.uint32, count=len(words))
    parts = [h * np.uint32(0xB5297A4D)]
    parts += [h[:-gap] * np.uint32(a) + h[gap:] * np.uint32(b) for gap, (a, b) in PAIRS.items() if len(h) > gap]
    return (np.concatenate(parts) >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class Weights:
    """The coordinates with a weight, sorted, and the bias."""

    index: np.ndarray
    value: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.has = np.zeros(1 << BITS, dtype=bool)
        self.has[self.index] = True

    def __reduce__(self):
        return Weights, (self.index, self.value, self.bias)

    def margin(self, found: np.ndarray) -> float:
        found = np.unique(found[self.has[found]])
        return float(self.bias + self.value[np.searchsorted(self.index, found)].sum())

    def score(self, text: bytes | None) -> float:
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, self.margin(features(text))))))


class Ftrl:
    """FTRL-proximal over presence features."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        """Weights at these coordinates, of which the bias comes last; it alone is not shrunk."""
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        w[np.abs(z) <= L1] = 0.0
        w[-1] = -z[-1] / ((BETA + math.sqrt(self.n[-1])) / ALPHA + L2)
        return w

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -40, 40))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g

    def fitted(self) -> Weights:
        w = self.weights(slice(None))
        index = np.flatnonzero(w[:BIAS])
        return Weights(index, w[index], float(w[BIAS]))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes over the sample, in its order, then moves the bias to where the two classes part best."""
    rows: list[tuple[np.ndarray, int]] = []
    for batch in batches:
        for text, label in zip(raw(batch.column(0)), batch.column(1).to_pylist()):
            rows.append((np.append(np.unique(features(text)), BIAS).astype(np.int32), label))
    model = Ftrl()
    for _ in range(EPOCHS):
        for at, label in rows:
            model.learn(at, label)
    fitted = model.fitted()
    labels = np.array([label for _, label in rows], dtype=np.int64)
    if 0 < labels.sum() < len(labels):
        margins = np.array([fitted.margin(at[:-1]) for at, _ in rows])
        order = np.argsort(margins, kind="stable")
        m, y = margins[order], labels[order]
        right = np.concatenate(([0], np.cumsum(y == 0))) + np.concatenate((np.cumsum((y == 1)[::-1])[::-1], [0]))
        best = np.flatnonzero(right == right.max())
        best = int(best[len(best) // 2])
        fitted.bias -= float((m[max(best - 1, 0)] + m[min(best, len(m) - 1)]) / 2)
    elif not len(rows):
        fitted.bias = -40.0
    columns = [pa.array([x.tolist()]) for x in (fitted.index, fitted.value)] + [pa.array([fitted.bias])]
    columns[:2] = [c.cast(k) for c, k in zip(columns, (pa.list_(pa.int64()), pa.list_(pa.float64())))]
    yield pa.RecordBatch.from_arrays(columns, names=["index", "value", "bias"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Weights:
    """Weights from at most `sample` labelled documents outside the held-out fold, of so many bytes, fitted in one task."""
    usable = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("toxic IN (0, 1)").where(fold("doc_id", FOLDS) != 0)
    order = [F.xxhash64("doc_id"), "doc_id", "toxic"]
    picked = usable.distinct().orderBy(*order).limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text")
    # which rows these are is settled before any text moves
    keys = rows.select("doc_id", "hash", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes")).join(F.broadcast(picked), "doc_id").distinct()
    keys = durable(keys.orderBy(*order, "hash").limit(sample))
    upto = F.sum("bytes").over(Window.orderBy(*order, "hash").rowsBetween(Window.unboundedPreceding, 0))
    keys = keys.withColumn("upto", upto).where(F.col("upto") <= size).select("doc_id", "hash", "toxic")
    texts = rows.join(F.broadcast(keys), ["doc_id", "hash"]).groupBy("doc_id", "hash", "toxic").agg(F.first("text").alias("text"))
    one = texts.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(1), "doc_id"), "hash", "toxic").select("text", "toxic")
    fitted = one.mapInArrow(_fit, "index array<long>, value array<double>, bias double").first()
    if fitted is None:
        return Weights(np.empty(0, np.int64), np.empty(0), -40.0)
    return Weights(np.array(fitted[0], dtype=np.int64), np.array(fitted[1]), fitted[2])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def make():
        model = weights.value

        def work(batch: pa.RecordBatch):
            scores = np.array([model.score(t) for t in raw(batch.column(1))], dtype=np.float64)
            held = remainder(batch.column(0), FOLDS) == 0
            return {"doc_id": batch.column(0), "held_out": held, "score": scores, "predicted": (scores >= 0.5).astype(np.int32)}

        return work

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, held_out boolean, score double, predicted int", make)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns kept, without the documents whose score reaches 0.5."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = weights.value
        for batch in strides(batches):
            texts = raw(batch.column(batch.schema.get_field_index("text")))
            yield batch.filter(pa.array([model.score(t) < 0.5 for t in texts], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
