"""Language identification with a string kernel.

A text is seen as the set of its 1- to 4-grams of lower-cased letters (all other characters are one separator),
hashed to 2^20: its blended spectrum, by presence. The kernel of two texts is the number of n-grams that they
share over the root of the product of their numbers, both counted within the n-grams of the landmarks. Landmarks
are up to `LANDMARKS` training texts; the Nystroem map they give feeds a one-versus-rest kernel ridge regression.
Scores of a batch of documents are one matrix product: their presence rows times the weights that the
regression, the Nystroem map and the landmarks' presence rows multiply out to.

Training sees at most `PER_LANG` documents of each of the `MAX_LANGS` most frequent languages, those with the smallest hash of their
doc_id, with a non-null lang and outside the held-out fold (crc32 of the id modulo 4 is 2). Of each only the n-grams leave its task.
Landmarks are the first of them with at most `MARK_GRAMS` n-grams, others only if a language has none. Their kernel's sums of products come
from at most `SUMS` tasks; no row of the kernel is collected. The weights are at most `MAX_WEIGHTS` numbers: with many languages
the n-grams that fewest landmarks have are left out. A prediction depends on the text only.

Defined results: `und` with score 0 for a null text or one without a letter, and for all when there is nothing to
learn from; a text that shares no n-gram with a landmark gets the most frequent learned language with score 0.
Ties go to the language that sorts first. Repeated rows are predicted each time; of the rows with one doc_id and lang one is
learned from; a null doc_id is in no fold and not learned from. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import durable, fold, map_columns, remainder

BITS, ORDERS, FOLDS, HELD_OUT = 20, 4, 4, 2
PER_LANG, LANDMARKS, RIDGE, BATCH = 1000, 256, 1e-2, 64
MAX_LANGS, MARK_GRAMS, SUMS, MAX_WEIGHTS = 1000, 1 << 16, 16, 1 << 24
MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


@cache
def letters() -> np.ndarray:
    """The lower-cased code point of each letter, 0 for every other code point."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            out[i] = ord(c.lower()[0])
    return out


def spectrum(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of a text, repeats included; None without a letter."""
    points = letters()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    if not points.any():
        return None
    code, parts = points * MIX[0], []
    parts.append(code[points != 0])
    for n in range(1, min(ORDERS, len(points))):
        code = code[:-1] * MIX[1] + points[n:] * MIX[2] + MIX[3]
        parts.append(code)
    return (np.concatenate(parts) * MIX[0]) >> np.uint32(32 - BITS)


@dataclass
class Model:
    """slots: n-gram hash to column, the last column for n-grams of no landmark; weights: column by language."""

    langs: list[str]
    usual: int
    slots: np.ndarray
    weights: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        out, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return out, scores
        for at in range(0, len(texts), BATCH):
            rows = [(i, s) for i, t in enumerate(texts[at : at + BATCH], at) if (s := spectrum(t)) is not None]
            found = presence([s for _, s in rows], self.slots, len(self.weights))
            values = found @ self.weights / np.sqrt(np.maximum(found.sum(axis=1, keepdims=True), 1))
            values[~found.any(axis=1)] = 0
            best = np.where(found.any(axis=1), values.argmax(axis=1), self.usual)
            for (i, _), b, v in zip(rows, best.tolist(), values):
                out[i], scores[i] = self.langs[b], min(1.0, max(0.0, float(v[b])))
        return out, scores


def presence(spectra: list[np.ndarray], slots: np.ndarray, width: int) -> np.ndarray:
    """One row of zeros and ones for each spectrum, over the landmarks' n-grams."""
    out = np.zeros((len(spectra), width + 1), dtype=np.float32)
    for row, s in zip(out, spectra):
        row[slots[s]] = 1
    return out[:, :-1]


def sample(docs: DataFrame, per_lang: int = PER_LANG) -> DataFrame:
    """(text, lang, nth): up to per_lang documents of each language, nth in the order of their id's hash; a language's repeated ids count once."""
    ids = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string")).where("lang IS NOT NULL AND doc_id IS NOT NULL")
    ids = ids.where(fold("doc_id", FOLDS) != HELD_OUT).withColumn("h", F.xxhash64("doc_id"))
    # a share of each language that holds its smallest hashes is cut out before any sort, so a hot language costs no more
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    share = durable(counts.select("lang", (F.lit(4.0 * per_lang) / F.col("n")).alias("p")))
    near = ids.join(F.broadcast(share), "lang").where(F.col("h") / F.lit(2.0**63) <= 2 * F.col("p") - 1).select("lang", "h", "doc_id").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = near.withColumn("nth", nth).where(F.col("nth") <= per_lang).select("lang", "doc_id", "nth")
    # texts are met last, and those of the other documents are never moved
    texts = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "text").where("lang IS NOT NULL")
    return texts.join(F.broadcast(picked), ["lang", "doc_id"]).select("text", "lang", "nth")


def _spectra(rows: DataFrame) -> DataFrame:
    """(lang, nth, grams): the distinct n-grams of the texts that have a letter; of equal places in a language one."""

    def make():
        def work(batch: pa.RecordBatch):
            found = [(lang, nth, np.unique(s).astype(np.int32)) for t, lang, nth in zip(*(batch.column(i).to_pylist() for i in range(3))) if (s := spectrum(t)) is not None]
            kinds = (pa.string(), pa.int32(), pa.list_(pa.int32()))
            return {n: pa.array(c, k) for n, c, k in zip(("lang", "nth", "grams"), list(zip(*found)) or [()] * 3, kinds)}

        return work

    return map_columns(rows, "lang string, nth int, grams array<int>", make).groupBy("lang", "nth").agg(F.min("grams").alias("grams"))


def train(docs: DataFrame) -> Model:
    rows = durable(_spectra(sample(docs)).repartition(SUMS))
    langs = [(r[0], r[1]) for r in rows.groupBy("lang").count().orderBy("lang").collect()]
    if not langs:
        return Model([], 0, np.empty(0), np.empty(0))
    names = [name for name, _ in langs]
    long = F.size("grams") > MARK_GRAMS
    place = F.row_number().over(Window.partitionBy("lang").orderBy(long, "nth"))
    chosen = rows.withColumn("long", long).withColumn("place", place).where(F.col("place") <= max(1, LANDMARKS // len(langs))).where("NOT long OR place = 1")
    spectra = [np.array(r[0], dtype=np.uint32) for r in chosen.orderBy("lang", "place").select("grams").collect()]
    slots, marks = landmarks(spectra, MAX_WEIGHTS // len(langs))
    shared = docs.sparkSession.sparkContext.broadcast((slots, marks, names))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, marks, names = shared.value
        number = {name: i for i, name in enumerate(names)}
        m = len(marks.sizes)
        square, wanted = np.zeros((m, m)), np.zeros((m, len(names)))
        for batch in batches:
            for lang, grams in zip(batch.column(0).to_pylist(), batch.column(1)):
                k = marks.kernel(slots[grams.values.to_numpy(zero_copy_only=False).view(np.uint32)])
                square += np.outer(k, k)
                wanted[:, number[lang]] += k
        yield pa.RecordBatch.from_arrays([pa.array([x.ravel()], pa.list_(pa.float64())) for x in (square, wanted)], names=["square", "wanted"])

    m = len(spectra)
    parts = rows.select("lang", "grams").mapInArrow(add_up, "square array<double>, wanted array<double>").toArrow()
    square, wanted = (sum(np.asarray(part.values) for part in parts[n]).reshape(m, -1) for n in ("square", "wanted"))
    usual = max(range(len(langs)), key=lambda i: langs[i][1])
    return Model(names, usual, slots, marks.weights(regress(marks, square, wanted)))


@dataclass
class Marks:
    """The landmarks' n-grams: for each slot the landmarks that have it, from starts[slot] in `owners`; and how many slots each landmark has."""

    starts: np.ndarray
    owners: np.ndarray
    sizes: np.ndarray

    def kernel(self, slots: np.ndarray) -> np.ndarray:
        """The kernel of a text, by the slots of its distinct n-grams, with each landmark."""
        slots = slots[slots < len(self.starts) - 1]
        begins, counts = self.starts[slots], self.starts[slots + 1] - self.starts[slots]
        at = np.repeat(begins - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum()) if len(slots) else np.empty(0, np.int64)
        shared = np.bincount(self.owners[at], minlength=len(self.sizes))
        return shared / np.sqrt(np.maximum(self.sizes * float(len(slots)), 1))

    def gram(self) -> np.ndarray:
        """The kernel of the landmarks with each other."""
        order = np.argsort(self.owners, kind="stable")
        slot = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))[order]
        return np.array([self.kernel(s) for s in np.split(slot, np.cumsum(self.sizes)[:-1])])

    def weights(self, of_marks: np.ndarray) -> np.ndarray:
        """Weights of slots, from those of landmarks."""
        scaled = of_marks / np.sqrt(np.maximum(self.sizes, 1))[:, None]
        out = np.zeros((len(self.starts) - 1, of_marks.shape[1]), dtype=np.float32)
        slot = np.repeat(np.arange(len(out)), np.diff(self.starts))
        for column in range(out.shape[1]):
            out[:, column] = np.bincount(slot, scaled[self.owners, column], minlength=len(out))
        return out


def landmarks(spectra: list[np.ndarray], most: int) -> tuple[np.ndarray, Marks]:
    """The slot of each n-gram, and the landmarks by slot; of more than `most` n-grams those that fewest landmarks have get none."""
    grams, counts = np.unique(np.concatenate([np.empty(0, np.uint32), *spectra]), return_counts=True)
    grams = np.sort(grams[np.lexsort((grams, -counts))][:most])
    slots = np.full(1 << BITS, len(grams), dtype=np.int32)
    slots[grams] = np.arange(len(grams))
    kept = [s[s < len(grams)] for s in (slots[x] for x in spectra)]
    slot, owner = np.concatenate([np.empty(0, np.int32), *kept]), np.repeat(np.arange(len(kept)), list(map(len, kept)))
    order = np.argsort(slot, kind="stable")
    starts = np.concatenate(([0], np.cumsum(np.bincount(slot, minlength=len(grams))))).astype(np.int64)
    return slots, Marks(starts, owner[order].astype(np.int32), np.array(list(map(len, kept)), dtype=np.int64))


def regress(marks: Marks, square: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Weights of landmarks by language: Nystroem map, then ridge regression, from the sums of k k' and of k y' over the training texts."""
    value, vector = np.linalg.eigh(marks.gram())
    good = value > 1e-6 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    ridge = np.linalg.solve(root.T @ square @ root + RIDGE * np.eye(root.shape[1]), root.T @ wanted)
    return root @ ridge


def identify(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs))

    def make():
        def work(batch: pa.RecordBatch):
            predicted, scores = model.value.predict(batch.column(1).to_pylist())
            held = remainder(batch.column(0), FOLDS) == HELD_OUT
            return {"doc_id": batch.column(0), "held_out": held, "lang_pred": pa.array(predicted, pa.string()), "score": scores}

        return work

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, held_out boolean, lang_pred string, score double", make)
