"""Benchmark decontamination with generalised suffix automata over the words of all test items.

A text is lower-cased (A-Z) and cut into the words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Each document is
streamed through the automaton, which gives at every word the length of the longest suffix that is a
stretch of some item. A length of `window` words or more means that an item window ends there.

Items are cut into overlapping stretches of `STRETCH` words, which have the same windows, and dealt out to as many automata
as keep each within `PART_WORDS` words. Executors build them, as flat arrays of at most `BYTES_PER_WORD` bytes a word. One
automaton is broadcast at a time, and each takes a pass over the documents; usually there is only one.

Defined results: a null or empty text has no words, no hits and the digest of the empty string. Items without
words never occur; items shorter than the window occur as a whole; repeated items and items with one id merge;
a null item id is left out of the digest list, though its words still count as hit. An empty benchmark table
hits nothing. Extra columns of either table are ignored by `scan` and kept by `decontaminate`.
"""

from __future__ import annotations

import hashlib
import pickle
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, durable, fresh, map_columns, numbered, raw, replace_text, strides

#: Words of test items in one automaton, in a stretch of an item, and bytes that an automaton takes for a word at most.
PART_WORDS, STRETCH, BYTES_PER_WORD = 1 << 18, 1024, 220
#: Words of more bytes than these are known by a digest, so that every word's size is bounded.
LONG_WORD = 64


def _short(word: bytes) -> bytes:
    """The word, or for a long one a digest, which no word equals as no UTF-8 text holds the byte 0xFF."""
    return word if len(word) <= LONG_WORD else b"\xff" + hashlib.blake2b(word, digest_size=32).digest()


class _Growing:
    """A generalised suffix automaton while it is built: a dictionary of transitions for each state."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])

    def extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            if self.length[known] == self.length[last] + 1:
                return known
            return self._split(last, known, word)
        new = self._state(self.length[last] + 1, {})
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            known = self.next[at][word]
            self.link[new] = known if self.length[known] == self.length[at] + 1 else self._split(at, known, word)
        return new

    def _split(self, at: int, known: int, word: int) -> int:
        clone = self._state(self.length[at] + 1, dict(self.next[known]))
        self.link[clone], self.link[known] = self.link[known], clone
        while at >= 0 and self.next[at].get(word) == known:
            self.next[at][word] = clone
            at = self.link[at]
        return clone

    def _state(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1


class Automaton:
    """Generalised suffix automaton of word sequences in flat arrays, with the items of each window in reach of a state.

    The edges of state s are first[s] to first[s + 1] in `words` (sorted) and `targets`; those of state 0 are in `root`. anchor[s] is
    the state that holds the suffix of `window` words, up[s] the nearest state from s upwards where a shorter item ends.
    owned[s] to owned[s + 1] are the places in `owners` of the items of a window, or shorter item, that state s stands for.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = 8):
        self.window, self.vocabulary = window, {}
        vocabulary, keys, names = self.vocabulary, {}, {}
        for item, words in items:
            if words:
                key = array("i", [vocabulary.setdefault(_short(w), len(vocabulary) + 1) for w in words]).tobytes()
                keys.setdefault(key, set()).add(names.setdefault(item, len(names)))
        self.ids: list[object] = list(names)
        self.shortest = min([window, *(len(key) // 4 for key in keys)])
        grown = _Growing()
        for key in keys:
            last = 0
            for word in array("i", key):
                last = grown.extend(last, word)
        n = len(grown.length)
        self.link, self.length = grown.link, grown.length
        sizes = np.fromiter(map(len, grown.next[1:]), dtype=np.int64, count=n - 1)
        self.first = array("i", np.concatenate(([0, 0], np.cumsum(sizes))).astype(np.int32).tobytes())
        self.words, self.targets = array("i"), array("i")
        for edges in grown.next[1:]:
            for word in sorted(edges):
                self.words.append(word)
                self.targets.append(edges[word])
        self.root = array("i", [grown.next[0].get(w, 0) for w in range(len(vocabulary) + 1)])
        by_length = np.argsort(np.frombuffer(self.length, dtype=np.int32), kind="stable")[1:].tolist()
        self.anchor, self.up = array("i", bytes(4 * n)), array("i", bytes(4 * n))
        for v in by_length:
            self.anchor[v] = v if self.length[self.link[v]] < window else self.anchor[self.link[v]]
        pairs: set[tuple[int, int]] = set()
        ends = bytearray(n)
        for key, owners in keys.items():
            state, size = 0, len(key) // 4
            for at, word in enumerate(array("i", key), 1):
                state = grown.next[state][word]
                if at >= window or at == size:
                    pairs.update((self.anchor[state] if at >= window else state, o) for o in owners)
            ends[state] |= size < window
        for v in by_length:
            self.up[v] = v if ends[v] else self.up[self.link[v]]
        flat = np.array(sorted(pairs), dtype=np.int32).reshape(-1, 2)
        self.owned = array("i", np.searchsorted(flat[:, 0], np.arange(n + 1)).astype(np.int32).tobytes())
        self.owners = array("i", flat[:, 1].tobytes())
        self.has_long = any(w[0] == 0xFF for w in vocabulary)

    def matches(self, words: list[bytes]) -> tuple[np.ndarray, set[object]]:
        """Which words lie in an occurrence of a window, and the items of these windows."""
        hit, states = np.zeros(len(words) + 1, dtype=np.int32), set()
        if not self.vocabulary:
            return hit[:-1] > 0, set()
        known = self.vocabulary.get
        ids = np.array([known(w, 0) for w in words] if not self.has_long else [known(_short(w), 0) for w in words], dtype=np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], ids != 0, [0]))))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.shortest:
                self._stream(ids[start:end].tolist(), start, hit, states)
        found = {self.ids[o] for s in states for o in self.owners[self.owned[s] : self.owned[s + 1]]}
        return np.cumsum(hit)[:-1] > 0, found

    def _stream(self, ids: list[int], offset: int, hit: np.ndarray, states: set[int]) -> None:
        first, words, targets, link, length, root = self.first, self.words, self.targets, self.link, self.length, self.root
        anchor, up_of, window = self.anchor, self.up, self.window
        state = size = 0
        for at, word in enumerate(ids, offset + 1):
            while state:
                low, high = first[state], first[state + 1]
                if high - low > 1:
                    low = bisect_left(words, word, low, high)
                if low < high and words[low] == word:
                    break
                state = link[state]
                size = length[state]
            state, size = (targets[low], size + 1) if state else (root[word], 1)
            if size >= window:
                hit[at - size] += 1
                hit[at] -= 1
                states.add(anchor[state])
            up = up_of[state]
            while up:
                if length[up] <= size:
                    hit[at - length[up]] += 1
                    hit[at] -= 1
                    states.add(up)
                up = up_of[link[up]]


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(ALNUM).split() if text else []


def _stretches(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, words, n): the items that have words, in stretches of bounded length that overlap by `window` - 1 words."""
    rows = benchmark.select(F.col("item_id").cast("string"), "text")

    def make():
        def work(batch: pa.RecordBatch):
            found = []
            for item, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
                words = words_of(text)
                for at in range(0, max(len(words) - window + 1, min(len(words), 1)), STRETCH):
                    part = list(map(_short, words[at : at + STRETCH + window - 1]))
                    found.append((item, b" ".join(part), len(part)))
            columns = list(zip(*found)) or [()] * 3
            return {n: pa.array(c, k) for n, c, k in zip(("item_id", "words", "n"), columns, (pa.string(), pa.binary(), pa.int64()))}

        return work

    return map_columns(rows, "item_id string, words binary, n long", make)


def automata(benchmark: DataFrame, window: int = 8) -> tuple[DataFrame, int]:
    """(part, model): the automata, pickled, one for each of so many parts of the items; and how many parts there are."""
    rows = durable(_stretches(benchmark, window).distinct())
    parts = max(1, -(-(rows.agg(F.sum("n")).first()[0] or 0) // PART_WORDS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)).cast("int"))
    dealt = dealt.repartition(parts, "part").sortWithinPartitions("part").select("part", "item_id", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str | None, list[bytes]]] = []
        now = None
        for batch in batches:
            for part, item, words in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and part != now:
                    yield _model(now, held, window)
                    held = []
                now = part
                held.append((item, words.split(b" ")))
        if held:
            yield _model(now, held, window)

    return durable(dealt.mapInArrow(run, "part int, model binary")), parts


def _model(part: int, items: list[tuple[str | None, list[bytes]]], window: int) -> pa.RecordBatch:
    model = pickle.dumps(Automaton(items, window), protocol=5)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([model], pa.binary())], names=["part", "model"])


def _broadcast(docs: DataFrame, models: DataFrame, part: int) -> Broadcast:
    """One automaton for all executors; a part without items has an empty one."""
    row = models.where(F.col("part") == part).select("model").first()
    return docs.sparkSession.sparkContext.broadcast(pickle.loads(row[0]) if row else Automaton([]))


def _hits(rows: DataFrame, model: Broadcast) -> DataFrame:
    """(row, doc_id, n_words, n_hit, hits, found) of the rows (row, doc_id, text): starts and ends of runs of hit words, and the items' ids."""

    def make():
        def work(batch: pa.RecordBatch):
            sizes, hits, items, n_hit = [], [], [], []
            for text in raw(batch.column(2)):
                words = words_of(text)
                hit, found = model.value.matches(words)
                found.discard(None)
                sizes.append(len(words))
                hits.append(np.flatnonzero(np.diff(np.concatenate(([0], hit, [0])))).astype(np.int32))
                n_hit.append(int(hit.sum()))
                items.append(sorted(found))
            lists = pa.array(hits, pa.list_(pa.int32()))
            counts = {"n_words": pa.array(sizes, pa.int64()), "n_hit": pa.array(n_hit, pa.int64())}
            return {"row": batch.column(0), "doc_id": batch.column(1), "hits": lists, "found": pa.array(items, pa.list_(pa.string()))} | counts

        return work

    return map_columns(rows.select("row", "doc_id", "text"), "row long, doc_id long, n_words long, n_hit long, hits array<int>, found array<string>", make)


def _passes(rows: DataFrame, models: DataFrame, parts: int) -> DataFrame:
    """`_hits` of all automata, each in a pass of its own; a row's runs of all of them come one behind the other."""
    found = None
    for part in range(parts):
        more = durable(_hits(rows, _broadcast(rows, models, part)))
        found = more if found is None else found.unionByName(more)
    lists = [F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found")]
    return found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists)


def _marked(n_words: int, runs: list[int]) -> np.ndarray:
    """Which words are hit."""
    hit = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(hit, np.array(runs[::2], dtype=np.int64), 1)
    np.add.at(hit, np.array(runs[1::2], dtype=np.int64), -1)
    return np.cumsum(hit)[:-1] > 0


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    models, parts = automata(benchmark, window)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts == 1:
        found = _hits(rows.withColumn("row", F.lit(0).cast("long")), _broadcast(docs, models, 0))
    else:
        narrow, row = numbered(rows)
        found = _counted(_passes(narrow.withColumnRenamed(row, "row"), models, parts))
    n_items = F.size("found").cast("long")
    items = F.sha2(F.array_join(F.array_sort("found"), ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", n_items.alias("n_items"), items, (n_items >= min_items).alias("contaminated"))


def _counted(hits: DataFrame) -> DataFrame:
    """The rows (doc_id, n_words, hits, found) with n_hit, the number of words in any of the runs, which may overlap."""

    def make():
        def work(batch: pa.RecordBatch):
            n_hit = [int(_marked(n, runs).sum()) for n, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            return {"doc_id": batch.column(0), "n_words": batch.column(1), "n_hit": pa.array(n_hit, pa.int64()), "found": batch.column(3)}

        return work

    return map_columns(hits.select("doc_id", "n_words", "hits", "found"), "doc_id long, n_words long, n_hit long, found array<string>", make)


def cut_spans(text: bytes, hit: np.ndarray) -> str:
    """The text without the words that are hit, and without what stands between two hit neighbours."""
    shape = np.frombuffer(text.translate(ALNUM), dtype=np.uint8) != 0x20
    edges = np.flatnonzero(np.diff(np.concatenate(([0], shape, [0]))))
    starts, ends = edges[::2], edges[1::2]
    runs = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
    out, at = [], 0
    for first, end in zip(runs[::2].tolist(), runs[1::2].tolist()):
        out.append(text[at : starts[first]])
        at = ends[end - 1]
    return b"".join([*out, text[at:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_items: int = 2, max_coverage: float = 0.5) -> DataFrame:
    """docs, all columns kept, without the words that are hit by item windows.

    A document that holds windows of `min_items` items, or of which more than `max_coverage` of the words are
    hit, is dropped as a whole; of any other the hit spans are cut out of the text. Documents without a hit
    pass untouched, null texts too.
    """
    models, parts = automata(benchmark, window)
    if parts > 1:
        return _decontaminate_in_passes(docs, models, parts, min_items, max_coverage)
    model = _broadcast(docs, models, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in strides(batches):
            texts = raw(batch.column(batch.schema.get_field_index("text")))
            yield _cleaned(batch, [model.value.matches(words_of(text)) for text in texts], min_items, max_coverage)

    return docs.mapInArrow(run, docs.schema)


def _cleaned(batch: pa.RecordBatch, found: list[tuple[np.ndarray, set]], min_items: int, max_coverage: float) -> pa.RecordBatch:
    """The batch without the rows to drop, and with the hit words of the others cut out."""
    column = batch.column(batch.schema.get_field_index("text"))
    texts, keep = column.to_pylist(), []
    for row, (hit, items) in enumerate(found):
        keep.append(len(items - {None}) < min_items and int(hit.sum()) <= max_coverage * len(hit))
        if keep[-1] and hit.any():
            texts[row] = cut_spans(texts[row].encode(), hit)
    return replace_text(batch, texts, keep)


def _decontaminate_in_passes(docs: DataFrame, models: DataFrame, parts: int, min_items: int, max_coverage: float) -> DataFrame:
    """`decontaminate` where the items need several automata: what these find meets the documents by row number."""
    rows, row = numbered(docs)
    found = _passes(rows.select(F.col(row).alias("row"), F.lit(None).cast("long").alias("doc_id"), "text"), models, parts)
    runs, items = fresh(rows, "runs"), fresh(rows, "items")
    found = found.where(F.size("hits") > 0).select(F.col("row").alias(row), F.col("hits").alias(runs), F.col("found").alias(items))
    columns = docs.columns
    wide = rows.join(found, row, "left").select(*[f"`{c}`" for c in columns], runs, items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in strides(batches):
            texts, told = raw(batch.column(batch.schema.get_field_index("text"))), [batch.column(batch.num_columns - i).to_pylist() for i in (2, 1)]
            hits = [(_marked(len(words_of(t)), r or []), set(i or ())) for t, r, i in zip(texts, *told)]
            yield _cleaned(batch.select(columns), hits, min_items, max_coverage)

    return wide.mapInArrow(run, docs.schema)
