"""SimHash near-duplicate detection over a byte-position inverted index.

A text is lower-cased (A-Z) and cut into the words `[^\\x20\\x09-\\x0D]+`; its features are all shingles of four
words, repeats included, space-joined. A fingerprint bit is 1 if it is set in over half of the shingles' XXH64
values (seed 42). Documents link at `max_bits` = 4 or fewer differing bits; linked ones form components.

Candidate search: two fingerprints that differ in at most 4 bits agree in at least 4 of their 8 positional
bytes. The index therefore posts each distinct fingerprint under 20 triples of byte positions, chosen so that any
4 positions include one triple (a Turan design); a posting list holds the fingerprints that agree in these
three bytes. Within a list, shared positional bytes are tallied per pair, pairs below the guaranteed 4 are
dropped, the rest verified bit by bit. Lists longer than `max_list` are not compared but split, as often as it takes: first by
a fourth byte, then by fifths of the bits that are still free, which again loses no pair, as 4 bits can't differ in all five. Lists give the edges of a spanning
forest, not all pairs, and only distinct fingerprints are indexed, so copies of one text cost nothing.

`deduplicate_similar`, the pipeline's stage, links texts by content instead: two texts are similar if their sets of
five-word shingles have a Jaccard similarity of 0.8 or more. Copies, up to case and blanks, are met first. Of the
distinct texts, those whose fingerprints link by the index above are compared, and what is similar joins. As at 0.8 fingerprints are mostly over 4 bits
apart, MinHash finds the rest: candidates share one of 20 bands of 4 MinHash values each, which a pair at 0.8 misses with a
chance of 3 in 100,000; those that the fingerprints have joined are not compared again. Of a candidate pair the lowest bytes of its 80 minima are compared first: at 0.8 fewer than `LEAST_ALIKE` agree
with a chance below one in a million. The sets of all other pairs are compared. In each band's list all texts are compared to the first.
Where this leaves several components in a list of at most `MAX_PAIRED` texts, the pairs of unlike components are compared within a task, each
pair in the first of its lists. First the minima of the list's texts are brought together, which names the texts that may have a similar one; of these
alone the sets follow, each once a list and not once a pair. Where they are more than `MAX_HASHES` hashes, they are cut into blocks, and any two blocks meet.
A longer list is split by bands of its own, of twice, three times ... as many further minima, and so many more of them that the chance
of a miss stays, until its parts are short. So no group's pairs are ever laid out.

Defined results: a null or empty text, or one of blanks, has fingerprint zero and links like any other; a text of
fewer than four words has one shingle, itself. A null doc_id never names a component unless the component
has no other; repeated rows each get a row. The deduplicating functions number the rows, so rows that share a doc_id or have none
are told apart. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_columns, numbered, raw

SEED, SHINGLE, MAX_BITS, MAX_LIST = 42, 4, 4, 4096
#: Similar texts: words in a shingle, minima in a band, chance that a pair at 0.8 is missed; texts of a list whose pairs are compared; hashes of a block of their sets; row numbers that are broadcast at most.
LONG_SHINGLE, BAND, MISS, MAX_PAIRED, MAX_HASHES, MAX_BROADCAST = 5, 4, 4e-5, 1 << 16, 1 << 21, 1 << 20
#: Of the minima of the first bands, how many must agree in their lowest byte before two texts' sets are compared.
LEAST_ALIKE = 45


def _triples() -> list[tuple[int, ...]]:
    """The fewest triples of 8 positions such that any 4 positions include one: Turan's design with three groups."""
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    inside = [t for g in groups for t in combinations(g, 3)]
    across = [(*two, one) for i, g in enumerate(groups) for two in combinations(g, 2) for one in groups[(i + 1) % 3]]
    return [tuple(sorted(t)) for t in inside + across]


TRIPLES = _triples()


def _shingles(words: list[bytes], size: int) -> np.ndarray:
    """The hashes of all shingles of some words, repeats included; fewer words than `size` are one shingle."""
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-size] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], dtype=np.uint64)


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else []
    return _majority(_shingles(words, SHINGLE)) if words else 0


#: The lowest bit of each byte lane.
LANES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; byte lanes are summed in blocks of 255, which can't overflow."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)
    padded[: len(hashes)] = hashes
    fp = 0
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & LANES).reshape(-1, 255).sum(axis=1)
        for byte, count in enumerate(lanes.view(np.uint8).reshape(-1, 8).sum(axis=0).tolist()):
            if count * 2 > len(hashes):
                fp |= 1 << (8 * byte + bit)
    return fp


def fingerprints(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, any columns to keep, and `fp`, the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", *keep)

    def make():
        def work(batch: pa.RecordBatch):
            fps = np.array([fingerprint(t) for t in raw(batch.column(1))], dtype=np.uint64).view(np.int64)
            return {"fp": fps} | {n: batch.column(i) for i, n in enumerate(batch.schema.names) if n != "text"}

        return work

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return map_columns(rows, f"{kinds}, fp long", make)


def _mask(positions: tuple[int, ...]) -> int:
    """The bits of some bytes, as a signed long."""
    mask = sum(0xFF << 8 * at for at in positions)
    return mask - (1 << 64) if mask >> 63 else mask


FOURS: dict[int, list[int]] = {_mask(t): [_mask((*t, more)) for more in range(8) if more not in t] for t in TRIPLES}


def _narrower(mask: int) -> list[int]:
    """The masks by which a list that agrees in the bits of one mask is split: with a fourth byte, or a fifth of the free bits."""
    if mask in FOURS:
        return FOURS[mask]
    free = [b for b in range(64) if not mask >> b & 1]
    fifths = [sum(1 << b for b in free[i * len(free) // 5 : (i + 1) * len(free) // 5]) | mask for i in range(5)]
    return [m - (1 << 64) if m >> 63 & 1 and m > 0 else m for m in fifths]


def _post(fps: DataFrame) -> DataFrame:
    """Posting lists as rows (key, mask, fp): key stands for the mask and the bits of fp in it."""
    masks = F.explode(F.array(*[F.lit(_mask(t)).cast("long") for t in TRIPLES])).alias("mask")
    return _keyed(fps.select(masks, "fp"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "mask", "fp")


def _split(late: DataFrame) -> DataFrame:
    """Posting lists of the rows (mask, fp) of lists that were too long."""

    def make():
        known: dict[int, list[int]] = {}

        def work(batch: pa.RecordBatch):
            masks, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out = []
            for mask in np.unique(masks).tolist():
                some = fps[masks == mask]
                out += [(np.full(len(some), m), some) for m in known.setdefault(mask, _narrower(mask))]
            both = [np.concatenate(x) for x in zip(*out)] or [np.empty(0, np.int64)] * 2
            return {"mask": pa.array(both[0], pa.int64()), "fp": pa.array(both[1], pa.int64())}

        return work

    return _keyed(map_columns(late, "mask long, fp long", make).distinct())


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tallies shared positional bytes, keeps pairs with the guaranteed number, and verifies these."""
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    return (shared >= 8 - MAX_BITS) & (np.bitwise_count(differ) <= MAX_BITS)


def _forest(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges of a spanning forest of the links within one posting list, breadth first."""
    edges, open_ = [], np.arange(len(fps))
    while len(open_):
        front, open_ = [open_[0]], open_[1:]
        while front and len(open_):
            at = front.pop()
            near = _near(fps[open_], np.broadcast_to(fps[at], len(open_)))
            if near.any():
                new = open_[near]
                edges.append((np.full(len(new), fps[at]), fps[new]))
                front.extend(new.tolist())
                open_ = open_[~near]
    return edges


def _compare(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, mask, fp) sorted by key and mask in; edges (a, b) out, and (mask, fp) of lists over the limit with `late` set.

    A list that agrees in all but 4 bits has at most 16 fingerprints, so the limit is never less.
    """
    limit = max(limit, 16)

    def rows(a, b, late):
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(len(a), late))], names=["a", "b", "late"])

    def lists(k: np.ndarray, m: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(k):
            return
        starts = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (m[1:] != m[:-1]))))
        sizes = np.diff(np.concatenate((starts, [len(k)])))
        number = np.repeat(np.arange(len(sizes)), sizes)
        short = np.repeat(sizes <= 32, sizes)
        ns, fs = number[short], f[short]
        for step in range(1, int(sizes[sizes <= 32].max(initial=0))):
            pair = np.flatnonzero(ns[step:] == ns[:-step])
            pair = pair[_near(fs[pair], fs[pair + step])]
            yield from rows(fs[pair].view(np.int64), fs[pair + step].view(np.int64), False)
        for at, size in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
            if size > limit:
                yield from rows(m[at : at + size], f[at : at + size].view(np.int64), True)
            elif edges := _forest(f[at : at + size]):
                a, b = (np.concatenate(x) for x in zip(*edges))
                yield from rows(a.view(np.int64), b.view(np.int64), False)

    held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
    over: tuple[int, int] | None = None  # key and mask of the list that is being passed on
    for batch in batches:
        k, m, f = (np.concatenate((h, batch.column(i).to_numpy().view(h.dtype))) for i, h in enumerate(held))
        if over is not None:
            rest = int((~((k == over[0]) & (m == over[1]))).argmax()) if ((k != over[0]) | (m != over[1])).any() else len(k)
            yield from rows(m[:rest], f[:rest].view(np.int64), True)
            k, m, f = k[rest:], m[rest:], f[rest:]
            over = over if not len(k) else None
        if len(k):
            cut = int(((k == k[-1]) & (m == m[-1])).argmax())
            yield from lists(k[:cut], m[:cut], f[:cut])
            k, m, f = k[cut:], m[cut:], f[cut:]
            if len(k) > limit:
                over = int(k[0]), int(m[0])
                yield from rows(m, f.view(np.int64), True)
                k, m, f = k[:0], m[:0], f[:0]
        held = [k, m, f]
    yield from lists(*held)


def links(fps: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that span every component of links."""
    found, posts = None, _post(fps)
    while True:
        sorted_ = posts.repartition("key").sortWithinPartitions("key", "mask")
        out = durable(sorted_.mapInArrow(lambda batches: _compare(batches, max_list), "a long, b long, late boolean"))
        edges = out.where("NOT late").select("a", "b")
        found = edges if found is None else found.unionByName(edges)
        late = out.where("late")
        if late.isEmpty():
            return found.where("a <> b").distinct()
        posts = _split(late.select(F.col("a").alias("mask"), F.col("b").alias("fp")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node in reach.

    Large-star and small-star steps in turn until nothing changes. Neighbours are never gathered: each step is a
    minimum per node, pre-aggregated, and a join.
    """
    rows = durable(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.col("m").alias("v"))
        rows = durable(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(rows.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return rows.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(rows.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _rooted(rows: DataFrame, max_list: int) -> DataFrame:
    """(fp, first, root) of every fingerprint in rows (doc_id, fp): its smallest doc_id, and its component's smallest fingerprint."""
    fps = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(fps.select("fp"), max_list))
    return durable(fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))


def classes(rows: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """(fp, component_id) of every fingerprint in rows (doc_id, fp)."""
    rooted = _rooted(rows, max_list)
    return rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id in reach)."""
    rows = durable(fingerprints(docs))
    named = rows.join(classes(rows, max_list), "fp")
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, max_list: int = MAX_LIST) -> DataFrame:
    """docs, all columns kept, with one row of each component of links: its smallest doc_id, then its first row."""
    docs, row = numbered(docs)
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(row).alias("row"))
    rows = durable(fingerprints(narrow, "row"))
    roots = rows.join(_rooted(rows, max_list), "fp").select("row", "doc_id", "root")
    return _one_each(docs, row, roots).select(*[f"`{c}`" for c in docs.columns if c != row])


def bands(level: int) -> tuple[int, int]:
    """Minima in a band, and bands, with which a pair at 0.8 is missed with a chance of at most `MISS`."""
    wide = BAND * (level + 1)
    return wide, math.ceil(math.log(MISS) / math.log(1 - 0.8**wide))


@cache
def _factors(level: int) -> np.ndarray:
    """One linear function of a shingle's hash for each minimum."""
    wide, many = bands(level)
    return np.random.default_rng([SEED, level]).integers(1 << 64, size=(2, wide * many), dtype=np.uint64) | np.array([[1], [0]], dtype=np.uint64)


def _sketch(text: bytes | None, level: int = 0) -> tuple[bytes, list[int], bytes, int]:
    """A digest of the text's words, the keys of its bands, the lowest bytes of its minima, and its number of hashes; a text without words has no bands."""
    words = text.lower().split() if text else []
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    if not words:
        return digest, [], b"", 0
    (wide, many), (factors, terms) = bands(level), _factors(level)
    hashes, low = np.unique(_shingles(words, LONG_SHINGLE)), np.full(wide * many, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 512):
        low = np.minimum(low, (hashes[at : at + 512, None] * factors + terms).min(axis=0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(low.reshape(many, wide))]
    return digest, np.array(keys, dtype=np.uint64).view(np.int64).tolist(), (low & np.uint64(0xFF)).astype(np.uint8).tobytes(), len(hashes)


def _of_rows(docs: DataFrame, row: str, rows: DataFrame, how: str) -> DataFrame:
    """docs semi- or anti-joined to row numbers (column row), without a shuffle of the texts if these are few."""
    few = rows.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    numbers = rows.select(F.col("row").alias(row))
    return docs.join(F.broadcast(numbers) if few else numbers, row, how)


def _likely(pairs: DataFrame, minima: DataFrame) -> DataFrame:
    """The pairs (a, b) of row numbers whose minima (row, marks) agree often enough; only these have their sets moved."""
    both = pairs.join(minima.select(F.col("row").alias("a"), F.col("marks").alias("x")), "a")
    both = both.join(minima.select(F.col("row").alias("b"), F.col("marks").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= LEAST_ALIKE))

    return durable(both.mapInArrow(run, "a long, b long"))


def _verified(pairs: DataFrame, docs: DataFrame, row: str, minima: DataFrame) -> DataFrame:
    """The pairs (a, b) of row numbers whose texts' shingle sets are similar."""
    pairs = _likely(pairs, minima)
    sets = _sets(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))), docs, row)
    both = pairs.join(sets.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a")
    both = both.join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")
    # common / (x + y - common) >= 4/5
    return durable(both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def _sets(rows: DataFrame, docs: DataFrame, row: str) -> DataFrame:
    """(row, hashes) of the texts of some row numbers (column row), which may repeat: their shingle sets."""

    def make():
        def work(batch: pa.RecordBatch):
            words = [t.lower().split() if t else [] for t in raw(batch.column(1))]
            sets = [np.unique(_shingles(w, LONG_SHINGLE)).view(np.int64) if w else np.empty(0, np.int64) for w in words]
            return {"row": batch.column(0), "hashes": pa.array(sets, pa.list_(pa.int64()))}

        return work

    wanted = durable(rows.distinct())
    return durable(map_columns(_of_rows(docs.select(row, "text"), row, wanted, "left_semi"), "row long, hashes array<long>", make, in_strides=True))


def _groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows that agree in some columns of longs, across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(name).to_numpy() for name in by])
        starts = np.flatnonzero(np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0))))
        for at, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
            now = tuple(keys[:, at].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


class _List:
    """Texts of one list: their row numbers, components, sizes, minima and band keys."""

    def __init__(self, table: pa.Table):
        self.row, self.label, self.size = (table[name].to_numpy().copy() for name in ("row", "root", "size"))
        n, self.top = len(self.row), table["top"][0].as_py()
        #: In a meeting of two blocks, which of them each text is in.
        self.block = table["of"].to_numpy() if "of" in table.column_names else np.zeros(n, dtype=np.int64)
        self.across = bool((self.block != self.block[0]).any())
        self.marks = np.frombuffer(b"".join(table["marks"].to_pylist()), dtype=np.uint8).reshape(n, -1)
        self.keys = table["keys"].combine_chunks().flatten().to_numpy().reshape(n, -1)

    def pivots(self) -> list[int]:
        """The texts outside the largest component: every pair of unlike components has one of them."""
        names, number, sizes = np.unique(self.label, return_inverse=True, return_counts=True)
        return np.flatnonzero(number != sizes.argmax()).tolist()

    def partners(self, at: int) -> np.ndarray:
        """The texts of other components that may be similar to one text, where this is the first list of both."""
        size = self.size[at]
        found = np.flatnonzero((self.label != self.label[at]) & (5 * np.minimum(self.size, size) >= 4 * np.maximum(self.size, size)))
        if self.across:
            found = found[self.block[found] != self.block[at]]
        found = found[(self.marks[found] == self.marks[at]).sum(axis=1) >= LEAST_ALIKE]
        same = self.keys[found] == self.keys[at]
        return found[same.any(axis=1) & (self.keys[at][same.argmax(axis=1)] == self.top)]


def _meetings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """(key, blocks, of, row) of the texts of each list that may be similar to one of another component: of two blocks, and which of them the text is in."""
    for table in _groups(batches, ("key",)):
        texts = _List(table)
        some = np.zeros(len(texts.row), dtype=bool)
        for at in texts.pivots():
            if len(found := texts.partners(at)):
                some[at] = some[found] = True
        rows = texts.row[some]
        if not len(rows):
            continue
        block = (np.cumsum(texts.size[some]) - 1) // most
        block = np.unique(block, return_inverse=True)[1]
        key = table["key"][0].as_py()
        for a, b in combinations_with_replacement(range(int(block.max()) + 1), 2):
            inside = (block == a) | (block == b)
            pair = np.full((2, int(inside.sum())), [[key], [a << 31 | b]])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*pair, block[inside], rows[inside])], names=["key", "blocks", "of", "row"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between similar texts that join the components of two blocks of a list."""
    for table in _groups(batches, ("key", "blocks")):
        texts = _List(table)
        hashes = table["hashes"].combine_chunks()
        starts = np.concatenate(([0], np.cumsum(texts.size)))
        number = np.unique(hashes.flatten().to_numpy(), return_inverse=True)[1]
        own = np.zeros(len(number), dtype=bool)
        edges: list[tuple[int, int]] = []
        for at in texts.pivots():
            found = texts.partners(at)
            if not len(found):
                continue
            mine = number[starts[at] : starts[at + 1]]
            own[mine] = True
            sizes = texts.size[found]
            ahead = np.cumsum(sizes) - sizes
            common = np.add.reduceat(own[number[np.repeat(starts[found] - ahead, sizes) + np.arange(sizes.sum())]], ahead, dtype=np.int64)
            own[mine] = False
            # common / (x + y - common) >= 4/5
            near = found[9 * common >= 4 * (sizes + texts.size[at])]
            labels, first = np.unique(texts.label[near], return_index=True)
            edges += [(int(texts.row[at]), int(texts.row[b])) for b in near[first]]
            texts.label[np.isin(texts.label, labels)] = texts.label[at]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*edges)], names=["a", "b"])


def _joined(lists: DataFrame, docs: DataFrame, row: str, minima: DataFrame) -> DataFrame:
    """Edges (a, b) between similar texts of unlike components in the lists (key, top, row, root)."""
    facts = durable(lists.join(minima, "row").select("key", "top", "row", "root", "size", "marks", "keys"))
    most = MAX_HASHES
    by_list = facts.repartition("key").sortWithinPartitions("key")
    meetings = durable(by_list.mapInArrow(lambda batches: _meetings(batches, most), "key long, blocks long, of long, row long"))
    sets = _sets(meetings.select("row"), docs, row)
    met = meetings.join(facts, ["key", "row"]).join(sets, "row").repartition("key", "blocks").sortWithinPartitions("key", "blocks")
    return durable(met.mapInArrow(_met, "a long, b long"))


def _linked(fps: DataFrame, docs: DataFrame, row: str, minima: DataFrame) -> DataFrame:
    """Edges (a, b) between similar texts whose fingerprints (row, fp) are equal or link."""
    first = durable(fps.groupBy("fp").agg(F.min("row").alias("low")))
    equal = fps.join(first, "fp").where("row <> low").select(F.col("low").alias("a"), F.col("row").alias("b"))
    edges = links(first.select("fp"))
    near = edges.join(first.select(F.col("fp").alias("a"), F.col("low").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("low").alias("y")), "b")
    pairs = equal.unionByName(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return _verified(durable(pairs.distinct()), docs, row, minima)


def _apart(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """The pairs (a, b) that the edges don't join."""
    of = components(edges)
    both = pairs.join(of.select(F.col("node").alias("a"), F.col("root").alias("x")), "a", "left").join(of.select(F.col("node").alias("b"), F.col("root").alias("y")), "b", "left")
    return durable(both.where(F.coalesce("x", "a") != F.coalesce("y", "b")).select("a", "b"))


def _similar(posts: DataFrame, docs: DataFrame, row: str, minima: DataFrame, known: DataFrame, level: int = 0) -> DataFrame:
    """Edges (a, b) that span the components of similar texts, known ones included; posts has each text's band keys, at first and now, and row number."""
    ends = durable(posts.groupBy("key").agg(F.min("row").alias("low"), F.max("row").alias("high")).where("low <> high"))
    lists = durable(posts.join(ends, "key").select("key", "top", "row", "low"))
    first = durable(lists.where("row <> low").select(F.col("low").alias("a"), F.col("row").alias("b")).distinct())
    edges = known.unionByName(_verified(_apart(first, known), docs, row, minima))
    named = lists.select("key", "top", "row").join(components(edges).withColumnRenamed("node", "row"), "row", "left")
    named = durable(named.select("key", "top", "row", F.coalesce("root", "row").alias("root")))
    mixed = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high")
    left = durable(named.join(mixed.select("key", "n"), "key"))
    edges = edges.unionByName(_joined(left.where(F.col("n") <= MAX_PAIRED).drop("n"), docs, row, minima))
    long = left.where(F.col("n") > MAX_PAIRED).select("key", "top", "row")
    return edges if long.isEmpty() else _similar(_finer(long, docs, row, level + 1), docs, row, minima, edges, level + 1)


def _finer(lists: DataFrame, docs: DataFrame, row: str, level: int) -> DataFrame:
    """The lists (key, top, row), each split by the next level's bands of its texts."""

    def make():
        def work(batch: pa.RecordBatch):
            keys = [_sketch(t, level)[1] for t in raw(batch.column(1))]
            return {"row": batch.column(0), "finer": pa.array(keys, pa.list_(pa.int64()))}

        return work

    texts = _of_rows(docs.select(row, "text"), row, durable(lists.select("row").distinct()), "left_semi")
    finer = durable(map_columns(texts, "row long, finer array<long>", make, in_strides=True))
    both = lists.join(finer, "row").select("key", "top", "row", F.explode("finer").alias("finer"))
    return durable(both.select(F.xxhash64("key", "finer").alias("key"), "top", "row"))


def _one_each(docs: DataFrame, row: str, roots: DataFrame) -> DataFrame:
    """docs with one row of each component in roots (row, doc_id, root): its smallest doc_id, then its first row."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    best = roots.groupBy("root").agg(F.min(order)["row"].alias("best"))
    return _of_rows(docs, row, durable(roots.join(best, "root").where("row <> best").select("row")), "left_anti").drop(row)


def deduplicate_similar(docs: DataFrame) -> DataFrame:
    """docs, all columns kept, with one row of each component of similar texts: its smallest doc_id, then its first row."""
    docs, row = numbered(docs)

    def make():
        def work(batch: pa.RecordBatch):
            found = [_sketch(t) for t in raw(batch.column(2))]
            return {"row": batch.column(0), "doc_id": batch.column(1), "digest": pa.array([f[0] for f in found], pa.binary()), "keys": pa.array([f[1] for f in found], pa.list_(pa.int64())), "marks": pa.array([f[2] for f in found], pa.binary()), "size": pa.array([f[3] for f in found], pa.int64()), "fp": np.array([fingerprint(t) for t in raw(batch.column(2))], dtype=np.uint64).view(np.int64)}

        return work

    rows = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = durable(map_columns(rows, "row long, doc_id long, digest binary, keys array<long>, marks binary, size long, fp long", make, in_strides=True))
    texts = rows.groupBy("digest").agg(F.min("row").alias("node"))
    copies = durable(rows.select("row", "doc_id", "digest").join(texts, "digest").select("row", "doc_id", "node"))
    own, minima = rows.join(copies.where("row = node").select("row"), "row", "left_semi"), rows.select("row", "marks", "keys", "size")
    # a text without words has no set and only copies
    near = _linked(durable(own.where("size > 0").select("row", "fp")), docs, row, minima)
    posts = own.select(F.explode("keys").alias("key"), "row").withColumn("top", F.col("key"))
    linked = components(_similar(posts, docs, row, minima, near))
    return _one_each(docs, row, copies.join(linked, "node", "left").select("row", "doc_id", F.coalesce("root", "node").alias("root"))).select(*[f"`{c}`" for c in docs.columns if c != row])
