"""The pipeline's stage for similar texts against all pairs' Jaccard similarity."""

import itertools
import math
import random

import pytest

import corpus_pipeline
from keyloom.llm import simhash

from tests.llm.test_operators import DOCS, slow_fingerprint


def slow_set(text):
    ws = (text or "").lower().split()
    return {" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def slow_firsts(rows):
    """Places of the first row of each component, rows being (doc_id, text)."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    root = {i: i for i in order}
    sets = [slow_set(t) for _, t in rows]
    place = {i: n for n, i in enumerate(order)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(order, 2):
        both = len(sets[a] | sets[b])
        if not both or 5 * len(sets[a] & sets[b]) >= 4 * both:
            x, y = sorted((find(a), find(b)), key=place.get)
            root[y] = x
    return [i for i in order if find(i) == i]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("paired", [128, 3])
def test_similar_texts_beyond_four_bits_are_found(spark, sf, paired, monkeypatch):
    monkeypatch.setattr(simhash, "MAX_PAIRED", paired)
    rng, rows = random.Random(5), []
    for _ in range(10):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(9)):
                copy[rng.randrange(300)] = f"v{rng.randrange(5000)}"
            rows.append((len(rows) * 7 % 1000, " ".join(copy)))
    rows += [(1001, "a b c"), (1002, "A  b c"), (1003, "a b d"), (1004, ""), (1005, None), (1006, " ")]
    far = [(a, b) for a, b in itertools.combinations([t for _, t in rows[:80]], 2) if 5 * len(slow_set(a) & slow_set(b)) >= 4 * len(slow_set(a) | slow_set(b)) and bin(slow_fingerprint(a) ^ slow_fingerprint(b)).count("1") > 4]
    kept = {r["n_chars"] for r in corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), sf).collect()}
    assert far and kept == set(slow_firsts(rows))


@pytest.mark.parametrize("stage", [simhash.deduplicate, simhash.deduplicate_similar])
def test_unlike_rows_without_or_with_the_same_id_stay(spark, stage):
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(5)]
    # a copy of document 1 shares its doc_id 7 with another text, and comes with one of no doc_id
    rows = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (1, texts[3]), (None, texts[3]), (9, texts[4]), (9, texts[4])]
    kept = sorted(r["n_chars"] for r in stage(frame(spark, rows)).collect())
    assert kept in ([0, 1, 2, 4, 6], [0, 1, 2, 4, 7])


def test_lists_of_unlike_texts_are_split(spark, monkeypatch):
    """Texts that share most of their words with all others, and pairs among them that are similar."""
    monkeypatch.setattr(simhash, "MAX_PAIRED", 4)
    finer, split = [], simhash._finer
    monkeypatch.setattr(simhash, "_finer", lambda *x: finer.append(x[3]) or split(*x))
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(200)]
    rows = []
    for i in range(24):
        own = [f"o{rng.randrange(10**6)}" for _ in range(60)]
        rows.append((len(rows), " ".join(shared + own)))
        if i % 4 == 0:
            own[rng.randrange(60)] = "changed"
            rows.append((len(rows), " ".join(shared + own)))
    kept = {r["n_chars"] for r in simhash.deduplicate_similar(frame(spark, rows)).collect()}
    assert finer and kept == set(slow_firsts(rows))


def test_chance_of_a_miss():
    for level in range(4):
        wide, many = simhash.bands(level)
        assert (1 - 0.8**wide) ** many <= simhash.MISS < (1 - 0.8**wide) ** (many - 1)


def test_masks_lose_no_pair_of_four_bits():
    rng = random.Random(9)
    for _ in range(200):
        bits = sum(1 << b for b in rng.sample(range(64), 4))
        masks = [m for m in map(simhash._mask, simhash.TRIPLES) if not m & bits]
        assert masks
        while masks and bin(masks[0] & (1 << 64) - 1).count("1") < 60:
            masks = [m for m in simhash._narrower(masks[0]) if not m & bits]
            assert masks


def test_chance_that_minima_of_a_similar_pair_disagree():
    wide, many = simhash.bands(0)
    n = wide * many
    assert sum(math.comb(n, k) * 0.8**k * 0.2 ** (n - k) for k in range(simhash.LEAST_ALIKE)) < 1e-6


def unlike(rng, many, shared=160, own=25):
    """Texts that share most of their words, but are not similar, and one similar pair among them."""
    common, rows = [f"s{i}" for i in range(shared)], []
    for _ in range(many):
        rows.append((len(rows), " ".join(common + [f"o{rng.randrange(10**6)}" for _ in range(own)])))
    rows.append((len(rows), rows[-1][1].rsplit(" ", 1)[0] + " changed"))
    return rows


def test_sets_are_not_moved_for_each_pair(spark, monkeypatch):
    """Only pairs with the first text of a list are joined to their sets, so no more than a text has bands."""
    pairs, likely = [], simhash._likely
    monkeypatch.setattr(simhash, "_likely", lambda *x: pairs.append(likely(*x)) or pairs[-1])
    rows = unlike(random.Random(11), 120)
    kept = {r["n_chars"] for r in simhash.deduplicate_similar(frame(spark, rows)).collect()}
    assert kept == set(slow_firsts(rows)) and sum(p.count() for p in pairs) <= simhash.bands(0)[1] * len(rows)


@pytest.mark.parametrize("most", [1 << 21, 700, 1])
def test_blocks_of_a_list_meet(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_HASHES", most)
    rng = random.Random(12)
    rows = unlike(rng, 12)
    for at in (2, 5, 7, 12):
        rows.append((len(rows), "new " + rows[at][1]))
    kept = {r["n_chars"] for r in simhash.deduplicate_similar(frame(spark, rows)).collect()}
    assert kept == set(slow_firsts(rows)) and len(kept) == 12


def test_linked_fingerprints_are_candidates_of_their_own(spark, monkeypatch):
    """Without any candidate of MinHash, similar texts whose fingerprints link are met, and unlike ones that link stay."""
    monkeypatch.setattr(simhash, "_similar", lambda posts, docs, row, minima, known: known)
    rng, rows = random.Random(13), []
    while len(rows) < 8:
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        copy = " ".join([*words[:-1], "changed"])
        if bin(slow_fingerprint(" ".join(words)) ^ slow_fingerprint(copy)).count("1") <= 4:
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, copy)]
    # one shingle is over half of these two, so their fingerprints are equal
    rows += [(20, "x " * 60 + "a b c d e f g h"), (21, "x " * 60 + "i j k l m n o p"), (22, ""), (23, None)]
    assert slow_fingerprint(rows[8][1]) == slow_fingerprint(rows[9][1])
    kept = {r["n_chars"] for r in simhash.deduplicate_similar(frame(spark, rows)).collect()}
    assert kept == set(slow_firsts(rows)) and kept == {0, 2, 4, 6, 8, 9, 10}
