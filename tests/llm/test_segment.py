"""Segmentations against the SentencePiece library on a unigram model, and against the plain forward pass."""

import random
import struct

import numpy as np
import pytest

from keyloom.llm import pieces, segment


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, kind, value):
    return varint(number << 3 | kind) + (varint(len(value)) + value if kind == 2 else value if kind == 5 else varint(value))


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The given pieces with their log-probabilities as the file of a unigram model."""
    path = tmp_path_factory.mktemp("model") / "unigram.model"
    data = b"".join(
        field(1, 2, field(1, 2, p.text.encode()) + field(2, 5, struct.pack("<f", p.score)) + field(3, 0, p.kind)) for p in pieces.scored_pieces(pieces.model_path())
    )
    trainer = field(3, 0, 1) + field(35, 0, 1)
    normalizer = field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1)
    path.write_bytes(data + field(2, 2, trainer) + field(3, 2, normalizer))
    return str(path)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").orderBy("doc_id").limit(40).collect()
    rng = random.Random(21)
    return [r["text"][:400] for r in rows] + ["International organizations responded.", "a  b   c", "x\ny", "日本語 テキスト", "123 m². (x)", "".join(rng.choice("abc ,.é") for _ in range(300))]


def test_unigram_files_keep_their_scores(unigram):
    assert pieces.model_kind(unigram) == 1 and pieces.model_kind(pieces.model_path()) == 2
    assert [p.score for p in pieces.scored_pieces(unigram)] == pytest.approx([p.score for p in pieces.scored_pieces(pieces.model_path())], abs=1e-5)


def test_best_and_next_ones_equal_the_library_s(unigram, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=unigram)
    own = segment.Encoder(segment.Lattice(pieces.scored_pieces(unigram)), 4)
    value = [p.score for p in pieces.scored_pieces(unigram)]
    total = lambda ids: sum(value[i] for i in ids)
    equal = 0
    for text in texts:
        best, score, more = own.encode(text)
        ids = np.frombuffer(best, np.int32).tolist()
        theirs = library.encode(text)
        assert total(ids) == pytest.approx(total(theirs), abs=1e-2)
        equal += ids == theirs
        if all(p.kind != pieces.BYTE for p in map(own_piece(unigram), ids)):
            wanted = sorted(map(total, library.nbest_encode(text, nbest_size=4)), reverse=True)
            assert [score, *(s for s, _ in more)] == pytest.approx(wanted, abs=1e-2)
    # the others are ties
    assert equal >= 0.8 * len(texts)


def own_piece(path):
    return pieces.scored_pieces(path).__getitem__


def test_ranks_become_log_probabilities():
    scored = pieces.scored_pieces(pieces.model_path())
    plain = [p for p in scored if p.plain]
    assert sum(2.718281828 ** p.score for p in plain) == pytest.approx(1, abs=0.1)
    encoder = segment.Encoder(segment.Lattice(scored))
    best = encoder.encode("International organizations have responded to the crisis.")[0]
    assert [scored[i].text for i in np.frombuffer(best, np.int32)] == "▁International ▁organizations ▁have ▁responded ▁to ▁the ▁crisis .".split()


def test_parts_together_equal_parts_alone():
    lattice = segment.Lattice(pieces.scored_pieces(pieces.model_path()))
    rng = random.Random(22)
    parts = ["".join(rng.choice("abethinos ") for _ in range(rng.randrange(1, 40))) for _ in range(3000)] + [" \U0001f600", "é" * 9, "\x00", " 語語語"] * 9
    for part, (ids, score, loss) in zip(parts, lattice.all_best(parts)):
        assert (np.frombuffer(ids, np.int32).tolist(), score, loss) == lattice.best(part)


def test_memo_keeps_what_a_batch_needs(monkeypatch):
    monkeypatch.setattr(segment, "MEMO", 5)
    monkeypatch.setattr(segment, "STRIDE", 40)
    lattice = segment.Lattice(pieces.scored_pieces(pieces.model_path()))
    texts = ["one two three four five six seven eight nine ten", "", "one two", "x" * 200, "ten nine eight one"] * 3
    wanted = [segment.Encoder(lattice).encode(t) for t in texts]
    assert list(segment.Encoder(lattice).encode_all(texts)) == wanted


def test_cuts_are_the_expression_s_parts():
    lattice = segment.Lattice(pieces.scored_pieces(pieces.model_path()))
    rng = random.Random(23)
    texts = [" " + "".join(rng.choice("ab é²1_.\n\t▁語😀  ") for _ in range(rng.randrange(1, 60))).replace("▁", segment.OWN_MARK) for _ in range(500)]
    parts, firsts = lattice.cut(texts)
    assert [parts[a:b] for a, b in zip(firsts, [*firsts[1:], len(parts)])] == [lattice.part.findall(t) for t in texts]


def test_memo_keeps_frequent_parts_through_a_flood_of_rare_ones(monkeypatch):
    monkeypatch.setattr(segment, "MEMO", 40)
    lattice = segment.Lattice(pieces.scored_pieces(pieces.model_path()))
    memo, met = segment.Memo(lattice), []
    search = lattice.search
    monkeypatch.setattr(lattice, "search", lambda parts: met.extend(parts) or search(parts))
    often = [f" {a}{b}" for a in "abcd" for b in "efg"]
    for k in range(60):
        if k % 5 == 0:  # hits are halved whenever room is made
            memo.look_up(often * 20)
        rare = [f" {'xyzuv'[k % 5] * (k % 7 + 1)}{'qrst'[k // 7 % 4]}{a}" for a in "hijklmno"] + ["w" * (70 + k)]
        for part, at in zip(rare, memo.look_up(rare).tolist()):
            ids, score, loss = lattice.best(part)
            begin, size = memo.begin[at], memo.size[at]
            assert (memo.ids[begin : begin + size].tolist(), memo.score[at], memo.loss[at], memo.same[at]) == (ids, score, loss, True)
        assert len(memo.number) <= 41 and memo.begin[-1] + memo.size[-1] == len(memo.ids)
    memo.look_up(often)
    assert all(met.count(part) == 1 for part in often)
