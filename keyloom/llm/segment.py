"""SentencePiece encoding with the N best segmentations, and decoding.

A text gets a leading blank, blanks become the word mark, and its segmentations are the paths through the lattice
of all pieces that occur in it; a path's score is the sum of its pieces' log-probabilities (`pieces.scored_pieces`). A forward Viterbi pass gives the best
score from the start to every position. These scores are exact heuristics for an A* search backward from the end,
which so meets complete paths in the order of their scores and opens no other node than it must.

The lattice falls apart wherever no piece can cross: before blanks and between letters and other characters.
This is checked against the vocabulary; where it doesn't hold, coarser parts are taken, at worst the whole text. Parts
are searched on their own and remembered; new parts of a batch go through the forward pass together, as columns of arrays. The best
segmentation is read off the forward pass, which is the path that the search would meet first, and only parts with alternatives are searched.
The N best of the text are the N smallest sums of losses over its parts,
where only the N - 1 parts with the smallest losses can take a share.

Characters without a piece of their own are spelled in byte pieces, each such character at a score ten below that of any piece, as
is a word mark in the text itself, so decoding restores every text exactly.

Defined results: a null text has null ids, an empty one none; both have score 0 and no alternatives. Paths of
equal score come in a fixed order. Repeated rows each get a row. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STRIDE, map_columns
from .pieces import BYTE, MARK, Piece, model_path, scored_pieces

N_BEST, MEMO, LONG = 4, 200_000, 64
#: Stands for a word mark of the text itself; no text holds a lone surrogate.
OWN_MARK = "\ud800"
#: Runs of letters or of other characters, with the blanks before; the superscript two is the one other character that counts as a word's.
PARTS = (r" *[^\W\d_²]+| *(?:[^\w ]|[\d_²])+| +", r" *[^ ]+| +", r"(?s).+")
#: What of each of them is a run of one kind; blanks are another kind if they aren't in it, the rest is a third.
RUNS = (r"[^\W\d_²]+", r"[^ ]+", r"(?s).+")
#: Parts of up to so many characters are searched together, in blocks of so many.
WIDE, BLOCK = 32, 4096


class Lattice:
    """The pieces of a vocabulary, ready to segment parts of texts. Blanks stand for word marks."""

    def __init__(self, pieces: list[Piece]):
        plain = [(p.text.replace(MARK, " "), i, p.score) for i, p in enumerate(pieces) if p.plain]
        self.pieces = {text: (i, score) for text, i, score in plain if text}
        #: Id and score of each piece, and no id for what only starts a piece.
        self.prefixes: dict[str, tuple[int, float]] = {text[:end]: (-1, 0.0) for text in self.pieces for end in range(1, len(text))} | self.pieces
        self.bytes = {int(p.text[3:5], 16): i for i, p in enumerate(pieces) if p.kind == BYTE}
        #: Score of a character in byte pieces.
        self.byte_score = min((score for _, _, score in plain), default=0.0) - 10
        level = next(i for i, p in enumerate(PARTS) if all(re.findall(p, text) == [text] for text in self.pieces))
        self.part = re.compile(PARTS[level])
        self.kinds = np.full(0x110000, 2, dtype=np.uint8)
        self.kinds[ord(" ")] = 0
        for run in re.finditer(RUNS[level], np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")):
            self.kinds[run.start() : run.end()] = 1
        self._flatten()
        self.spelled = [p.text.replace(MARK, " ").encode() if p.plain else bytes([int(p.text[3:5], 16)]) if p.kind == BYTE else b"" for p in pieces]
        self.spelled_size = np.array([len(b) for b in self.spelled], dtype=np.int64)

    def _flatten(self) -> None:
        """The pieces as a trie in arrays: sorted keys of (state, class of the next character), and the states behind them."""
        number = {text: i for i, text in enumerate(self.prefixes, 1)} | {"": 0}
        letters = sorted({c for text in self.prefixes for c in text})
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.bits = len(letters).bit_length()
        keys = np.array([number[text[:-1]] << self.bits | int(self.classes[ord(text[-1])]) for text in self.prefixes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.to = np.append(keys[order], np.iinfo(np.int64).max), np.append(order + 1, 0).astype(np.int32)
        self.piece = np.array([-1, *(i for i, _ in self.prefixes.values())], dtype=np.int32)
        self.score = np.array([0.0, *(score for _, score in self.prefixes.values())])
        self.alone = np.array([False, *(c in self.pieces for c in letters)])

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The parts of all texts, which are those that `part` finds, and the number of each text's first one; no text is empty."""
        joined = "".join(texts)
        kind = self.kinds[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        firsts = np.cumsum(sizes) - sizes
        begins = np.concatenate(([False], (kind[1:] != kind[:-1]) & (kind[:-1] != 0)))
        begins[firsts] = True
        at = np.flatnonzero(begins)
        bounds = at.tolist()
        return [joined[a:b] for a, b in zip(bounds, [*bounds[1:], len(joined)])], np.searchsorted(at, firsts)

    def all_best(self, parts: list[str]) -> list[tuple[bytes, float, float]]:
        """For each part what `best` gives, with the ids as bytes."""
        order, ids, sizes, scores, losses = self.search(parts)
        out: list[tuple[bytes, float, float]] = [(b"", 0.0, 0.0)] * len(parts)
        data, ends = ids.tobytes(), np.cumsum(sizes)
        for at, a, b, score, loss in zip(order, ((ends - sizes) * 4).tolist(), (ends * 4).tolist(), scores.tolist(), losses.tolist()):
            out[at] = (data[a:b], score, loss)
        return out

    def search(self, parts: list[str]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What `best` gives for the parts, in an order of its own, which comes first: all ids, how many are a part's, scores, losses.

        Parts of one length are done together.
        """
        order: list[int] = []
        found: list[tuple[np.ndarray, ...]] = []
        alone: list[int] = []
        groups: dict[int, list[int]] = {}
        for at, part in enumerate(parts):
            groups.setdefault(len(part), []).append(at)
        for length, members in groups.items():
            if length > WIDE or len(members) < 8:
                alone += members
                continue
            for begin in range(0, len(members), BLOCK):
                some = members[begin : begin + BLOCK]
                points = np.frombuffer("".join([parts[at] for at in some]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
                classes = self.classes[points].reshape(-1, length)
                whole = self.alone[classes].all(axis=1)
                order += np.array(some)[whole].tolist()
                alone += np.array(some)[~whole].tolist()
                found.append(self._together(classes[whole].T.copy()))
        each = [self.best(parts[at]) for at in alone]
        found.append((np.array([i for ids, _, _ in each for i in ids], dtype=np.int32), *(np.array(x, dtype=kind) for x, kind in (([len(ids) for ids, _, _ in each], np.int64), ([e[1] for e in each], float), ([e[2] for e in each], float)))))
        return order + alone, *(np.concatenate(x) for x in zip(*found))

    def _together(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """`search` for the columns of classes, of characters that all have pieces of their own."""
        n, m = classes.shape
        first, second = np.full((n + 1, m), -np.inf), np.full((n + 1, m), -np.inf)
        start, piece = np.zeros((n + 1, m), dtype=np.int32), np.zeros((n + 1, m), dtype=np.int32)
        first[0] = 0.0
        every = np.arange(m)
        for at in range(n):
            rows, state = every, np.zeros(m, dtype=np.int64)
            for end in range(at + 1, n + 1):
                key = state << self.bits | classes[end - 1, rows]
                found = np.searchsorted(self.keys, key)
                known = self.keys[found] == key
                rows, state = rows[known], self.to[found[known]].astype(np.int64)
                if not len(rows):
                    break
                has = self.piece[state] >= 0
                r, s = rows[has], state[has]
                score = self.score[s]
                whole, other = first[at, r] + score, second[at, r] + score
                f = first[end, r]
                better = whole >= f
                second[end, r] = np.where(better, np.maximum(f, other), np.maximum(second[end, r], whole))
                b = r[better]
                first[end, b] = whole[better]
                start[end, b] = at
                piece[end, b] = self.piece[s[better]]
        ids, filled = np.zeros((m, n), dtype=np.int32), np.full(m, n)
        rows, at = every, np.full(m, n)
        while len(rows):
            filled[rows] -= 1
            ids[rows, filled[rows]] = piece[at, rows]
            at = start[at, rows]
            rows, at = rows[at > 0], at[at > 0]
        return ids[np.arange(n) >= filled[:, None]], n - filled, first[n], first[n] - second[n]

    def _ending(self, part: str) -> tuple[list[list[tuple[int, float, tuple[int, ...]]]], list[float]]:
        """Edges (start, score, ids) into each position, and Viterbi scores."""
        n, prefixes = len(part), self.prefixes
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        best = [-math.inf] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            here = best[at]
            for end in range(at + 1, n + 1):
                found = prefixes.get(part[at:end])
                if found is None:
                    break
                if found[0] >= 0:
                    into[end].append((at, found[1], (found[0],)))
                    if here + found[1] >= best[end]:
                        best[end] = here + found[1]
            if part[at] not in self.pieces:
                c = MARK if part[at] == OWN_MARK else part[at]
                ids = tuple(self.bytes[b] for b in c.encode())
                into[at + 1].append((at, self.byte_score, ids))
                best[at + 1] = max(best[at + 1], here + self.byte_score)
        return into, best

    def best(self, part: str) -> tuple[list[int], float, float]:
        """The ids that n_best puts first, their score, and the loss of the second best, in one forward pass."""
        n, get = len(part), self.prefixes.get
        first, second = [-math.inf] * (n + 1), [-math.inf] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        first[0] = 0.0
        for at in range(n):
            here, next_ = first[at], second[at]
            for end in range(at + 1, n + 1):
                found = get(part[at:end])
                if found is None:
                    break
                piece, score = found
                if piece >= 0:
                    whole = here + score
                    if whole >= first[end]:
                        other = next_ + score
                        second[end] = first[end] if first[end] > other else other
                        first[end] = whole
                        back[end] = (at, piece)
                    elif whole > second[end]:
                        second[end] = whole
            c = part[at]
            if c not in self.pieces:
                score = self.byte_score
                if here + score >= first[at + 1]:
                    second[at + 1] = max(first[at + 1], next_ + score)
                    first[at + 1] = here + score
                    back[at + 1] = (at, -1)
                else:
                    second[at + 1] = max(second[at + 1], here + score)
        ids: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                ids.append(piece)
            else:
                c = MARK if part[start] == OWN_MARK else part[start]
                ids.extend(self.bytes[b] for b in reversed(c.encode()))
            at = start
        ids.reverse()
        return ids, first[n], first[n] - second[n]

    def n_best(self, part: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of a part, as (score, ids), best first."""
        into, best = self._ending(part)
        # entries: minus the score of the best path through here, newest first among equals, position, score behind it, ids behind it
        agenda: list[tuple[float, int, int, float, tuple | None]] = [(-best[-1], 0, len(part), 0.0, None)]
        out, tick = [], 0
        while agenda and len(out) < n:
            _, _, at, behind, tail = heapq.heappop(agenda)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    head, tail = tail
                    ids.extend(head)
                out.append((behind, tuple(ids)))
                continue
            for start, score, ids_ in into[at]:
                tick -= 1
                total = behind + score
                heapq.heappush(agenda, (-(best[start] + total), tick, start, total, (ids_, tail)))
        return out


class Memo:
    """Parts by number, with their best ids, the ids' number and score, the loss of the second best, and whether the ids spell the part, in arrays.

    When it is full, the parts at hand and those that were met most often stay, up to half of it, and the rest is forgotten.
    """

    def __init__(self, lattice: Lattice):
        self.lattice, self.number = lattice, {}
        self.long: list[str] = []
        self.size, self.begin, self.hits = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.score, self.loss, self.same, self.ids = np.zeros(0), np.zeros(0), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int32)

    def look_up(self, parts: list[str]) -> np.ndarray:
        """The numbers of the parts, which hold until the next call. Those too long to be remembered are forgotten then."""
        if self.long:
            for part in self.long:
                del self.number[part]
            self._keep(np.arange(len(self.number)))
            self.long = []
        at = np.fromiter(map(self.number.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = list(dict.fromkeys(map(parts.__getitem__, missing.tolist())))
            if len(self.number) + len(new) > MEMO and self.number:
                at = self._forget(at)
            self._learn([part for part in new if len(part) <= LONG])
            self.long = [part for part in new if len(part) > LONG]
            self._learn(self.long)
            at[missing] = [self.number[parts[m]] for m in missing.tolist()]
        self.hits += np.bincount(at, minlength=len(self.hits))
        return at

    def _learn(self, parts: list[str]) -> None:
        if not parts:
            return
        order, ids, size, score, loss = self.lattice.search(parts)
        parts = list(map(parts.__getitem__, order))
        self.number.update(zip(parts, range(len(self.number), len(self.number) + len(parts))))
        begin = np.cumsum(size) - size
        told = np.add.reduceat(self.lattice.spelled_size[ids], begin)
        meant = "".join(parts).replace(OWN_MARK, MARK).encode()
        lengths = np.fromiter((len(part.encode("utf-8", "surrogatepass")) for part in parts), dtype=np.int64, count=len(parts))
        same = told == lengths
        if not same.all() or b"".join(map(self.lattice.spelled.__getitem__, ids.tolist())) != meant:
            spelled = (b"".join(map(self.lattice.spelled.__getitem__, ids[a : a + n].tolist())) for a, n in zip(begin.tolist(), size.tolist()))
            same = np.array([b == part.replace(OWN_MARK, MARK).encode() for b, part in zip(spelled, parts)])
        for name, more in (("begin", begin + len(self.ids)), ("ids", ids), ("size", size), ("score", score), ("loss", loss), ("same", same), ("hits", np.zeros(len(parts), dtype=np.int64))):
            setattr(self, name, np.concatenate((getattr(self, name), more)))

    def _forget(self, at: np.ndarray) -> np.ndarray:
        """Makes room; the new numbers of the parts that have one."""
        used = np.zeros(len(self.number), dtype=bool)
        used[at[at >= 0]] = True
        room = max(0, MEMO // 2 - int(used.sum()))
        others = np.flatnonzero(~used)
        used[others[np.argsort(-self.hits[others], kind="stable")[:room]]] = True
        kept, parts = np.flatnonzero(used), list(self.number)
        self.number = dict(zip(map(parts.__getitem__, kept.tolist()), range(len(kept))))
        self._keep(kept)
        self.hits >>= 1
        return np.where(at >= 0, (np.cumsum(used) - 1)[at], -1)

    def _keep(self, kept: np.ndarray) -> None:
        size = self.size[kept]
        begin = np.cumsum(size) - size
        self.ids = self.ids[np.arange(size.sum()) + np.repeat(self.begin[kept] - begin, size)]
        self.size, self.begin = size, begin
        self.score, self.loss, self.same, self.hits = self.score[kept], self.loss[kept], self.same[kept], self.hits[kept]


class Encoder:
    def __init__(self, lattice: Lattice, n_best: int = N_BEST):
        self.lattice, self.n, self.memo = lattice, n_best, Memo(lattice)
        self.others: dict[str, list[tuple[float, tuple[int, ...]]]] = {}

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]]:
        """For each text its best ids as bytes, their score, and the alternatives as (score, edits); an edit is (at, length, ids).

        The parts of about `STRIDE` characters of texts are cut out and met together.
        """
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= STRIDE):
                size += len(texts[end])
                end += 1
            ids, counts, scores, others, _ = self.encode_stride(texts[at:end])
            data, ends = ids.tobytes(), np.cumsum(counts) * 4
            for a, b, score, more in zip((ends - counts * 4).tolist(), ends.tolist(), scores.tolist(), others):
                yield data[a:b], score, more
            at = end

    def encode(self, text: str) -> tuple[bytes, float, list[tuple[float, list[tuple[int, int, tuple[int, ...]]]]]]:
        return next(self.encode_all([text]))

    def encode_stride(self, texts: list[str]):
        """The best ids of all texts in one array, how many each has, scores, alternatives as in `encode_all`, and whether the ids spell the text."""
        full = np.flatnonzero([bool(text) for text in texts])
        counts, scores, same = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        others: list[list] = [[] for _ in texts]
        if not len(full):
            return np.zeros(0, dtype=np.int32), counts, scores, others, same
        parts, firsts = self.lattice.cut([" " + texts[at].replace(MARK, OWN_MARK) for at in full.tolist()])
        memo = self.memo
        at = memo.look_up(parts)
        size, loss, best = memo.size[at], memo.loss[at], memo.score[at]
        before = np.concatenate(([0], np.cumsum(size)))
        ids = memo.ids[np.arange(before[-1]) + np.repeat(memo.begin[at] - before[:-1], size)]
        counts[full] = np.add.reduceat(size, firsts)
        scores[full] = np.add.reduceat(best, firsts)
        same[full] = np.logical_and.reduceat(memo.same[at], firsts)
        open_ = np.add.reduceat(np.isfinite(loss), firsts, dtype=np.int64).tolist()
        if self.n > 1:
            for row, a, b, n in zip(full.tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(parts)], open_):
                others[row] = self._alternatives(parts, loss, best, before, ids, a, b, n, float(scores[row]))
        return ids, counts, scores, others, same

    def _alternatives(self, parts: list[str], losses: np.ndarray, best: np.ndarray, before: np.ndarray, ids: np.ndarray, a: int, b: int, n: int, score: float):
        """Of the text that has the parts from a to b, n of which have alternatives."""
        more, loss = self.n - 1, losses[a:b]
        if n > more:
            bound = np.partition(loss, more - 1)[more - 1]
            below, equal = np.flatnonzero(loss < bound).tolist(), np.flatnonzero(loss == bound).tolist()
            chosen = below + equal[: more - len(below)]
        else:
            chosen = np.flatnonzero(np.isfinite(loss)).tolist()
        sums: list[tuple[float, tuple]] = [(0.0, ())]
        for at in map(a.__add__, chosen):
            ways = self._others(parts[at], ids[before[at] : before[at + 1]], best[at])
            grown = sums + [(s + lost, (*picks, (at, put))) for s, picks in sums for lost, put in ways]
            sums = heapq.nsmallest(self.n, grown, key=lambda x: x[0])
        return [(score - lost, [(int(before[at] - before[a]), int(before[at + 1] - before[at]), put) for at, put in sorted(picks)]) for lost, picks in sums[1:]]

    def _others(self, part: str, ids: np.ndarray, score: float) -> list[tuple[float, tuple[int, ...]]]:
        """The n - 1 best segmentations of a part next to its best one, each with its loss."""
        ways = self.others.get(part)
        if ways is None:
            best = tuple(ids.tolist())
            ways = [(float(score - s), put) for s, put in self.lattice.n_best(part, self.n) if put != best][: self.n - 1]
            if len(part) <= LONG:
                if len(self.others) >= MEMO // 20:
                    self.others.clear()
                self.others[part] = ways
        return ways

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.lattice.spelled.__getitem__, ids)).decode("utf-8", "replace")[1:]


#: The worker's encoder, kept with its memo from task to task.
_KEPT: dict[tuple[str, int], Encoder] = {}


def kept_encoder(path: str, n_best: int, read: Callable[[], list[Piece]]) -> Encoder:
    if (path, n_best) not in _KEPT:
        _KEPT.clear()
        _KEPT[path, n_best] = Encoder(Lattice(read()), n_best)
    return _KEPT[path, n_best]


EDITS = pa.list_(pa.struct([("at", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))]))
ALTERNATIVES = pa.list_(pa.struct([("score", pa.float64()), ("edits", EDITS)]))


def _offsets(sizes) -> pa.Array:
    return pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))).astype(np.int32))


def _arrow(others: list[list]) -> pa.Array:
    """The alternatives of texts as a column."""
    ways = [way for more in others for way in more]
    edits = [edit for _, edits in ways for edit in edits]
    puts = pa.ListArray.from_arrays(_offsets([len(put) for _, _, put in edits]), pa.array([i for _, _, put in edits for i in put], pa.int32()))
    flat = [pa.array([e[0] for e in edits], pa.int32()), pa.array([e[1] for e in edits], pa.int32()), puts]
    told = pa.ListArray.from_arrays(_offsets([len(edits) for _, edits in ways]), pa.StructArray.from_arrays(flat, ["at", "length", "ids"]))
    scored = pa.StructArray.from_arrays([pa.array([score for score, _ in ways], pa.float64()), told], ["score", "edits"])
    return pa.ListArray.from_arrays(_offsets([len(more) for more in others]), scored).cast(ALTERNATIVES)


SCHEMA = (
    "doc_id long, n_pieces long, score double, ids array<int>, "
    "alternatives array<struct<score: double, edits: array<struct<at: int, length: int, ids: array<int>>>>>, restored boolean"
)


def encode(docs: DataFrame, n_best: int = N_BEST, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_pieces, score, ids, alternatives, restored.

    ids is the best segmentation. The next n_best - 1 follow in alternatives, each with its score and what it puts
    in the place of which pieces of the best one. restored tells that decoding gives back the text.
    """
    file = path or model_path()
    shared = docs.sparkSession.sparkContext.broadcast(scored_pieces(file))

    def make():
        encoder = kept_encoder(file, n_best, lambda: shared.value)

        def work(batch: pa.RecordBatch):
            texts = batch.column(1).to_pylist()
            ids, counts, scores, others, same = encoder.encode_stride([t or "" for t in texts])
            ends = np.cumsum(counts)
            for at in np.flatnonzero(~same).tolist():
                same[at] = encoder.decode(ids[ends[at] - counts[at] : ends[at]].tolist()) == texts[at]
            lists = pa.ListArray.from_arrays(_offsets(counts), pa.array(ids), mask=batch.column(1).is_null() if batch.column(1).null_count else None)
            return {
                "doc_id": batch.column(0),
                "n_pieces": counts,
                "score": pa.array(scores, pa.float64()),
                "ids": lists,
                "alternatives": _arrow(others),
                "restored": pa.array(same, pa.bool_()),
            }

        return work

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), SCHEMA, make, in_strides=True)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of the rows (doc_id, ids); null ids give a null text."""
    file = path or model_path()
    shared = encoded.sparkSession.sparkContext.broadcast(scored_pieces(file))

    def make():
        encoder = kept_encoder(file, N_BEST, lambda: shared.value)

        def work(batch: pa.RecordBatch):
            texts = [None if ids is None else encoder.decode(ids) for ids in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "text": pa.array(texts, pa.string())}

        return work

    return map_columns(encoded.select("doc_id", "ids"), "doc_id long, text string", make)
