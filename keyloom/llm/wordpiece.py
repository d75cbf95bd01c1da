"""Token counts by greedy longest match, with a linear-time automaton.

Words `[^\\x20\\x09-\\x0D]+` are cut greedily from the left into the longest pieces of a vocabulary that has pieces
for the start of a word and others for its continuation. The automaton is the trie of all pieces with failure
links: when the trie has no edge for the next character, the failure link leads to the node that stands for the
text left after the longest match was taken, and a precomputed number says how many pieces were popped on the
way. A word is so measured in one pass, and no piece is ever built. A word that can't be cut counts as
one unknown token.

The vocabulary is read from a SentencePiece model file: pieces behind the word mark start words, the other ones
continue them; control, unknown and byte pieces and pieces with a mark inside are left out.

Defined results: a null or empty text, or one of blanks, has no words and no tokens. Repeated rows each get
a row. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, raw
from .pieces import MARK, model_path, read_pieces

#: Words whose counts a task remembers at once.
MEMO = 300_000


def vocabulary(path: str | None = None) -> tuple[list[str], list[str]]:
    """Pieces that start words and pieces that continue them."""
    plain = [p.text for p in read_pieces(path or model_path()) if p.plain]
    return [p[1:] for p in plain if p[0] == MARK and MARK not in p[1:] and len(p) > 1], [p for p in plain if MARK not in p]


class Automaton:
    """Trie with failure links; `walk` gives the number of pieces of a word, 0 if it can't be cut."""

    ROOT, REST = 0, 1

    def __init__(self, starts: list[str], rests: list[str]):
        self.edges: list[dict[str, int]] = [{}, {}]
        piece = [False, False]
        self.parent: list[tuple[int, str]] = [(-1, ""), (-1, "")]
        for root, words in ((self.ROOT, starts), (self.REST, rests)):
            for word in words:
                at = root
                for c in word:
                    if c not in self.edges[at]:
                        self.edges[at][c] = len(self.edges)
                        self.edges.append({})
                        piece.append(False)
                        self.parent.append((at, c))
                    at = self.edges[at][c]
                piece[at] = True
        #: Where the rest after the longest match stands, and how many pieces were popped; -1: nothing matches.
        self.fail, self.popped = [-1] * len(piece), [0] * len(piece)
        level = [*self.edges[0].values(), *self.edges[1].values()]
        while level:
            for v in level:
                up, c = self.parent[v]
                if piece[v]:
                    self.fail[v], self.popped[v] = self.REST, 1
                    continue
                z, n = self.fail[up], self.popped[up]
                while z >= 0 and c not in self.edges[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.edges[z][c], n
            level = [w for v in level for w in self.edges[v].values()]

    def walk(self, word: str) -> int:
        edges, fail, popped = self.edges, self.fail, self.popped
        at, n = self.ROOT, 0
        for c in word:
            to = edges[at].get(c)
            while to is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 0
                to = edges[at].get(c)
            at = to
        while at != self.REST:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 0
        return n


class Memo(dict):
    """Word to number of pieces, 0 for unknown.

    When it is full, its entries become the older generation, from which those in use come back, and the rest is forgotten.
    """

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.older = automaton, {}

    def __missing__(self, word: bytes) -> int:
        n = self.older.get(word)
        if n is None:
            n = self.automaton.walk(word.decode())
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n


#: The worker's memo, kept from task to task.
_KEPT: dict[str, Memo] = {}


def kept_memo(path: str, read: Callable[[], tuple[list[str], list[str]]]) -> Memo:
    if path not in _KEPT:
        _KEPT.clear()
        _KEPT[path] = Memo(Automaton(*read()))
    return _KEPT[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_tokens (an unknown word is one token), n_unknown."""
    file = path or model_path()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(file))

    def make():
        memo = kept_memo(file, lambda: shared.value)

        def work(batch: pa.RecordBatch):
            rows = np.zeros((batch.num_rows, 3), dtype=np.int64)
            for row, text in zip(rows, raw(batch.column(1))):
                if text:
                    counts = list(map(memo.__getitem__, text.split()))
                    unknown = counts.count(0)
                    row[:] = len(counts), sum(counts) + unknown, unknown
            return {"doc_id": batch.column(0)} | dict(zip(("n_words", "n_tokens", "n_unknown"), rows.T.copy()))

        return work

    return map_columns(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, n_words long, n_tokens long, n_unknown long", make)
