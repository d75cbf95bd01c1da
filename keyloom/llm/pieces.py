"""Reads the pieces of a SentencePiece model file, without any library but the standard one."""

from __future__ import annotations

import math
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

MARK = "▁"
FOLDER = "/opt/tokenizers"

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


UNIGRAM = 1
#: Scores are rounded to multiples of this, so that their sums are exact and equal paths tie in any order.
GRAIN = 2.0**-20
#: What is added to a rank in the law of Zipf and Mandelbrot.
SHIFT = 2.7


@dataclass(frozen=True)
class Piece:
    text: str
    score: float
    kind: int

    @property
    def plain(self) -> bool:
        return self.kind in (NORMAL, USER)


def model_path(folder: str = FOLDER, name: str = "piece_bpe_32k.model") -> str:
    return os.path.join(folder, name)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            size = varint()
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def scored_pieces(path: str) -> list[Piece]:
    """All pieces with log-probabilities as scores.

    A unigram model has them. Any other one has the ranks of its merges, whose sums mean nothing; tokenizers are not
    trained here, so a rank becomes the log-probability that the law of Zipf and Mandelbrot gives it.
    """
    pieces = read_pieces(path)
    if model_kind(path) == UNIGRAM:
        return [replace(p, score=round(p.score / GRAIN) * GRAIN) for p in pieces]
    last = sum(p.plain for p in pieces)
    total = sum(1 / (rank + SHIFT) for rank in range(last + 1))
    law = lambda score: -math.log((min(-score, last) + SHIFT) * total)
    return [replace(p, score=round(law(p.score) / GRAIN) * GRAIN) if p.plain else p for p in pieces]


def model_kind(path: str) -> int:
    """The model's type, by the file's record of its training: 1 unigram, 2 byte-pair encoding."""
    with open(path, "rb") as file:
        trainer = next((value for field, value in _fields(file.read()) if field == 2), b"")
    return dict(_fields(trainer)).get(3, UNIGRAM)


def read_pieces(path: str) -> list[Piece]:
    """All pieces of the model; a piece's place is its id."""
    with open(path, "rb") as file:
        data = file.read()
    out = []
    for field, value in _fields(data):
        if field == 1:
            parts = dict(_fields(value))
            score = struct.unpack("<f", parts[2])[0] if 2 in parts else 0.0
            out.append(Piece(parts.get(1, b"").decode(), score, parts.get(3, NORMAL)))
    return out
