"""Anchors of fixed-length byte strings and hashes of their surroundings, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from newslake.llm.shingles import _BACK, _LETTERS, _STEP, mix

#: Length of the strings that are looked for, and of the grams that anchor them.
LENGTH, GRAM = 200, 32
#: Grams in a string; the least hash among them, leftmost at ties, is its anchor.
SPAN = LENGTH - GRAM + 1
#: Bits of a place within a piece.
_BITS = 20
PIECE = (1 << _BITS) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_STEP, PIECE + 2), _powers(_BACK, PIECE + 2)


class Piece:
    """Bytes with prefix sums, so that any substring's hash takes constant time."""

    def __init__(self, text: bytes) -> None:
        raw = np.frombuffer(text, dtype=np.uint8)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_LETTERS[raw] * _UP[:len(raw)], dtype=np.uint64, out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Joined texts of at most ``PIECE`` bytes with (text, place in the piece, offset in the text, length) of each part.

    A text that is longer than a piece is cut into parts that overlap by less than one string.
    """
    parts, size, joined = [], 0, []
    for i, text in enumerate(texts):
        at = 0
        while len(text) - at >= LENGTH:
            part = text[at:at + PIECE]
            if size + len(part) > PIECE:
                yield b"".join(joined), parts
                parts, size, joined = [], 0, []
            parts.append((i, size, at, len(part)))
            joined.append(part)
            size += len(part)
            at += len(part) - LENGTH + 1
    if parts:
        yield b"".join(joined), parts


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window, from running minima of blocks in both directions."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(-1, width)
    forth = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], forth[width - 1:width - 1 + n])


def runs(texts: list[bytes]) -> Iterator[tuple[Piece, dict[str, np.ndarray]]]:
    """Runs of starts that share an anchor, per piece.

    Columns: text, shift (offset in the text minus place in the piece), anchor, first, last (places in the piece) and gram
    (hash of the anchor's bytes). Every start of a string of ``LENGTH`` bytes lies in exactly one run.
    """
    for joined, parts in pieces(texts):
        piece = Piece(joined)
        ends = np.arange(GRAM, len(joined) + 1)
        grams = piece.hashes(ends - GRAM, ends)
        packed = (grams & ~np.uint64(PIECE)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (_least(packed, SPAN) & np.uint64(PIECE)).astype(np.int64)
        owner = np.full(len(anchor), -1, dtype=np.int64)
        for k, (_, at, _, length) in enumerate(parts):
            owner[at:at + length - LENGTH + 1] = k
        change = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]))
        last = np.append(change[1:], len(anchor)) - 1
        held = owner[change] >= 0
        first, last, k = change[held], last[held], owner[change][held]
        table = np.array(parts, dtype=np.int64)
        yield piece, {"text": table[k, 0], "shift": table[k, 2] - table[k, 1], "anchor": anchor[first], "first": first, "last": last,
                      "gram": grams[anchor[first]]}
