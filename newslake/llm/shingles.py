"""Hashed word shingles and MinHash minima of many texts at a time, in numpy."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_RNG = np.random.default_rng(20240131)
_LETTERS = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_PLACES = _RNG.integers(0, 1 << 63, WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at a time.
PIECE = 1 << 20
#: Shingles that meet in one run of the permutations.
RUN = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)
    return table(_STEP), table(_BACK)


_POWERS = _powers(PIECE + 1)


def word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of UTF-8 bytes; A-Z count as a-z, and space and \\t to \\r separate words."""
    low = text + ((text >= 65) & (text <= 90)).astype(np.uint8) * np.uint8(32)
    inside = np.empty(len(low) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = (low != 32) & ((low < 9) | (low > 13))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    up, down = _POWERS if len(low) <= PIECE else _powers(len(low) + 1)
    sums = np.zeros(len(low) + 1, dtype=np.uint64)
    np.cumsum(_LETTERS[low] * up[:len(low)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def batch_words(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text; texts meet in pieces of about ``PIECE`` bytes, and a longer text is cut between words."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    waiting: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if waiting:
            offsets = np.cumsum([0] + [len(t) + 1 for _, t in waiting])
            hashes, starts = word_hashes(np.frombuffer(b" ".join(t for _, t in waiting), dtype=np.uint8))
            cuts = np.searchsorted(starts, offsets)
            for k, (i, _) in enumerate(waiting):
                out[i].append(hashes[cuts[k]:cuts[k + 1]])
        waiting.clear()
        size = 0

    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = min(len(text), at + PIECE // 2)
            while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
                end += 1
            waiting.append((i, text[at:end]))
            size += end - at + 1
            at = end
            if size >= PIECE // 2:
                flush()
    flush()
    return [np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64) for parts in out]


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Distinct hashed shingles, sorted; fewer than ``WIDTH`` words make one, none make none."""
    if not len(words):
        return words
    n = max(1, len(words) - WIDTH + 1)
    sums = np.full(n, min(len(words), WIDTH), dtype=np.uint64)
    for k in range(min(WIDTH, len(words))):
        sums += words[k:k + n] * _PLACES[k]
    return np.unique(mix(sums))


class MinHash:
    """Minima of ``bands * rows`` permutations, and what the operators keep of them."""

    def __init__(self, bands: int, rows: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factors = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = rng.integers(0, 1 << 64, bands * rows, dtype=np.uint64)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row of minima per set; no set may be empty. Sets meet in runs, so that numpy works on long arrays."""
        out = np.full((len(sets), len(self.factors)), (1 << 64) - 1, dtype=np.uint64)
        at = 0
        while at < len(sets):
            end, size = at, 0
            while end < len(sets) and (end == at or size + len(sets[end]) <= RUN):
                size += len(sets[end])
                end += 1
            joined = np.concatenate(sets[at:end])
            offsets = np.cumsum([0] + [len(s) for s in sets[at:end - 1]])
            for k in range(len(self.factors)):
                out[at:end, k] = np.minimum.reduceat(joined * self.factors[k] + self.terms[k], offsets)
            at = end
        return out

    def band_keys(self, minima: np.ndarray) -> np.ndarray:
        """A row of one 63-bit key per band for each row of minima."""
        grouped = minima.reshape(len(minima), self.bands, self.rows)
        key = np.broadcast_to(np.arange(self.bands, dtype=np.uint64), grouped.shape[:2])
        for k in range(self.rows):
            key = mix(key * np.uint64(_STEP) + grouped[:, :, k])
        return (key >> np.uint64(1)).astype(np.int64)
