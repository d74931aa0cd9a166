"""Hashes of words and sets of word shingles, computed for a whole text at once."""

from __future__ import annotations

import numpy as np

from rivulet.llm.common import pieces

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, x in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text whose A-Z are lower-cased."""
    out = []
    for piece in pieces(text.encode("utf-8", "surrogatepass").lower()) if text else ():
        b = np.frombuffer(piece, np.uint8)
        blank = np.ones(len(b) + 2, np.int8)
        blank[1:-1] = (b == 32) | ((b >= 9) & (b <= 13))
        turns = np.diff(blank)
        starts, ends = np.flatnonzero(turns == -1), np.flatnonzero(turns == 1)
        powers, inverse = _grown(len(b))
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * inverse[: len(b)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * powers[starts] + (ends - starts).astype(np.uint64)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct ``size``-word shingles; of fewer words the whole sequence, of none nothing."""
    words = word_hashes(text)
    if not len(words):
        return words
    k = min(size, len(words))
    total = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        total = mix(total + words[i : len(words) - k + 1 + i])
    return np.unique(mix(total + np.uint64(k)))
