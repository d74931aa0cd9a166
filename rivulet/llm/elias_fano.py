"""Elias-Fano encoding of a non-decreasing sequence of integers."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQB")
#: One of this many set bits has its place stored, so that select reads a short stretch only.
SAMPLED = 128
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


class EliasFano:
    """n values up to ``top`` in about n * (2 + log2(top / n)) bits, and a quarter of a bit for select.

    The low bits of each value are packed side by side; its high part h is a set bit at place h + i of
    a bit vector. The place of every SAMPLED-th set bit is stored, in as few bytes as the vector's length
    needs. ``select`` finds the i-th set bit from a sampled place on; ``stretch`` reads all between two samples.
    """

    def __init__(self, n: int, top: int, low: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.top, self.low, self.lower, self.upper, self.samples = n, top, low, lower, upper, samples

    @classmethod
    def encode(cls, values) -> EliasFano:
        v = np.asarray(values, np.int64)
        if len(v) and (v[0] < 0 or (np.diff(v) < 0).any()):
            raise ValueError("values must be non-negative and must not decrease")
        n, top = len(v), int(v[-1]) if len(v) else 0
        low = max(0, (top // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low)) & 1).astype(np.uint8).ravel()
        length, _, kind = cls._sizes(n, top, low)
        upper, places = np.zeros(length, np.uint8), (v >> low) + np.arange(n)
        upper[places] = 1
        return cls(n, top, low, np.packbits(bits, bitorder="little"), np.packbits(upper, bitorder="little"), places[::SAMPLED].astype(kind))

    @staticmethod
    def _sizes(n: int, top: int, low: int) -> tuple[int, int, str]:
        """Bits of the upper vector, number of samples, and the type of one."""
        length = n + (top >> low) + 1 if n else 0
        return length, -(-n // SAMPLED), "<u2" if length <= 1 << 16 else "<u4" if length <= 1 << 32 else "<u8"

    def to_bytes(self) -> bytes:
        return _HEAD.pack(self.n, self.top, self.low) + self.samples.tobytes() + self.lower.tobytes() + self.upper.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at ``at``, and the place after it. Nothing is unpacked: its parts are views of ``raw``."""
        n, top, low = _HEAD.unpack_from(raw, at)
        at += _HEAD.size
        length, count, kind = cls._sizes(n, top, low)
        samples = np.frombuffer(raw, kind, count, at)
        at += samples.nbytes
        a, b = (n * low + 7) // 8, (length + 7) // 8
        return cls(n, top, low, np.frombuffer(raw, np.uint8, a, at), np.frombuffer(raw, np.uint8, b, at + a), samples), at + a + b

    def _lows(self, a: int, b: int) -> np.ndarray:
        """The low bits of the values from the a-th to before the b-th."""
        first = a * self.low
        bits = np.unpackbits(self.lower[first >> 3 : (b * self.low + 7) >> 3], bitorder="little")[first & 7 :][: (b - a) * self.low]
        return (bits.reshape(b - a, self.low).astype(np.int64) << np.arange(self.low)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        place, left = int(self.samples[i // SAMPLED]), i % SAMPLED
        byte = place >> 3
        left += int(_ONES[self.upper[byte] & ((1 << (place & 7)) - 1)])
        while left >= (ones := int(_ONES[self.upper[byte]])):
            left, byte = left - ones, byte + 1
        bits = np.flatnonzero(np.unpackbits(self.upper[byte : byte + 1], bitorder="little"))
        return (byte * 8 + int(bits[left]) - i) << self.low | int(self._lows(i, i + 1)[0])

    def stretch(self, k: int) -> np.ndarray:
        """The values of the k-th sample and those up to the next one: SAMPLED of them, or what is left."""
        a, b = k * SAMPLED, min(self.n, (k + 1) * SAMPLED)
        if not 0 <= a < self.n:
            raise IndexError(k)
        place = int(self.samples[k])
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else 8 * len(self.upper)
        bits = np.unpackbits(self.upper[place >> 3 : (end + 7) >> 3], bitorder="little")[place & 7 :]
        ones = np.flatnonzero(bits)[: b - a]
        return (ones + place - np.arange(a, b)) << self.low | self._lows(a, b)
