"""Word shingle sets and their MinHash minima."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from slotledger.llm.arrays import Words, mix

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of ``size`` words.

    A text with fewer words has its whole sequence as its one shingle; one without words has none.
    """
    words = Words(column)
    h = words.hashes()
    rolled = h.copy()
    for k in range(1, size):
        rolled[: len(h) - k] = mix(rolled[: len(h) - k]) + h[k:] * _ODD
    rolled = mix(rolled)
    for begin, end in zip(words.first[:-1], words.first[1:], strict=True):
        count = end - begin
        if count >= size:
            found = np.sort(rolled[begin : end - size + 1])
            keep = np.empty(len(found), dtype=bool)
            keep[:1] = True
            np.not_equal(found[1:], found[:-1], out=keep[1:])
            yield found[keep]
        elif count:
            whole = h[begin : begin + 1].copy()
            for k in range(begin + 1, end):
                whole = mix(whole) + h[k : k + 1] * _ODD
            yield mix(whole ^ _U(count))
        else:
            yield h[:0]


class MinHasher:
    """``count`` minima over random permutations of 32-bit values, the same on every machine."""

    def __init__(self, count: int, seed: int = 1, chunk: int = 16_384):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.flips = rng.integers(0, 1 << 32, (count, 1), dtype=np.uint32)
        self.factors = rng.integers(0, 1 << 32, (count, 1), dtype=np.uint32) | np.uint32(1)
        self.chunk = chunk

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        low = (shingles >> _U(32)).astype(np.uint32)
        best = np.full(len(self.flips), 0xFFFFFFFF, dtype=np.uint32)
        for begin in range(0, len(low), self.chunk):
            values = low[begin : begin + self.chunk] ^ self.flips
            values *= self.factors
            np.minimum(best, values.min(axis=1), out=best)
        return best


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` minima; the band's number is part of the key."""
    table = minima.reshape(bands, rows).astype(_U)
    key = np.arange(1, bands + 1, dtype=_U) * _ODD
    for k in range(rows):
        key = mix(key ^ table[:, k]) + _ODD
    return mix(key)


def packed_bits(minima: np.ndarray, bits: int) -> bytes:
    """The low ``bits`` (1, 2, 4 or 8) of all minima, packed."""
    low = (minima & np.uint32((1 << bits) - 1)).astype(np.uint8)
    per = 8 // bits
    table = np.pad(low, (0, -len(low) % per)).reshape(-1, per)
    return (table << (np.arange(per, dtype=np.uint8) * np.uint8(bits))).sum(axis=1, dtype=np.uint8).tobytes()
