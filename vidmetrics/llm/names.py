"""Names of substrings: fixed-size numbers that equal strings share, from sums over a text that are made once."""

from __future__ import annotations

import numpy as np

GRAM = 8
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_BASES = (0x2545F4914F6CDD1D, 0x27D4EB2F165667C5)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Names:
    """96-bit names of the substrings (of at least ``GRAM`` bytes) of a buffer.

    A name is a polynomial in the scrambled 8-byte grams that start in the substring, modulo 2^64, in two
    bases, and its length. Prefix sums give any substring in constant time.
    """

    def __init__(self, data: bytes):
        raw = np.frombuffer(data, np.uint8)
        n = max(len(raw) - GRAM + 1, 0)
        gram = np.zeros(n, np.uint64)
        for k in range(GRAM):
            gram |= raw[k:k + n].astype(np.uint64) << np.uint64(8 * k)
        self.grams = mixed(gram + _FACTORS[0])
        self.sums, self.inverse = [], []
        for base, factor in zip(_BASES, _FACTORS):
            powers = np.full(n + 1, np.uint64(base), np.uint64)
            powers[0] = 1
            powers = np.cumprod(powers, dtype=np.uint64)
            back = np.full(n + 1, np.uint64(pow(base, -1, 1 << 64)), np.uint64)
            back[0] = 1
            self.inverse.append(np.cumprod(back, dtype=np.uint64))
            terms = (self.grams * factor if factor is not _FACTORS[0] else self.grams) * powers[:-1]
            self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)]))

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(long, int) names of the substrings [start, end)."""
        last = end - GRAM + 1
        first, second = ((s[last] - s[start]) * back[start] for s, back in zip(self.sums, self.inverse))
        size = (end - start).astype(np.uint64)
        return mixed(first + size).view(np.int64), (mixed(second + size) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each stretch of ``width`` values, by their upper 33 bits."""
    n = len(x)
    if n < width:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 31) - 1)
    keyed = (x & ~low) | np.arange(n, dtype=np.uint64)  # texts are below 2^31 bytes
    blocks = np.concatenate([keyed, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[: n - width + 1], left[width - 1:n]) & low).astype(np.int64)
