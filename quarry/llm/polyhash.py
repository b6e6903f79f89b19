"""Rabin-Karp hashes of substrings from prefix polynomials modulo 2^64 (numpy)."""

from __future__ import annotations

import numpy as np

from quarry.llm.shingles import mix


class Polynomial:
    """Substring hashes from prefix sums: ``sum(v[j] * base^j)``, shifted back by the inverse base."""

    def __init__(self, seed: int):
        self.base = int(mix(np.array([2 * seed + 1], np.uint64))[0]) | 1
        self.values = mix(np.arange(256, dtype=np.uint64) + np.uint64(1000 * seed + 1))
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, size: int) -> None:
        if self.up.size < size:
            size = max(size, 2 * self.up.size)
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers))

    def spans(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self.reach(values.size + 1)
        prefix = np.zeros(values.size + 1, np.uint64)
        np.cumsum(values * self.up[:values.size], out=prefix[1:])
        return (prefix[end] - prefix[start]) * self.down[start]

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.spans(self.values[data], start, end) + (end - start).astype(np.uint64))
