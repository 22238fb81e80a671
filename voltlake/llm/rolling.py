"""Karp-Rabin hashes modulo 2^64 of runs of an array, from sums weighted with powers of a base."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_tables[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(1 << n.bit_length(), base, np.uint64)
            steps[0] = 1
            _tables[k] = np.cumprod(steps, dtype=np.uint64)
    return _tables[0], _tables[1]


class Running:
    """Hashes of the runs of an array, of whatever length."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * up[: len(values)], out=self.sums[1:])

    def hashes(self, length: int) -> np.ndarray:
        """Of every run of ``length`` values."""
        n = max(0, len(self.sums) - length)
        return (self.sums[length:] - self.sums[:n]) * self.down[:n] if n else np.empty(0, np.uint64)

    def between(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the runs from ``start`` up to ``end``."""
        return (self.sums[end] - self.sums[start]) * self.down[start]
