"""64-bit hashes of all words of a buffer at once, in numpy."""

from __future__ import annotations

import numpy as np


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Ranges:
    """Hashes of many ranges of a sequence at once: differences of prefix sums of a polynomial modulo
    2^64, shifted back by the inverse power of the odd base."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.zeros(0, np.uint64)

    def __call__(self, values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        if len(values) >= len(self.up):  # one more: an empty range may start behind the last value
            self.up, self.down = powers(self.base, len(values) + 1), powers(self.inverse, len(values) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[:len(values)], dtype=np.uint64)])
        return mix((total[stop] - total[start]) * self.down[start])


_bytes = Ranges(0x9E3779B97F4A7C15)


def words(buf: bytes, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, hashes and lengths of the runs of bytes b with part[b] == 0."""
    return runs(buf, part, None)


def runs(buf: bytes, part: np.ndarray, opens: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As words(); a byte marked in opens begins a run of its own inside another."""
    a = np.frombuffer(buf, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], part[a] == 0, [False]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    if opens is not None and len(inner := np.setdiff1d(np.flatnonzero(opens), start, assume_unique=True)):
        start, stop = np.union1d(start, inner), np.union1d(stop, inner)
    return start, _bytes(a.astype(np.uint64) + np.uint64(1), start, stop), stop - start
