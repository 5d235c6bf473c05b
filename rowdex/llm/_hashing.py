"""Polynomial hashes of byte ranges, modulo 2**64, on numpy arrays.

The hash of a range is a difference of running sums divided by a power of the
base, which is odd and so has an inverse. Powers are held for one segment; those
of whole segments are found when they are needed.
"""

from __future__ import annotations

import numpy as np

SEGMENT = 1 << 16
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)


def powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(count - 1, base, np.uint64)], dtype=np.uint64)


UP, DOWN = powers(BASE, SEGMENT), powers(UNBASE, SEGMENT)


def up(count: int) -> np.ndarray:
    """The base to the powers 0 to count - 1."""
    far = [np.uint64(pow(BASE, s, 1 << 64)) for s in range(0, count, SEGMENT)]
    return (UP[None, :] * np.array(far, np.uint64)[:, None]).reshape(-1)[:count] if count else UP[:0]


def down(at: np.ndarray) -> np.ndarray:
    """The inverse base to the powers ``at``."""
    high = np.unique(at // SEGMENT)
    far = np.array([pow(UNBASE, int(s) * SEGMENT, 1 << 64) for s in high], np.uint64)
    return DOWN[at % SEGMENT] * far[np.searchsorted(high, at // SEGMENT)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the word; changes ``x`` in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
