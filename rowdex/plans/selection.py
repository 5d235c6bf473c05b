"""Selections: which positions a view shows, in which order. They combine on the
driver, before any plan is made, so a chain of views is one selection."""

from __future__ import annotations

import random
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np


def contiguous(length: int, shards: int, index: int) -> tuple[int, int]:
    """Start and end of a shard; the first ``length % shards`` have one row more."""
    size, more = divmod(length, shards)
    return index * size + min(index, more), (index + 1) * size + min(index + 1, more)


def check_shard(shards: int, index: int) -> None:
    if shards <= 0:
        raise ValueError("the number of shards must be positive")
    if not 0 <= index < shards:
        raise ValueError(f"shard {index} is out of range for {shards} shards")


@dataclass(frozen=True)
class Range:
    """Positions offset, offset + step, ... (length of them)."""

    offset: int
    length: int
    step: int = 1

    def __len__(self) -> int:
        return self.length

    def position(self, k: int) -> int:
        return self.offset + k * self.step

    def slice(self, start: int, stop: int, step: int = 1) -> Range:
        count = len(range(start, stop, step))
        return Range(self.position(start) if count else 0, count, self.step * step)

    def positions(self) -> np.ndarray:
        return self.offset + self.step * np.arange(self.length, dtype=np.int64)

    def pick(self, ordinals: Sequence[int] | np.ndarray) -> Perm:
        return Perm(self.offset + self.step * np.asarray(ordinals, np.int64))


@dataclass(frozen=True, eq=False)
class Perm:
    """Positions listed one by one; repeats allowed."""

    held: np.ndarray

    def __len__(self) -> int:
        return len(self.held)

    def position(self, k: int) -> int:
        return int(self.held[k])

    def slice(self, start: int, stop: int, step: int = 1) -> Perm:
        return Perm(self.held[np.arange(start, stop, step, dtype=np.int64)])

    def positions(self) -> np.ndarray:
        return self.held

    def pick(self, ordinals: Sequence[int] | np.ndarray) -> Perm:
        return Perm(self.held[np.asarray(ordinals, np.int64)])


def keyed(places: np.ndarray, n: int, keys: tuple[int, ...], back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 to n - 1, or its inverse, at some places: rounds
    that mix one half of the bits into the other, walked again from results that
    are n or more (fewer than four of five on average)."""
    half = max(1, ((max(1, n - 1)).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def walk(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for key in reversed(keys) if back else keys:
            mixed = ((left if back else right) + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed >> np.uint64(32)) & mask
            left, right = (right ^ mixed, left) if back else (right, left ^ mixed)
        return (left << np.uint64(half)) | right

    out = walk(np.asarray(places).astype(np.uint64))
    while len(far := np.flatnonzero(out >= n)):
        out[far] = walk(out[far])
    return out.astype(np.int64)


@dataclass(frozen=True)
class Keyed:
    """All positions of a range in a seeded order that is computed, not listed;
    of that order the ordinals of ``chosen``."""

    base: Range
    keys: tuple[int, ...]
    chosen: Range

    @classmethod
    def of(cls, base: Range, seed: int | None) -> Keyed:
        draw = random.Random(seed)
        return cls(base, tuple(draw.getrandbits(63) for _ in range(6)), Range(0, len(base)))

    def __len__(self) -> int:
        return len(self.chosen)

    def at(self, ordinals: np.ndarray) -> np.ndarray:
        places = self.chosen.offset + self.chosen.step * np.asarray(ordinals, np.int64)
        return self.base.offset + self.base.step * keyed(places, len(self.base), self.keys)

    def position(self, k: int) -> int:
        return int(self.at(np.array([k]))[0])

    def slice(self, start: int, stop: int, step: int = 1) -> Keyed:
        return Keyed(self.base, self.keys, self.chosen.slice(start, stop, step))

    def positions(self) -> np.ndarray:
        return self.at(np.arange(len(self)))

    def pick(self, ordinals: Sequence[int] | np.ndarray) -> Perm:
        return Perm(self.at(np.asarray(ordinals, np.int64)))

    def ordinals(self, positions: np.ndarray) -> np.ndarray:
        """The ordinal of each position, -1 where it has none."""
        out = np.full(len(positions), -1, np.int64)
        away = positions.astype(np.int64) - self.base.offset
        place = away // self.base.step
        inside = np.flatnonzero((away % self.base.step == 0) & (place >= 0) & (place < len(self.base)))
        found = keyed(place[inside], len(self.base), self.keys, back=True) - self.chosen.offset
        ordinal = found // self.chosen.step
        held = (found % self.chosen.step == 0) & (ordinal >= 0) & (ordinal < len(self.chosen))
        out[inside[held]] = ordinal[held]
        return out


Selection = Range | Perm | Keyed



def shard(selection: Selection, shards: int, index: int, whole: bool = False) -> Selection:
    """Every ``shards``-th row, or one unbroken part."""
    check_shard(shards, index)
    n = len(selection)
    return selection.slice(*contiguous(n, shards, index)) if whole else selection.slice(min(index, n), n, shards)
