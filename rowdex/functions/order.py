"""Seeded orders. They depend on lengths and seeds alone, never on rows, so each
is a list of ordinals that a plan joins. The draws are those of Python's own
generator: a given seed means one order everywhere."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def permutation(n: int, seed: int | None) -> np.ndarray:
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return np.array(order, np.int64)


def rolling_buffer(n: int, size: int, seed: int | None, start: int = 0) -> np.ndarray:
    """Emission order of a buffer that is filled, then replaced at random, then shuffled out."""
    draw, held, out = random.Random(seed), [], []
    for k in range(start, n):
        if len(held) < size:
            held.append(k)
            continue
        at = draw.randint(0, size - 1)
        out.append(held[at])
        held[at] = k
    draw.shuffle(held)
    return np.array(out + held, np.int64)


def block_order(groups: Sequence[Sequence[int]], files: Sequence[int], seed: int, window: int = 1) -> np.ndarray:
    """Rows shuffled inside row groups that are shuffled inside files that are
    shuffled; with one file, inside runs of ``window`` shuffled groups."""
    draw = random.Random(seed)
    names = list(dict.fromkeys(files))
    out: list[int] = []
    if len(names) > 1:
        draw.shuffle(names)
        for name in names:
            own = [list(g) for g, f in zip(groups, files, strict=True) if f == name]
            draw.shuffle(own)
            for rows in own:
                draw.shuffle(rows)
                out += rows
    else:
        own = [list(g) for g in groups]
        draw.shuffle(own)
        for k in range(0, len(own), window):
            rows = [r for g in own[k : k + window] for r in g]
            draw.shuffle(rows)
            out += rows
    return np.array(out, np.int64)


def file_order(files: Sequence[int], seed: int) -> list[int]:
    names = list(dict.fromkeys(files))
    if len(names) <= 1:
        return []
    random.Random(seed).shuffle(names)
    return names


def random_draws(n: int, seed: int | None, count: int | None = None, replacement: bool = False) -> np.ndarray:
    count = n if count is None else count
    if replacement:
        draw = random.Random(seed)
        return np.array([draw.randint(0, n - 1) for _ in range(count)], np.int64)
    return permutation(n, seed)[:count]


def distributed(order: np.ndarray, replicas: int, rank: int, drop_last: bool = False, whole: bool = False, pad: bool = True) -> np.ndarray:
    """The part of one rank. Ranks have equal lengths: the order is cut, or
    filled up with its own beginning, so that ranks may overlap (``pad``)."""
    n = len(order)
    each = n // replicas if drop_last or not pad else -(-n // replicas)
    if not pad and not drop_last:
        return order[rank::replicas]
    total = each * replicas
    order = np.resize(order, total) if total > n and n else order[:total]
    return order[rank * each : (rank + 1) * each] if whole else order[rank:total:replicas]


def batches(ordinals: Sequence[int], size: int, drop_last: bool = False) -> Iterator[list[int]]:
    if size <= 0:
        raise ValueError("batch_size must be positive")
    for k in range(0, len(ordinals), size):
        part = [int(x) for x in ordinals[k : k + size]]
        if len(part) == size or not drop_last:
            yield part


def hash_key(seed: int, pos: Column) -> Column:
    return F.xxhash64(F.lit(seed), pos)


def hash_shuffle(df: DataFrame, seed: int, pos: str = "pos", bits: int = 10) -> DataFrame:
    """``ord`` for data too long for a list on the driver: rows in order of a
    seeded hash. The order is cut into 2**bits ranges of the hash; each range is
    numbered by itself and starts where the ones before it end."""
    keyed = df.withColumn("__key", hash_key(seed, F.col(pos))).withColumn("__range", F.expr(f"shiftright(__key, {64 - bits})"))
    sizes = keyed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__range").orderBy("__key", pos)
    numbered = keyed.withColumn("__k", F.row_number().over(inside) - 1)
    # at most 2**bits rows
    return numbered.join(F.broadcast(starts), "__range").withColumn("ord", F.col("__start") + F.col("__k")).drop("__key", "__range", "__start", "__k")
