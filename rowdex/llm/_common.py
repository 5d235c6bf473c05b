"""Things several operators share: staging in the shared folder, readers, hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdex.session import staging_path

#: The 26 ASCII capitals and what they become. Other letters keep their case.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SMALL = "abcdefghijklmnopqrstuvwxyz"


def give_back() -> None:
    """Returns free memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not every C library has it
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task that leaves no free memory behind:
    Python workers outlive tasks, and idle ones count against an executor."""

    @wraps(run)
    def call(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return call


def staged(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: later steps neither
    repeat its work nor lose it with an executor. batch_rows: rows of an Arrow
    batch in this job, fewer where rows carry whole texts."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if batch_rows is not None:
        spark.conf.set(key, batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. ``lower`` does that by itself on text without other
    bytes, and takes a fast path there; elsewhere it would change more letters."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, CAPITALS, SMALL)
    )


def id_crc(doc_id: Column) -> Column:
    """Unsigned crc32 of the id's decimal text (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def named(name: str) -> Column:
    """A column by its whole name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until it is not among ``taken``."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of ``df`` as one struct: beside it an operator's own columns
    cannot clash with theirs."""
    return F.struct(*[named(c) for c in df.columns]).alias(name)


class BitFilter:
    """A set of long hashes as a bitmap of fixed size, kept as a table of words.

    It may accept a value that was never put in, and never refuses one that was.
    Its size has a bound whatever goes in (``2**bits / 64`` rows of 16 bytes: at
    the default 2**22 bits, 65,536 rows and 1 MB), so it can be broadcast.
    """

    #: The most bits that ``sized`` takes: a million words, 16 MB.
    MOST_BITS = 26

    def __init__(self, hashes: DataFrame, column: str, bits: int = 22):
        slot = F.col(column).bitwiseAND((1 << bits) - 1)
        self.bits = bits
        self.words = (
            hashes.select(
                F.shiftright(slot, 6).alias("__word"),
                F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))").alias("__mask"),
            )
            .groupBy("__word")
            .agg(F.bit_or("__mask").alias("__mask"))
        )

    @classmethod
    def sized(cls, hashes: DataFrame, column: str) -> BitFilter:
        """About 16 bits for each hash, within bounds; beyond them it accepts more."""
        return cls(hashes, column, min(cls.MOST_BITS, max(16, (16 * hashes.count()).bit_length())))

    def keep(self, df: DataFrame, column: str) -> DataFrame:
        """The rows of ``df`` whose hash may be in the set; no shuffle of ``df``."""
        return self.mark(df, column, "inner").filter("__maybe").drop("__maybe")

    def mark(self, df: DataFrame, column: str, how: str = "left") -> DataFrame:
        """Adds ``__maybe``: whether the hash may be in the set."""
        slot = F.col(column).bitwiseAND((1 << self.bits) - 1)
        bit = F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")
        maybe = F.coalesce(F.col("__mask").bitwiseAND(bit) != 0, F.lit(False))
        rows = df.withColumn("__word", F.shiftright(slot, 6)).join(F.broadcast(self.words), "__word", how)
        return rows.withColumn("__maybe", maybe).drop("__word", "__mask")


def rows_without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``rows`` whose keys (not null) are not in ``gone``, a written
    table of distinct keys. Rows that a filter of these keys refuses stay where
    they are; only the others are shuffled to meet them."""
    if not gone.take(1):
        return rows
    mark = F.xxhash64(*keys)
    slots = BitFilter.sized(gone.select(mark.alias("h")), "h")
    marked = slots.mark(rows.withColumn("__h", mark), "__h")
    stay = marked.filter(~F.col("__maybe")).drop("__maybe", "__h")
    met = marked.filter("__maybe").drop("__maybe", "__h").join(gone, keys, "left_anti")
    return stay.unionByName(met)


def rows_once(rows: DataFrame, again: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with one row of those whose keys are in ``again``, a written table
    of keys that several rows have. Other rows stay where they are."""
    if not again.take(1):
        return rows
    mark = F.xxhash64(*keys)
    marked = BitFilter.sized(again.select(mark.alias("h")), "h").mark(rows.withColumn("__h", mark), "__h").drop("__h")
    once = marked.filter("__maybe").dropDuplicates(keys)
    return marked.filter(~F.col("__maybe")).unionByName(once).drop("__maybe")
