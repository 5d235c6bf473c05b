"""Seeded sharding by a two-pass external shuffle.

Pass one scatters records into cells: the shard, and inside it a bucket small
enough for memory, both from seeded hashes. The shard comes from the identifier,
as the one with the highest of its hashes (rendezvous hashing), so it depends on
the identifier and the shard count alone, and one more shard takes records only
into itself. The bucket comes from the identifier and the text; each shard has
as many as its own bytes need. Pass two shuffles each cell with Spark's
``shuffle``, a Fisher-Yates shuffle with a seed, and numbers the records; a cell
starts where the cells before it in its shard end.

Records that repeat both identifier and text, and together outgrow a cell, are
told by a filter of fixed size over the sums of such groups. They go to buckets
by the input partition too, so that no cell holds what one key has in all of
them, however many that are.

The order is the same on every run: cells keep their partition (its number is
given), are sorted inside it, and hold their records sorted before the shuffle.
A task that is run again after a lost executor gives the same rows. On other
input partitions it is the same too, but for shards with records told by that
filter.

DataFrame operations only. A source, a text or a length that is frequent does
not load a cell. Defined results: a null text has size 1; null ids hash as empty
text; whole texts are kept, and a text longer than a cell has one with few
others; equal records take a slot each, and as they are equal, which has which
does not matter; an empty table gives no rows and writes no record. Records are
written with all their columns under whatever names: the shard's folder and the
slot's column are called ``shard`` and ``__slot`` with underscores added until
no column of the records has that name (``layout_names``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from rowdex.llm._common import BitFilter, named, staging_path, unused


def rendezvous(ident: Column, shards: int, seed: int) -> Column:
    """Shard of an identifier among ``shards``, from 0."""
    ident = F.coalesce(ident.cast("string"), F.lit(""))
    marks = F.array(*[F.xxhash64(F.lit(seed), F.lit(s), ident) for s in range(shards)])
    return (F.array_position(marks, F.array_max(marks)) - 1).cast("int")


def layout_names(columns: list[str]) -> tuple[str, str]:
    """Names of the shard's folder and of the slot beside these columns."""
    return unused("shard", columns), unused("__slot", columns)


def shuffled_cells(docs: DataFrame, id_col: str, text_col: str, shards: int, seed: int, cell_bytes: int) -> DataFrame:
    """__shard, __slot (gapless from 0 in each shard) and the record as __row."""
    text = F.coalesce(named(text_col).cast("string"), F.lit(""))
    ident = F.coalesce(named(id_col).cast("string"), F.lit(""))
    record = F.struct(named(id_col), *[named(c) for c in docs.columns if c != id_col])
    records = docs.select(
        rendezvous(named(id_col), shards, seed).alias("__shard"),
        F.xxhash64(F.lit(seed), F.lit("cell"), ident, text).alias("__mark"),
        (F.octet_length(text) + 1).cast("long").alias("__size"),
        record.alias("__row"),
    )
    sums = dict(records.groupBy("__shard").agg(F.sum("__size")).collect())  # a row for each shard
    cells = [max(1, -(-int(sums.get(k, 0)) // cell_bytes)) for k in range(shards)]
    large = records.groupBy("__mark").agg(F.sum("__size").alias("__s")).filter(F.col("__s") > cell_bytes)
    told = BitFilter(large, "__mark").mark(records, "__mark")
    bucket = F.when(F.col("__maybe"), F.xxhash64("__mark", F.spark_partition_id())).otherwise(F.col("__mark"))
    of_shard = F.element_at(F.array(*[F.lit(n).cast("long") for n in cells]), F.col("__shard") + 1)
    placed = told.withColumn("__cell", F.pmod(bucket, of_shard)).select("__shard", "__cell", "__row")

    in_shard = Window.partitionBy("__shard").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__shard", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__shard", "__cell", F.coalesce(F.sum("__n").over(in_shard), F.lit(0)).alias("__start"))

    held = (
        placed.repartition(min(sum(cells), 100_000), "__shard", "__cell")
        .groupBy("__shard", "__cell")
        .agg(F.sort_array(F.collect_list("__row")).alias("__rows"))
        .sortWithinPartitions("__shard", "__cell")
        .select("__shard", "__cell", F.shuffle("__rows", F.lit(seed)).alias("__rows"))
    )
    # ``starts`` has a row for each cell: total bytes over cell_bytes, and one for each shard
    return (
        held.join(F.broadcast(starts), ["__shard", "__cell"])
        .select("__shard", "__start", F.posexplode("__rows").alias("__pos", "__row"))
        .select("__shard", (F.col("__start") + F.col("__pos")).cast("long").alias("__slot"), "__row")
    )


def assign_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 17, cell_bytes: int = 16 << 20
) -> DataFrame:
    """Writes whole records in shards and reads them back. One row for each record
    read: its size, text checksum, shard, slot in the shard, and its shard if there
    were one more."""
    path = staging_path(docs.sparkSession, "shards")
    write_shards(docs, path, id_col, text_col, shards, seed, cell_bytes)
    folder, slot = layout_names(docs.columns)
    schema = StructType([*docs.schema.fields, StructField(slot, LongType()), StructField(folder, IntegerType())])
    text = F.coalesce(named(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.sparkSession.read.schema(schema).parquet(path).select(
        named(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col(folder).alias("shard"),
        F.col(slot).alias("slot"),
        rendezvous(named(id_col), shards + 1, seed).alias("grown_shard"),
    )


def write_shards(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, seed: int = 17, cell_bytes: int = 64 << 20
) -> None:
    """Writes whole records, shuffled, below ``path/shard=N``. A file holds whole
    cells in order of slot; the column __slot gives the place in the shard."""
    folder, slot = layout_names(docs.columns)
    rows = shuffled_cells(docs, id_col, text_col, shards, seed, cell_bytes)
    own = [F.col("__row")[c].alias(c) for c in docs.columns]
    rows = rows.select(*own, F.col("__slot").alias(slot), F.col("__shard").alias(folder))
    rows.sortWithinPartitions(folder, slot).write.partitionBy(folder).parquet(path)
