"""Exact deduplication over a log-structured merge index of text digests.

Writing is append only. A *memtable* is what a task holds of its input: its
entries are sorted by digest and flushed as *runs*, Parquet files of at most
``MEMTABLE`` entries each. Runs fall into generations by the task that wrote
them; no row moves between executors for that.

*Compaction* has two tiers. The first merges the runs of each generation: one
entry for each digest, with the identifier that stays and the number of rows;
copies are combined inside each task before that shuffles, so a text that holds
a third of all rows sends one entry per task. With it goes the generation's
*filter*, a bitmap of its digests. The second tier probes each entry against the
filters of the other generations: what all of them refuse stands in no other
generation and is final; the rest meets in one more merge. The filters together
have a bounded size (``DigestIndex.filter_bits``), so with very many digests
they let more through to that merge, and never lose one.

A *hit* is a digest with more than one row. Its texts are compared byte for
byte (rows are grouped by digest and text); a digest that turns out to hold
different texts is resolved by text instead. Only rows that the filter of hit
digests lets through carry their text into that comparison.

DataFrame operations only. Defined results: a null text counts as empty; a long
text is one value, as digests make entries equally short; rows that repeat both
id and text are one document and share its verdict; a null id stays only where
no row of the group has an id; an empty table gives no rows; other columns of
the input are ignored, whatever their names, and kept as they are by
``drop_exact_duplicates``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdex.llm._common import BitFilter, ascii_lower, named, packed, rows_once, rows_without, staged, staging_path

#: Entries of a run, and generations of runs that a flush makes.
MEMTABLE, GENERATIONS = 1_000_000, 4


class DigestIndex:
    """Generations of sorted runs of (sha, id) below one folder, and their compaction.

    keep: "smallest" or "largest", the identifier that stays of equal digests.
    digest_bytes: how much of the SHA-256 is the key; 32 but in tests.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, keep: str = "smallest", digest_bytes: int = 32):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep is 'smallest' or 'largest'")
        self.spark, self.folder = spark, folder or staging_path(spark, "digests")
        self.best = F.min if keep == "smallest" else F.max
        self.digest_bytes, self.generations, self.level = digest_bytes, 0, None

    def entries(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        text = ascii_lower(F.coalesce(named(text_col).cast("string"), F.lit("")))
        return docs.select(named(id_col).alias("id"), text.alias("text")).withColumn("sha", F.unhex(F.sha2("text", 256)))

    def key(self, sha: str = "sha"):
        return F.expr(f"substring({sha}, 1, {self.digest_bytes})") if self.digest_bytes < 32 else F.col(sha)

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", generations: int = 1) -> None:
        """Adds generations of runs; a task's runs are in one of them."""
        own = F.lit(self.generations) + F.pmod(F.spark_partition_id(), F.lit(generations))
        rows = self.entries(docs, id_col, text_col).select("sha", "id", own.alias("generation"))
        rows = rows.sortWithinPartitions("generation", "sha").write.mode("append").option("maxRecordsPerFile", MEMTABLE)
        rows.partitionBy("generation").parquet(f"{self.folder}/runs")
        self.schema = rows_schema(docs, id_col)
        self.generations += generations

    def runs(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/runs")

    def filter_bits(self, entries: int) -> int:
        """About 8 bits for each entry of a generation; 2**24 (2 MB) at most."""
        return min(24, max(16, (8 * entries // max(1, self.generations)).bit_length()))

    def merge(self) -> DataFrame:
        """The first tier: (generation, key, keep, n), for each digest of a generation."""
        rows = self.runs().groupBy("generation", self.key().alias("key"))
        return staged(rows.agg(self.best("id").alias("keep"), F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("key")), "tier")

    def filters(self, tier: DataFrame, bits: int) -> DataFrame:
        """The filters of all generations: (word, m0, m1, ...), a mask for each."""
        slot = F.col("h").bitwiseAND((1 << bits) - 1)
        rows = tier.select("generation", F.shiftright(slot, 6).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        masks = [F.bit_or(F.when(F.col("generation") == g, F.col("bit")).otherwise(F.lit(0))).alias(f"m{g}") for g in range(self.generations)]
        return rows.groupBy("word").agg(*masks)

    def compact(self) -> DataFrame:
        """Merges every run into one level: (key, keep, n)."""
        tier = self.merge()
        bits = self.filter_bits(tier.count())
        slot = F.col("h").bitwiseAND((1 << bits) - 1)
        others = [F.when(F.col("generation") == g, F.lit(0)).otherwise(F.col(f"m{g}")) for g in range(self.generations)]
        seen = others[0]
        for mask in others[1:]:
            seen = seen.bitwiseOR(mask)
        # 2**bits / 64 rows of a mask for each generation
        probed = tier.withColumn("word", F.shiftright(slot, 6)).join(F.broadcast(self.filters(tier, bits)), "word")
        probed = probed.withColumn("elsewhere", seen.bitwiseAND(F.expr("shiftleft(1L, cast(h & 63 as int))")) != 0)
        alone = probed.filter(~F.col("elsewhere")).select("key", "keep", "n")
        met = probed.filter("elsewhere").groupBy("key").agg(self.best("keep").alias("keep"), F.sum("n").alias("n"))
        self.level = staged(alone.unionByName(met), "level")
        return self.level

    def verify(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
        """Byte verification of all hits. Gives the digests with one text as
        (key, keep, n), and those with several as (key, text, keep, n) or None."""
        hits = self.level.filter("n > 1")
        slots = BitFilter.sized(hits.select(F.xxhash64("key").alias("h")), "h")
        rows = self.entries(docs, id_col, text_col).select("id", "text", self.key().alias("key"))
        rows = slots.keep(rows.withColumn("h", F.xxhash64("key")), "h").drop("h")
        by_text = rows.groupBy("key", "text").agg(self.best("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        groups = staged(
            by_text.groupBy("key").agg(self.best("keep").alias("keep"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")),
            "verified",
        )
        clash = groups.filter("texts > 1")
        several = by_text.join(clash.select("key"), "key", "left_semi") if clash.take(1) else None
        return groups.filter("texts = 1 and n > 1").drop("texts"), several


def rows_schema(docs: DataFrame, id_col: str) -> str:
    return f"sha binary, id {docs.schema[id_col].dataType.simpleString()}, generation int"


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", digest_bytes: int = 32
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.
    """
    index = DigestIndex(docs.sparkSession, keep=keep, digest_bytes=digest_bytes)
    index.flush(docs, id_col, text_col, GENERATIONS)
    index.compact()
    one_text, several = index.verify(docs, id_col, text_col)

    # A key with many rows splits at the join: the entry on the other side is one short row.
    joined = index.runs().select("sha", "id", index.key().alias("key")).join(one_text, "key", "left")
    if several is not None:
        marked = several.select(F.sha2("text", 256).alias("hex"), "text", F.col("keep").alias("k2"), F.col("n").alias("n2"))
        texts = index.entries(docs, id_col, text_col).withColumn("key", index.key())
        texts = texts.join(several.select("key").distinct(), "key", "left_semi")
        clashing = texts.join(marked, "text").select("sha", "id", "key", F.col("k2").alias("keep"), F.col("n2").alias("n"))
        joined = joined.join(several.select("key").distinct(), "key", "left_anti").select("sha", "id", "key", "keep", "n")
        joined = joined.unionByName(clashing)
    size = F.coalesce("n", F.lit(1)).cast("long")
    keep_id = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep"))
    return joined.select(
        F.col("id").alias(id_col),
        keep_id.alias("keep_id"),
        size.alias("group_size"),
        keep_id.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of rows that
    repeat both id and text. Rows move only where a filter of what goes, or of
    what repeats, lets them through."""
    found = exact_duplicates(docs, id_col, text_col, keep)
    verdicts = staged(found.select(_id_text(named(id_col)), F.unhex("text_sha256").alias("sha"), "kept"), "verdicts")
    text = ascii_lower(F.coalesce(named(text_col).cast("string"), F.lit("")))
    rows = docs.select(_id_text(named(id_col)), F.unhex(F.sha2(text, 256)).alias("sha"), packed(docs))
    gone = verdicts.filter(~F.col("kept")).select("id", "sha").distinct()
    left = rows_without(rows, staged(gone, "gone"), ["id", "sha"])
    again = staged(verdicts.filter("kept").groupBy("id", "sha").count().filter("count > 1").select("id", "sha"), "again")
    return rows_once(left, again, ["id", "sha"]).select("row.*")


def _id_text(ident):
    """An id as text without nulls: the empty text for null, else behind a mark."""
    return F.coalesce(F.concat(F.lit("="), ident.cast("string")), F.lit("")).alias("id")
