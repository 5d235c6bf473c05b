"""A corpus pipeline of five stages over the operators of ``rowdex.llm``.

Each stage takes all rows that the one before it kept, and its decisions hold:
toxic documents go, one of equal texts stays, one of near copies stays, sources
are cut towards their target weights as far as 95 % of the tokens, each document
at most once, let them (README gives the shares reached), and what is left is
encoded. All stages but the last return whole rows with the columns of
``documents``, and those beside them, whatever their names.

Defined results, of each stage as of its operator: a null text is an empty one;
long texts are read whole; of equal texts the row with the largest id stays,
of rows equal in id and text one; rows without an id are documents of their own;
of near copies one row stays, of the smallest id; the mixture takes rows one by
one, whether or not others have the same id; an empty table gives empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdex.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from rowdex.llm._common import id_crc, packed, read_table, staged
from rowdex.llm.queries import MIX_SEED, MIX_WEIGHTS, pretoken_pattern, source_domain, vocabulary

#: Part of the tokens that the mixture takes; each document at most once.
MIX_BUDGET = 0.95

#: Rows of an Arrow batch between an executor and its Python workers: rows are whole documents.
TEXT_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batches. They stay so, as a stage's plan runs after its function returns."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_ROWS)



def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic").filter(id_crc(F.col("doc_id")) % 5 != 0)
    model = toxicity.train(docs, labels, "text", "doc_id", F.col("toxic"))
    scored = toxicity.score(docs, model, [packed(docs)])
    return scored.filter("score < 0.5").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.drop_similar_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(
        docs, source_domain(), F.col("lang"), F.col("source"), mixing.word_tokens(F.col("text")),
        budget=MIX_BUDGET, max_epochs=1, weights=MIX_WEIGHTS, seed=MIX_SEED, carry=docs.columns,
    )
    return mixed.filter("copies > 0").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), pretoken_pattern(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode),
]

#: SQL cannot express the trained stages nor the similarity join.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
