"""The registered queries of the operators here, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdex.llm import bpe, exact_dedup, fingerprint, langid, licenses, mixing, ngram_join, sharding, token_count, toxicity
from rowdex.llm._common import id_crc, read_table

#: Target weights of the mixture, by level of its tree.
MIX_WEIGHTS = {
    "domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1},
    "lang": {"en": 5, "de": 2, "fr": 2, "es": 1},
}
MIX_SEED, MIX_EPOCHS = 11, 2


def source_domain(source=None):
    """Domain of a source: its number modulo four."""
    source = F.col("source") if source is None else source
    return F.concat(F.lit("d"), F.pmod(F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]+)$", 1).try_cast("long"), F.lit(4)).cast("string"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    return mixing.mix(
        docs, source_domain(), F.col("lang"), F.col("source"), mixing.word_tokens(F.col("text")),
        max_epochs=MIX_EPOCHS, weights=MIX_WEIGHTS, seed=MIX_SEED,
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    held_out = id_crc(F.col("doc_id")) % 5 == 0
    model = toxicity.train(docs, labels.filter(~held_out), "text", "doc_id", F.col("toxic"))
    scored = toxicity.score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = id_crc(F.col("doc_id")) % 4 == 2
    model = langid.train(docs.filter(~held_out), F.col("lang"), F.col("text"), F.col("doc_id"))
    return langid.identify(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


def vocabulary(name: str) -> str:
    """Path of a file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pretoken_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return exact_dedup.exact_duplicates(docs, keep="largest")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return token_count.count_tokens(docs, vocabulary("byte_bpe_50k.json"), pretoken_pattern(), limit=1024)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.tiktoken"), pretoken_pattern(), with_offsets=True)


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_table(spark, sf_dir, "documents"), shards=16)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_toxicity, op3_language_id, op4_license_scan, op5_exact_dedup, op6_token_counts,
        op7_byte_bpe, op8_shard, op9_ngram_jaccard, op10_fingerprints,
    )
}


def _case(column: str, weights: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END"


def _share_sql(name: str, given: str, parents: str, level: str, weight: str) -> str:
    """One level of the allocation, as tables name_n (shares) and name (parts)."""
    on = f"USING ({parents})"
    return f"""
{name}_n AS (SELECT *, (b - coalesce(sum(cap) OVER p, 0))::DOUBLE / (sum(w) OVER (PARTITION BY {parents}) - coalesce(sum(w) OVER p, 0)) AS lv
  FROM (SELECT {parents}, {level}, {weight} AS w, sum(cap) AS cap FROM caps GROUP BY {parents}, {level}) JOIN {given} {on}
  WINDOW p AS (PARTITION BY {parents} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (SELECT {parents}, {level}, floor(least(cap::DOUBLE, coalesce(max(lv) FILTER (lv <= cap / w) OVER (PARTITION BY {parents}) * w, cap::DOUBLE)))::BIGINT AS b FROM {name}_n)"""


ORACLE_SQL = {
    "op1_mix_sources": f"""
WITH r AS (SELECT doc_id, 'd' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT % 4) AS domain, lang, source,
    len(list_filter(string_split(text, ' '), lambda x: x <> '')) AS t FROM documents),
caps AS (SELECT 0 AS a, domain, lang, source, sum(t)::BIGINT AS tokens, (sum(t) * {MIX_EPOCHS})::BIGINT AS cap FROM r GROUP BY ALL),
g0 AS (SELECT 0 AS a, floor(sum(tokens) * 1.0::DOUBLE) AS b FROM caps),
{_share_sql("g1", "g0", "a", "domain", _case("domain", MIX_WEIGHTS["domain"]))},
{_share_sql("g2", "g1", "a, domain", "lang", _case("lang", MIX_WEIGHTS["lang"]))},
{_share_sql("g3", "g2", "a, domain, lang", "source", "1")},
plan AS (SELECT domain, lang, source, b, CASE WHEN tokens > 0 THEN floor(b / tokens)::BIGINT ELSE 0 END AS e, tokens FROM g3 JOIN caps USING (domain, lang, source)),
o AS (SELECT *, sum(t) OVER (PARTITION BY domain, lang, source ORDER BY ('0x' || substr(md5('{MIX_SEED}:' || e || ':' || doc_id), 1, 15))::BIGINT, doc_id, t ROWS UNBOUNDED PRECEDING) AS upto
  FROM r JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, t::BIGINT AS n_tokens, (e + CASE WHEN upto <= b - e * tokens AND b - e * tokens > 0 THEN 1 ELSE 0 END)::BIGINT AS copies,
  b::BIGINT AS leaf_target, upto::BIGINT AS epoch_tokens FROM o""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
WINDOW g AS (PARTITION BY t)""",
}
