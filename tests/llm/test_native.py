"""Mixing, exact deduplication and sharding against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rowdex.llm import exact_dedup, mixing, sharding
from rowdex.llm.queries import source_domain
from tests.llm.tables import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_groups(rows, best):
    groups = defaultdict(list)
    for ident, text in rows:
        groups[(text or "").translate(LOWER)].append(ident)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = best(known) if known else None
        for ident in ids:
            out[ident, stays, len(ids), ident == stays, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("keep,best", [("largest", max), ("smallest", min)])
@pytest.mark.parametrize("digest_bytes", [32, 1])
def test_exact_duplicates(spark, odd_docs, keep, best, digest_bytes):
    rows = [(r[0], r[1]) for r in ODD] + [(100 + k, f"text {k % 40}") for k in range(120)]
    docs = odd_docs.select("doc_id", "text", "keep_id", "id").unionByName(
        spark.createDataFrame(rows[len(ODD) :], "doc_id long, text string"), allowMissingColumns=True
    )
    found = exact_dedup.exact_duplicates(docs, keep=keep, digest_bytes=digest_bytes).collect()
    assert Counter(map(tuple, found)) == plain_groups(rows, best)


def test_drop_exact_duplicates(odd_docs, no_docs):
    left = exact_dedup.drop_exact_duplicates(odd_docs, keep="largest")
    assert left.columns == odd_docs.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert got[2, ODD[1][1]] == 1 and (1, ODD[0][1]) not in got
    assert (8, "écoute") in got and (9, "Écoute") in got  # only A-Z fold
    assert len(left.select("text").distinct().collect()) >= 8
    assert exact_dedup.drop_exact_duplicates(no_docs).collect() == []
    assert exact_dedup.exact_duplicates(no_docs).collect() == []


def test_index_takes_more_runs(spark, odd_docs):
    index = exact_dedup.DigestIndex(spark, keep="largest")
    index.flush(odd_docs.limit(0))
    index.flush(odd_docs.filter("doc_id < 5"))
    index.flush(odd_docs.filter("doc_id >= 5 or doc_id is null"))
    level = index.compact()
    assert level.agg(F.sum("n")).first()[0] == len(ODD)
    assert index.runs().count() == len(ODD)
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, keep="any")


def test_shards(spark, odd_docs, no_docs):
    rows = [(k, f"text {k} " * (k % 50)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sharding.assign_shards(docs, cell_bytes=20_000).collect()
    assert sorted(r.doc_id for r in got) == [k for k, _ in rows]
    texts = dict(rows)
    slots = defaultdict(list)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 16)
        slots[r.shard].append((r.slot, r.doc_id))
    assert set(slots) == set(range(16))
    assert min(map(len, slots.values())) > 100
    for held in slots.values():
        held.sort()
        assert [s for s, _ in held] == list(range(len(held)))
        ids = [i for _, i in held]
        assert ids != sorted(ids) and sum(a < b for a, b in zip(ids, ids[1:], strict=False)) < 0.7 * len(ids)
    grown = {r.doc_id: r.shard for r in sharding.assign_shards(docs, shards=17, cell_bytes=20_000).collect()}
    assert all(grown[r.doc_id] == r.grown_shard for r in got)
    # the same on other partitions
    again = {(r.doc_id, r.slot) for r in sharding.assign_shards(docs.repartition(3), cell_bytes=20_000).collect()}
    assert again == {(r.doc_id, r.slot) for r in got}
    odd = sharding.assign_shards(odd_docs).collect()
    assert len(odd) == len(ODD)
    for shard in {r.shard for r in odd}:
        assert sorted(r.slot for r in odd if r.shard == shard) == list(range(sum(r.shard == shard for r in odd)))
    assert {r.size for r in odd if r.doc_id in (3, 4)} == {1}
    assert sharding.assign_shards(no_docs).collect() == []


def test_write_shards(odd_docs, tmp_path):
    sharding.write_shards(odd_docs, str(tmp_path / "out"), shards=4)
    back = odd_docs.sparkSession.read.parquet(str(tmp_path / "out"))
    key = lambda r: (r.doc_id or -1, r.text or "", r.source or "")
    assert sorted(map(key, back.collect())) == sorted(map(key, odd_docs.collect()))
    assert {"shard", "__slot", *odd_docs.columns} == set(back.columns)


def test_shards_are_those_written(monkeypatch, spark):
    """Whole records are written, and what is returned comes from the files."""
    rows = [(None if k % 3 == 0 else k, f"text {k} " * 20, f"src{k % 5}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    whole, paths = sharding.write_shards, []

    def damaging(docs, path, *more, **named):
        paths.append(path)
        whole(docs.withColumn("text", F.when(F.col("doc_id") == 7, "lost").otherwise(F.col("text"))), path, *more, **named)

    monkeypatch.setattr(sharding, "write_shards", damaging)
    got = sharding.assign_shards(docs, shards=4, cell_bytes=5_000).collect()
    assert [(r.size, r.text_crc32) for r in got if r.doc_id == 7] == [(5, zlib.crc32(b"lost"))]
    files = spark.read.parquet(paths[0]).withColumn("file", F.input_file_name()).withColumn("at", F.col("_metadata.row_index")).collect()
    key = lambda r: (r[0] or -1, *r[1:])
    assert sorted((key((r.doc_id, r.text, r.source)) for r in files if r.doc_id != 7)) == sorted(key(r) for r in rows if r[0] != 7)
    written = sorted((r.shard, r["__slot"], zlib.crc32(r.text.encode())) for r in files)
    assert written == sorted((r.shard, r.slot, r.text_crc32) for r in got)
    assert [(s, k) for s, k, _ in written] == [(s, k) for s in range(4) for k in range(sum(r.shard == s for r in got))]
    for name in {r.file for r in files}:
        slots = [r["__slot"] for r in sorted((r for r in files if r.file == name), key=lambda r: r.at)]
        assert slots == sorted(slots)


def plain_share(budget, children):
    """children: name -> (capacity, weight). Fills until nobody takes more."""
    given, open_ = {}, dict(children)
    while open_:
        total = sum(w for _, w in open_.values())
        full = [n for n, (cap, w) in open_.items() if cap <= budget * w / total]
        if not full:
            given |= {n: int(budget * w / total) for n, (_, w) in open_.items()}
            break
        for n in full:
            given[n] = open_.pop(n)[0]
            budget -= given[n]
    return given


@pytest.mark.parametrize("budget,epochs", [(1.0, 2), (0.3, 1), (2.5, 2), (0.0, 1)])
def test_mix(spark, budget, epochs):
    weights = {"domain": {"d0": 4, "d1": 1}, "lang": {"en": 3}}
    rows = [(k, " ".join(["w"] * (1 + k % 17)), "en" if k % 4 else "de", f"src{0 if k % 3 else k % 6}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    tokens = mixing.word_tokens(F.col("text"))
    got = mixing.mix(docs, source_domain(), F.col("lang"), F.col("source"), tokens, budget=budget, max_epochs=epochs, weights=weights).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    leaf = defaultdict(int)
    for r in got:
        assert r.n_tokens == 1 + r.doc_id % 17
        leaf[r.domain, r.lang, r.source] += r.n_tokens
    total = int(sum(leaf.values()) * budget)
    weigh = lambda level, name: weights.get(level, {}).get(name, 1)

    def under(prefix):
        return sum(t for k, t in leaf.items() if k[: len(prefix)] == prefix) * epochs

    def allot(prefix, given):
        if len(prefix) == 3:
            return {prefix: given}
        names = sorted({k[len(prefix)] for k in leaf if k[: len(prefix)] == prefix})
        level = ("domain", "lang", "source")[len(prefix)]
        parts = plain_share(given, {n: (under((*prefix, n)), weigh(level, n)) for n in names})
        return {k: v for n in names for k, v in allot((*prefix, n), parts[n]).items()}

    target = allot((), total)
    for key, given in target.items():
        held = [r for r in got if (r.domain, r.lang, r.source) == key]
        assert all(abs(r.leaf_target - given) <= 1 for r in held)
        given = held[0].leaf_target
        whole, rest = divmod(given, leaf[key])
        order = lambda r: int(hashlib.md5(f"11:{whole}:{r.doc_id}".encode()).hexdigest()[:15], 16)  # noqa: E731, B023
        used = 0
        for r in sorted(held, key=order):
            used += r.n_tokens
            assert r.epoch_tokens == used
            assert r.copies == whole + (used <= rest and rest > 0)


def test_mix_cells_and_odd_rows(monkeypatch, spark, odd_docs, no_docs):
    def mixed(docs):
        return mixing.mix(docs, F.lit("d"), F.col("lang"), F.col("source"), mixing.word_tokens(F.col("text")), budget=0.5, max_epochs=1)

    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    whole = sorted(map(tuple, mixed(docs).collect()))
    monkeypatch.setattr(mixing, "CELL_ROWS", 10)
    assert sorted(map(tuple, mixed(docs).collect())) == whole
    assert sum(r[5] for r in whole) == 250
    odd = mixed(odd_docs).collect()
    assert len(odd) == len(ODD) and {r.lang for r in odd} == {"en", "de", "fr", ""}
    assert mixed(no_docs).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs, F.lit("d"), F.col("lang"), F.col("source"), F.lit(1), weights={"lang": {"en": 0}})
