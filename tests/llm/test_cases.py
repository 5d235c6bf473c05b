"""Repeated and null ids, hot keys, clashing names and odd texts, against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowdex.llm import bpe, exact_dedup, fingerprint, langid, licenses, mixing, ngram_join, sharding, toxicity
from rowdex.llm.queries import QUERIES
from tests.llm.tables import ODD, SCHEMA
from tests.llm.test_similar import LOWER, roots, shingles
from tests.llm.test_text import PATTERN, RANKS, plain_grams

CLASH = ["shard", "__slot", "__id", "__gone", "__out", "__h", "__maybe", "__word", "__mask", "row", "sha", "k1", "k2", "score", "__text", "__toxic"]


@pytest.fixture(scope="module")
def clashing(odd_docs):
    return odd_docs.withColumns({c: F.lit(c) for c in CLASH})


# language
def test_language_sample_counts_rows(spark):
    rows = [(1, f"text number {k}", "en") for k in range(3000)] + [(None, f"ein wort {k}", "de") for k in range(40)] + [(7, "hola", "es")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    got = langid.draw(docs, F.col("lang"), F.col("text"), F.col("doc_id"), 10, 5).collect()
    count = Counter(r.lang for r in got)
    assert count["en"] == 10 and 5 <= count["de"] <= 10 and count["es"] == 1
    again = langid.draw(docs.repartition(2), F.col("lang"), F.col("text"), F.col("doc_id"), 10, 5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_language_without_letters(spark, odd_docs):
    model = langid.train(odd_docs, F.col("lang"), F.col("text"), F.col("doc_id"))
    for text, lettered in (("❤️", False), ("a❤️", True), ("12 ³ _", False), ("日", True), ("́", False)):
        names, score = model.predict([text])
        assert (names[0] != "und") == lettered and (score[0] > 0) == lettered
    with pytest.raises(ValueError):
        many = spark.range(langid.MOST_LANGUAGES + 1).select(F.col("id").cast("string").alias("lang"))
        langid.train(many, F.col("lang"), F.col("lang"), F.col("lang"))


def test_language_by_plain_bayes(spark):
    """The model and every prediction of the query against a plain naive Bayes."""
    rng = random.Random(8)
    sounds = {"en": "the and ing ou", "de": "der sch ung ei", "fr": "les eau que oi"}
    rows = [(k, " ".join(rng.choice(sounds[lang].split()) + rng.choice("abcde") for _ in range(rng.choice([1, 8, 20]))), lang) for k in range(90) for lang in [rng.choice(list(sounds))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {(r.lang, r.text) for r in langid.draw(docs, F.col("lang"), F.col("text"), F.col("doc_id"), 1000, 5).collect()}
    counts, prior = {x: np.full(1 << langid.BUCKET_BITS, 0.5) for x in sounds}, Counter(x for x, _ in kept)
    for lang, text in kept:
        np.add.at(counts[lang], plain_grams(text), 1)
    want = {}
    for ident, text, _ in rows:
        logs = {x: np.log(prior[x] / len(kept)) + np.log(counts[x] / counts[x].sum())[plain_grams(text)].sum() for x in sounds}
        best = max(sorted(logs), key=logs.get)
        want[ident] = (best, 1 / sum(np.exp(v - logs[best]) for v in logs.values()))
    model = langid.train(docs, F.col("lang"), F.col("text"), F.col("doc_id"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model, [F.col("doc_id")]).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert max(abs(got[k][1] - want[k][1]) for k in want) < 1e-3


@pytest.mark.parametrize("segment", [1, 2, 5])
def test_language_segments(monkeypatch, segment):
    rng = random.Random(1)
    monkeypatch.setattr(langid, "SEGMENT", segment)
    for _ in range(50):
        text = "".join(rng.choices("ab é. ,❤️日́", k=rng.choice([1, 2, 5, 30])))
        counts, lettered = langid.long_counts(text)
        assert np.repeat(np.arange(1 << langid.BUCKET_BITS), counts).tolist() == plain_grams(text)
        assert lettered == any(c.isalpha() for c in text)


# toxicity
def test_toxicity_sample_has_a_bound(spark, monkeypatch):
    rows = [(1, f"you idiot {k}") for k in range(3000)] + [(k, f"nice words {k}") for k in range(2, 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k == 1)) for k in range(1, 30)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "staged", lambda df, name: seen.append((name, df.count())) or df)
    toxicity.train(docs, labels, "text", "doc_id", F.col("toxic"), most=10)
    assert dict(seen)["toxicity"] <= 10


def test_trees_by_plain_boosting():
    """Each tree's leaves are the ridge means of the gradients below it, and each
    split has the best gain among all features and bin edges."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (120, 3)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 2] > 3) ^ (rng.random(120) < 0.1)).astype(float)
    trees = toxicity.Trees(rounds=4, depth=2).fit(x, y)
    raw = np.full(120, np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for levels, leaves in zip(trees.splits, trees.leaves, strict=True):
        p = 1 / (1 + np.exp(-raw))
        g, h, node = y - p, p * (1 - p), np.zeros(120, int)
        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: E731, B023
        for feature, cut in levels:
            after = node.copy()
            for k in range(len(feature)):
                here = node == k
                gains = {}
                for f in range(3):
                    for c in range(len(trees.edges[f]) + 1):
                        low = here & (np.searchsorted(trees.edges[f], x[:, f], "left") <= c)
                        high = here & ~low
                        if h[low].sum() >= 1 and h[high].sum() >= 1:
                            gains[f, c] = part(low) + part(high) - part(here)
                best = max(gains.values(), default=0)
                if best > 1e-6:
                    assert abs(gains[feature[k], cut[k]] - best) < 1e-9
                    split = np.searchsorted(trees.edges[feature[k]], x[:, feature[k]], "left") > cut[k]
                    after[here] = 2 * k + split[here]
                else:
                    after[here] = 2 * k
            node = after
        for k in range(4):
            m = node == k
            raw[m] += 0.15 * g[m].sum() / (h[m].sum() + 1)
            assert not m.any() or abs(leaves[k] - 0.15 * g[m].sum() / (h[m].sum() + 1)) < 1e-9
    assert np.allclose(trees.raw(x), raw)


# licences
@pytest.mark.parametrize(
    "text,labels",
    [
        ("SPDX-License-Identifier: foo,bar OR mit", "mit"),
        ("SPDX-License-Identifier: foo OR mit", "mit,unknown"),
        ("SPDX-License-Identifier: Proprietary,", "unknown"),
        ("SPDX-License-Identifier: mitochondria", "unknown"),
        ("SPDX-License-Identifier:\nMIT is a line of prose", ""),
        ("SPDX-License-Identifier", ""),
        ("SPDX License Identifier: MIT", ""),
        ("spdx-license-identifier \t: Apache-2.0", "apache-2"),
        ("é SPDX-License-Identifier: MIT-0 */\n// SPDX-License-Identifier: BSD-3-Clause", "bsd,mit"),
        ("SPDX-License-Identifier: " + " AND ".join(["MIT", "x", "GPL-2.0+"] * 5000), "gpl,mit,unknown"),
    ],
)
def test_license_tags(text, labels):
    assert licenses.scan(text)[5] == labels


# exact dedup
def test_index_tiers_probe_filters(spark):
    rows = [(k, f"text {k % 700}" if k % 3 else f"own {k}") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    index = exact_dedup.DigestIndex(spark, keep="largest")
    index.flush(docs, generations=4)
    assert index.generations == 4 and index.runs().count() == 2000
    tier = index.merge()
    bits = index.filter_bits(tier.count())
    held = {r.word: [r[f"m{g}"] for g in range(4)] for r in index.filters(tier, bits).collect()}
    for r in tier.collect():  # every entry is in its generation's filter
        slot = r.h & ((1 << bits) - 1)
        assert held[slot >> 6][r.generation] >> (slot & 63) & 1
    groups = defaultdict(list)
    for ident, text in rows:
        groups[hashlib.sha256(text.encode()).digest()].append(ident)
    level = {bytes(r.key): (r.keep, r.n) for r in index.compact().collect()}
    assert level == {k: (max(v), len(v)) for k, v in groups.items()}


def test_runs_are_bounded_and_sorted(monkeypatch, spark):
    monkeypatch.setattr(exact_dedup, "MEMTABLE", 50)
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).repartition(3)
    index = exact_dedup.DigestIndex(spark)
    index.flush(docs, generations=2)
    rows = index.runs().select("sha", F.input_file_name().alias("file"), F.col("_metadata.row_index").alias("at")).collect()
    files = defaultdict(list)
    for r in rows:
        files[r.file].append((r.at, bytes(r.sha)))
    assert len(files) >= 12 and all(len(v) <= 50 and [s for _, s in sorted(v)] == sorted(s for _, s in v) for v in files.values())


def test_clashing_names(clashing, tmp_path):
    n = len(ODD)
    left = exact_dedup.drop_exact_duplicates(clashing)
    assert left.columns == clashing.columns and left.count() == len({(r[1] or "").translate(LOWER) for r in ODD})
    assert exact_dedup.exact_duplicates(clashing).count() == n
    near = ngram_join.drop_similar_documents(clashing)
    assert near.columns == clashing.columns and near.count() == len({frozenset(shingles(r[1])) for r in ODD}) - 1 + sum(not shingles(r[1]) for r in ODD)
    sharding.write_shards(clashing, str(tmp_path / "out"), shards=3)
    back = clashing.sparkSession.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*clashing.columns, "shard_", "__slot_"} and back.count() == n
    assert sharding.assign_shards(clashing).count() == n
    assert fingerprint.edit_report(clashing).count() == licenses.scan_licenses(clashing).count() == bpe.round_trip(clashing, RANKS, PATTERN).count() == n
    mixed = mixing.mix(clashing, F.lit("d"), F.col("lang"), F.col("source"), mixing.word_tokens(F.col("text")), carry=clashing.columns)
    assert mixed.select("row.*").columns == clashing.columns and mixed.count() == n


# sharding
def test_hot_id_fills_many_cells(spark, monkeypatch):
    cells = []
    plain = F.collect_list
    monkeypatch.setattr(sharding.F, "collect_list", lambda c: cells.append(c) or plain(c))
    rows = [(5, f"text {k} " * 10) for k in range(500)] + [(6, "same text " * 10)] * 500 + [(k, "x") for k in range(100, 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    held = sharding.shuffled_cells(docs, "doc_id", "text", 4, 17, 4000)
    starts = held.filter("__row.doc_id in (5, 6)").select("__shard", "__slot", "__row").collect()
    assert len(starts) == 1000
    got = sharding.assign_shards(docs, shards=4, cell_bytes=4000).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t) + 1) for i, t in rows)
    for shard in range(4):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.xxhash64(F.lit(17), F.lit("cell"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    same = docs.filter("doc_id = 6").withColumn("mark", mark).select(F.xxhash64("mark", F.spark_partition_id()).alias("b")).distinct()
    assert same.count() > 1  # equal rows of one key, in a bucket for each input partition


# n-gram join
def test_similar_with_repeated_ids(spark):
    """Rows that share an id are one document; rows without an id link too."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(90):
        if k % 3 and rows:
            words = (rng.choice(rows)[1] or "a b c d e f").split(" ")
            for _ in range(rng.choice([0, 1, 1, 2])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([3, 30, 60]))]
        rows.append((rng.choice([None, *range(40)]), " ".join(words) if k % 17 else None, f"row {k}"))
    nodes = list(range(len(rows)))
    sets = [shingles(t) for _, t, _ in rows]
    pairs = [(a, b) for a in nodes for b in nodes if a < b and (
        rows[a][0] is not None and rows[a][0] == rows[b][0] or sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))]
    root = roots(pairs, nodes)
    lowest = {}
    for k in nodes:
        held = [rows[j][0] for j in nodes if root[j] == root[k] and rows[j][0] is not None]
        lowest[k] = min(held) if held else None
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(4)
    got = ngram_join.similar_documents(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((rows[k][0], len(sets[k]), lowest[k]) for k in nodes)
    stay = ngram_join.drop_similar_documents(docs).collect()
    kept = [nodes[[r[2] for r in rows].index(s.extra)] for s in stay]
    worded = {root[k] for k in nodes if any(sets[j] for j in nodes if root[j] == root[k])}
    assert Counter(root[k] for k in kept if root[k] in worded) == Counter(dict.fromkeys(worded, 1))
    assert all(rows[k][0] == lowest[k] for k in kept)
    assert {k for k in nodes if root[k] not in worded} <= set(kept)


def test_similar_keeps_one_of_equal_rows(spark):
    text = "one two three four five six seven"
    rows = [(3, text)] * 5 + [(None, text.upper())] * 4 + [(None, "null ids only here and no other")] * 3 + [(9, "")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = Counter(map(tuple, ngram_join.drop_similar_documents(docs).collect()))
    assert left == {(3, text): 1, (None, "null ids only here and no other"): 1, (9, ""): 2}


def test_own_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
    owner = rng.integers(0, 5, 35)
    want = [len(np.intersect1d(sets[a], b)) for a, b in zip(owner, sets[5:], strict=True)]
    assert ngram_join.own_overlaps(sets[:5], sets[5:], owner).tolist() == want
    assert len(ngram_join.own_overlaps(sets[:5], [], owner[:0])) == 0


def test_word_hashes_across_segments(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("ab  c\n", k=rng.choice([0, 1, 7, 40, 200]))) for _ in range(60)] + ["x" * 150, " " * 100]
    whole = ngram_join.ngram_sets(texts)
    for size in (8, 16, 64):
        monkeypatch.setattr(ngram_join, "SEGMENT", size)
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, ngram_join.ngram_sets(texts), strict=True))
    for text, got in zip(texts, whole, strict=True):
        assert len(got) == len(shingles(text))


@pytest.mark.parametrize("call", [lambda t: ngram_join.ngram_sets([t]), langid.long_counts, fingerprint.fingerprint], ids=["sets", "language", "fingerprint"])
def test_memory_on_a_long_text(call):
    rng = random.Random(3)
    text = " ".join(rng.choices([f"word{k}" for k in range(5000)], k=400_000))
    langid.letters(), langid.is_letter()
    tracemalloc.start()
    try:
        call(text)
        assert tracemalloc.get_traced_memory()[1] < 12 * len(text) + 8e6
    finally:
        tracemalloc.stop()


# fingerprints
def test_edit_report_with_repeated_ids(spark):
    """With equal ids and equal rows in many ranges each row has one next row, and all are one ring."""
    rows = [(3, f"text of many {k % 7} words " * (1 + k % 5)) for k in range(200)] + [(None, "no id")] * 30 + [(k, "x" * k) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = fingerprint.edit_report(docs, range_bytes=400).collect()
    assert Counter((r.doc_id, r.n_chars, r.fingerprint) for r in got) == Counter((i, len(t), fingerprint.fingerprint(t)) for i, t in rows)
    low = next(r for r in got if r.doc_id == 4)
    assert low.edited_sha256 == hashlib.sha256(b"xxx" + rows[200 + 30 + 3][1][:1].encode()).hexdigest() or low.n_chars == 4


# the pipeline's stages
@pytest.mark.parametrize("which", ["odd", "empty", "clashing"])
def test_stages_on_odd_tables(spark, odd_docs, no_docs, clashing, which):
    docs = {"odd": odd_docs, "empty": no_docs, "clashing": clashing}[which]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != "byte-level bpe":
            assert out.columns == docs.columns
        count = out.count()
        assert count == 0 if which == "empty" else 0 < count <= len(ODD)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries_on_odd_documents(spark, odd_docs, tmp_path_factory, name):
    """Each query over tables of odd documents, and over empty ones."""
    for rows in (odd_docs, odd_docs.limit(0)):
        folder = str(tmp_path_factory.mktemp("odd"))
        rows.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("int")).write.parquet(f"{folder}/documents.parquet")
        labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(1, 10)], "doc_id long, quality int, toxic int")
        labels.write.parquet(f"{folder}/labels.parquet")
        assert QUERIES[name](spark, folder).count() == rows.count()
    assert SCHEMA.startswith("doc_id long")
