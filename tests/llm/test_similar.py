"""The n-gram join, components, fingerprints and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowdex.llm import fingerprint, mixing, ngram_join
from rowdex.llm.components import components
from rowdex.llm.queries import MIX_SEED, MIX_WEIGHTS, source_domain
from tests.llm.tables import ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def plain_components(rows):
    sets = {k: shingles(t) for k, t in rows}
    pairs = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    return {k: (len(sets[k]), c) for k, c in roots(pairs, sets).items()}


def test_similar_documents(word_docs):
    docs, rows = word_docs
    want = plain_components([r[:2] for r in rows])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs.repartition(4)).collect()}
    assert got == want
    assert sum(k != c for k, (_, c) in want.items()) > 20
    left = ngram_join.drop_similar_documents(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {c for _, c in want.values()}


def test_blocks_and_rounds_lose_no_link(monkeypatch, spark):
    """A group of near copies that mostly do not link with each other, with the
    narrow path closed and blocks of a few rows."""
    rng = random.Random(3)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3, 4])):
            words[rng.randrange(90)] = f"x{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    want = plain_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for wide, left, right, most in ((0, 7, 20, 12), (10**9, 7, 20, 12), (5, 4, 4, 0), (200, 1024, 4096, 12)):
        monkeypatch.setattr(ngram_join, "WIDE_PAIRS", wide)
        monkeypatch.setattr(ngram_join, "LEFT_ROWS", left)
        monkeypatch.setattr(ngram_join, "RIGHT_ROWS", right)
        monkeypatch.setattr(ngram_join, "MOST_ROUNDS", most)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_documents(docs).collect()}
        assert got == want
    assert 1 < len({c for _, c in want.values()}) < 150


def test_similar_odd_rows(odd_docs, no_docs):
    got = ngram_join.similar_documents(odd_docs).collect()
    assert len(got) == len(ODD)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert by_id[1] == by_id[2] == (2, 1) and by_id[3] == (0, 3) and by_id[5] == (0, 5) and by_id[7] == (1, 7)
    assert sorted(r.n_shingles for r in got if r.doc_id is None) == [0, 2]
    assert ngram_join.similar_documents(no_docs).collect() == []


def test_product():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(rng.integers(0, 10**6, 500).astype(np.uint64)) for _ in range(5)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets[:9]]
    assert (ngram_join.product(sets[:9], sets) == np.array(want)).all()


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = rng.integers(0, 2**63, 300).astype(np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 280))) for _ in range(2))
        apart = ngram_join.sketch_distance(ngram_join.sketch(a), ngram_join.sketch(b))
        assert apart <= len(np.setxor1d(a, b)) and (apart + len(a) + len(b)) % 2 == 0


def test_components(spark):
    rng = random.Random(5)
    pairs = [(k, k + 1) for k in range(60)] + [(200, 200 + k) for k in range(1, 50)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(pairs)
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    got = {r.v: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in roots(pairs, {n for p in pairs for n in p}).items() if k in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def plain_likeness(x, y):
    if not x and not y:
        return 1.0
    if not x or not y:
        return 0.0
    need = min(len(x), len(y), max(2, min(4, min(len(x), len(y)) // 3)))
    if not any(x[k : k + need] in y for k in range(len(x) - need + 1)):
        return 0.0
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], last if a == b else 1 + min(row[j], row[j - 1])
    return 1 - row[-1] / (len(x) + len(y))


def test_signature_likeness():
    rng = random.Random(2)
    draw = lambda: "".join(rng.choices("abcdef", k=rng.choice([0, 1, 2, 3, 5, 9, 12, 40, 63, 64])))
    pairs = [(draw(), draw()) for _ in range(300)]
    pairs += [(x, (x[: len(x) // 2] + y)[:64]) for x, y in pairs]
    got = fingerprint.signature_likeness([x for x, _ in pairs], [y for _, y in pairs])
    assert np.allclose(got, [plain_likeness(x, y) for x, y in pairs])


def plain_fingerprint(text):
    data = (text or "").encode()
    mask = 0xFFFFFFFF
    ends = defaultdict(list)
    for i in range(len(data)):
        roll = sum(data[i - j] * int(fingerprint.ROLL[j]) for j in range(7) if i >= j) & mask
        roll ^= roll >> 15
        roll = roll * 0x85EBCA77 & mask
        roll ^= roll >> 13
        for k in range(2, 40):
            if k < 32 and roll & ((1 << k) - 1) == 0:
                ends[k].append(i)
    level = next(k for k in range(2, 40) if len(ends[k]) < 64)
    signatures = []
    for k in (level, level + 1):
        cut = ends[k] + ([len(data) - 1] if data and (not ends[k] or ends[k][-1] != len(data) - 1) else [])
        chars, start = "", 0
        for end in cut:
            own = sum((c + 1) * pow(fingerprint.BASE, j, 1 << 64) for j, c in enumerate(data[start : end + 1])) % (1 << 64)
            own ^= own >> 29
            own = own * 0xBF58476D1CE4E5B9 % (1 << 64)
            chars += chr(fingerprint.ALPHABET[own >> 58])
            start = end + 1
        signatures.append(chars)
    return f"{1 << level}:{signatures[0]}:{signatures[1]}"


@pytest.mark.parametrize("segment", [64, 1 << 16])
def test_fingerprint(monkeypatch, segment):
    monkeypatch.setattr(fingerprint, "SEGMENT", segment)
    rng = random.Random(4)
    for n in (0, 1, 2, 7, 30, 300, 3000):
        text = "".join(rng.choices("abcdefgh éß🙂", k=n))
        assert fingerprint.fingerprint(text) == plain_fingerprint(text)
    assert fingerprint.fingerprint(None) == fingerprint.fingerprint("") == "4::"


@pytest.mark.parametrize("range_bytes", [500, 1 << 24])
def test_edit_report(word_docs, range_bytes):
    docs, rows = word_docs
    texts = sorted((r[:2] for r in rows), reverse=True)
    got = {r.doc_id: r for r in fingerprint.edit_report(docs.repartition(3), range_bytes=range_bytes).collect()}
    assert len(got) == len(rows)
    for k, (ident, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        moved = len(text) // 3
        edited = text[: len(text) - moved] + following[:moved]
        r = got[ident]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == fingerprint.fingerprint(text) and r.edited_fingerprint == fingerprint.fingerprint(edited)
        assert r.near_edited == fingerprint.likeness([r.fingerprint], [r.edited_fingerprint])[0]
        assert r.near_next == fingerprint.likeness([r.fingerprint], [fingerprint.fingerprint(following)])[0]


def test_edit_report_odd_rows(odd_docs, no_docs):
    for size in (50, 1 << 24):
        got = fingerprint.edit_report(odd_docs, range_bytes=size).collect()
        assert len(got) == len(ODD)
        nine = next(r for r in got if r.doc_id == 9)
        assert nine.edited_sha256 == hashlib.sha256(("Éco" + "u" + "éc").encode()).hexdigest()
    one = fingerprint.edit_report(odd_docs.filter("doc_id = 6")).first()
    assert one.near_next == 1.0
    assert fingerprint.edit_report(no_docs).collect() == []
    assert fingerprint.fingerprints(odd_docs).count() == len(ODD)


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.staged(stage(spark, docs, sf), "test")
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before) and len(after) == out.count() > 0
        if name != "byte-level bpe":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(after[k].text == before[k] for k in after)
        if name == "exact dedup":
            assert sorted({t.translate(LOWER) for t in before.values()}) == sorted(r.text.translate(LOWER) for r in after.values())
        if name == "n-gram jaccard join":
            assert set(after) == {c for _, c in plain_components(before.items()).values()}
        if name == "byte-level bpe":
            assert set(after) == set(before)
            assert all(r.decoded_sha256 == hashlib.sha256(before[k].encode()).hexdigest() for k, r in after.items())
        docs, before = out, {k: r.text if name != "byte-level bpe" else "" for k, r in after.items()}


def test_mixing_stage_takes_rows_not_ids(spark):
    """Repeated and null ids: a leaf keeps as many rows of ten tokens as its target holds."""
    schema = "doc_id long, text string, lang string, source string, n_chars int"
    rows = [(None if k % 3 == 0 else k % 40, f"w{k} " * 10, ["en", "de", None][k % 3 - k % 2], f"src{k % 8}", k) for k in range(900)]
    docs = spark.createDataFrame(rows, schema).repartition(5)
    mixed = mixing.mix(docs, source_domain(), F.col("lang"), F.col("source"), mixing.word_tokens(F.col("text")), budget=corpus_pipeline.MIX_BUDGET, max_epochs=1, weights=MIX_WEIGHTS, seed=MIX_SEED)
    target = {(r.lang, r.source): r.leaf_target // 10 for r in mixed.collect()}
    kept = corpus_pipeline.mix_sources(spark, docs, "").collect()
    assert kept[0].__fields__ == docs.columns
    assert {tuple(r) for r in kept} <= set(rows) and len({r.n_chars for r in kept}) == len(kept) < len(rows)
    assert Counter((r.lang or "", r.source) for r in kept) == Counter({k: n for k, n in target.items() if n})
    again = corpus_pipeline.mix_sources(spark, docs.repartition(2), "").collect()
    assert set(map(tuple, again)) == set(map(tuple, kept))
