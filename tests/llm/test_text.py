"""Licences, tokens, language and toxicity against plain Python, the libraries
and held-out rows."""

import base64
import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rowdex.llm import bpe, langid, licenses, token_count, toxicity
from rowdex.llm.queries import QUERIES
from tests.llm.tables import ODD

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
TEXTS = [r[1] or "" for r in ODD] + [
    "aaaaaaaaaaaaaaaaaaaaaaaa", "a" * 3000, "x<|endoftext|> y  <|endoftext|>", "日本語  \n\n\tテ é 🙂👍🏽", "don't I'LL 1234 ___ !!!  ",
    "   odd spaces", "\x00\x01 control",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)


def plain_license(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(parts)] == parts:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_places(spark, odd_docs, no_docs):
    rng = random.Random(1)
    parts = ["under", "the", "mit", "license", "apache", "version", "2", "cc", "by", "nc", "CC BY-NC", "under the MIT  License", "é", "-"]
    rows = [(k, rng.choice([" ", "\n", "-"]).join(rng.choices(parts, k=30))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in licenses.scan_licenses(docs).collect()}
    assert got == {k: plain_license(t) for k, t in rows}
    assert sum(v[1] for v in got.values()) > 100
    odd = sorted(tuple(r)[1:6] for r in licenses.scan_licenses(odd_docs).select(*["doc_id", *licenses.ARROW.names]).fillna(-1).collect())
    assert odd == sorted(tuple(-1 if x is None else x for x in plain_license(r[1])) for r in ODD)
    assert licenses.scan_licenses(no_docs).collect() == []


@pytest.mark.parametrize(
    "expression,postfix",
    [
        ("MIT", ["MIT"]),
        ("MIT OR Apache-2.0 AND GPL-2.0", ["MIT", "Apache-2.0", "GPL-2.0", "and", "or"]),
        ("(MIT OR Apache-2.0) and GPL-2.0 WITH X", ["MIT", "Apache-2.0", "or", "GPL-2.0", "X", "with", "and"]),
        ("a or b or c", ["a", "b", "or", "c", "or"]),
    ],
)
def test_expressions(expression, postfix):
    assert licenses.to_postfix(expression) == postfix


@pytest.mark.parametrize("expression", ["", "MIT OR", "(MIT", "MIT)", "MIT Apache-2.0", "OR MIT", "()"])
def test_broken_expressions(expression):
    with pytest.raises(ValueError):
        licenses.to_postfix(expression)
    licenses.evaluate(expression)


def test_license_labels():
    scan = lambda t: licenses.scan(t)[4:]
    assert scan("// SPDX-License-Identifier: (MIT OR GPL-2.0-only)\nx") == ("", "gpl,mit", 0.95)
    assert scan("SPDX-License-Identifier: MIT AND GPL-3.0") == ("", "gpl,mit", 0.3)
    assert scan("# SPDX-License-Identifier: GPL-2.0 WITH Classpath-exception-2.0") == ("", "gpl", 0.5)
    assert scan("Released under the MIT License. Also under the GNU General Public License") == ("mit", "gpl,mit", 0.3)
    assert scan("mit license under nothing") == ("", "", 0.0)


def test_token_counts(texts, odd_docs, no_docs):
    library = Tokenizer.from_file(JSON)
    want = {k: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for k, t in enumerate(TEXTS)}
    got = {r.doc_id: tuple(r)[1:] for r in token_count.count_tokens(texts, JSON, PATTERN, 1024).collect()}
    assert got == want
    assert token_count.count_tokens(odd_docs, JSON, PATTERN, 1024).count() == len(ODD)
    assert token_count.count_tokens(no_docs, JSON, PATTERN, 1024).collect() == []


def test_recent_table_gives_back_what_is_used():
    recent = token_count.Recent(3)
    recent.update(a=1, b=2, c=3, d=4)
    assert sorted(recent.unknown({"a", "z"})) == ["z"] and recent["a"] == 1 and "b" not in recent
    recent.update(e=1, f=2, g=3)
    assert sorted(recent.unknown({"a", "b"})) == ["b"]
    counter = token_count.Counter(JSON, PATTERN)
    counter.known.most = 5
    library = Tokenizer.from_file(JSON)
    for part in (TEXTS, TEXTS[::-1], TEXTS[:7]):
        assert counter.count(part) == [len(library.encode(t, add_special_tokens=False).ids) for t in part]


def test_bpe_round_trip(texts, odd_docs, no_docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for k, t in enumerate(TEXTS):
        ids = plain.encode_ordinary(t)
        want[k] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()), ids)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.round_trip(texts, RANKS, PATTERN, with_ids=True).collect()}
    assert got == want
    coded = bpe.encode(texts.filter("doc_id <> 7"), RANKS, PATTERN)
    for r in coded.collect():
        text = TEXTS[r.doc_id]
        assert list(r.ids) == want[r.doc_id][3] and len(r.offsets) == len(r.ids)
        for ident, (start, end) in zip(r.ids, r.offsets, strict=True):
            token = next(k for k, v in ranks.items() if v == ident) if len(text) < 60 else None
            assert token is None or token in text[start:end].encode()
    assert {r.doc_id: r.text for r in bpe.decode(coded, RANKS, PATTERN).collect()} == {k: t for k, t in enumerate(TEXTS) if k != 7}
    assert bpe.round_trip(odd_docs, RANKS, PATTERN).count() == len(ODD)
    assert bpe.round_trip(no_docs, RANKS, PATTERN).collect() == []
    codec = bpe.codec(RANKS, PATTERN)
    assert codec.decode(codec.encode(["🙂"])[0][:1]).decode("utf-8", "replace") == "�"
    with pytest.raises(KeyError):
        codec.decode([10**6])


def plain_grams(text, bits=langid.BUCKET_BITS):
    table = langid.letters()
    chars = [32]
    for c in text:
        x = int(table[ord(c)])
        if x != 32 or chars[-1] != 32:
            chars.append(x)
    out = []
    for n in langid.ORDERS:
        for k in range(len(chars) - n + 1):
            mixed = n
            for j in range(n):
                mixed = ((mixed ^ chars[k + j]) * int(langid.FACTORS[j])) & 0xFFFFFFFF
                mixed ^= mixed >> 15
            out.append((mixed * int(langid.FACTORS[3]) & 0xFFFFFFFF) >> (32 - bits))
    return sorted(out)


def test_language_grams():
    some = ["", "a", "Ab c!d", "..", "日本 été" * 3]
    starts, buckets, lettered = langid.grams(some)
    for k, text in enumerate(some):
        assert sorted(buckets[starts[k] : starts[k + 1]].tolist()) == plain_grams(text)
    assert lettered.tolist() == [False, True, True, False, True]


def test_language_held_out(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out").toPandas()
    assert len(got) > 200 and (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    model = langid.train(odd_docs, F.col("lang"), F.col("text"), F.col("doc_id"))
    odd = {(r.doc_id, r.lang_pred) for r in langid.identify(odd_docs, model, [F.col("doc_id")]).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (8, "fr")} <= odd
    empty = langid.train(no_docs, F.col("lang"), F.col("text"), F.col("doc_id"))
    assert {r.lang_pred for r in langid.identify(odd_docs, empty, [F.col("doc_id")]).collect()} == {"und"}


def test_isotonic():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 30, 200).astype(float), rng.integers(0, 2, 200).astype(float)
    at, level = toxicity.isotonic(x, y)
    assert (np.diff(level) >= 0).all() and (np.diff(at) > 0).all()
    fit = np.interp(x, at, level)
    assert abs(fit.sum() - y.sum()) < 1e-6
    for shift in (0.01, -0.01):  # no rising curve near it is closer
        other = np.clip(fit + shift * (fit > np.median(fit)), 0, 1)
        assert ((fit - y) ** 2).sum() <= ((other - y) ** 2).sum() + 1e-9


def test_toxicity_held_out(spark, odd_docs, no_docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = QUERIES["op2_toxicity"](spark, "/root/testdata/sf0.01")
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    own = got.join(labels, "doc_id").toPandas()
    assert ((own.predicted == 1) & (own.toxic == 1)).sum() >= 0.5 * (own.toxic == 1).sum()  # 320 rows to learn from
    assert ((own.predicted == 1) & (own.toxic == 0)).sum() <= 0.03 * (own.toxic == 0).sum()
    held = own[own.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.9
    some = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (77, 0)], "doc_id long, toxic int")
    for marks in (some, some.limit(0)):
        model = toxicity.train(odd_docs, marks, "text", "doc_id", F.col("toxic"))
        scores = [r.score for r in toxicity.score(odd_docs, model, [F.col("doc_id")]).collect()]
        assert len(scores) == len(ODD) and all(0 <= s <= 1 for s in scores)
    assert toxicity.score(no_docs, model, [F.col("doc_id")]).collect() == []


def test_features_name_what_they_see():
    strong, weak = frozenset({"idiot", "moron"}), frozenset({"dull"})
    f = dict(zip(toxicity.FEATURES, toxicity.features("YOU are an idiot!! 1d1ot m*ron dull", strong, weak), strict=True))
    assert f["strong"] > 0 and f["near_second"] > 0 and f["weak"] > 0 and f["shouted"] > 0 and f["runs"] > 0
    assert f["broken"] > 0 and f["broken_hits"] > 0 and f["stars"] > 0
    assert toxicity.features(None, strong, weak) == [0] * len(toxicity.FEATURES)
