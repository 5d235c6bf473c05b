"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are rates: words of two learned lexicons (words that
toxic texts of the training sample hold far more often than others), the same
words near a second-person pronoun, capitals and words all in capitals,
exclamation marks and repeated punctuation, and obfuscated words (digits or
signs between letters, letters set apart), also those that read as a word of a
lexicon once undone. In training, a row is measured by lexicons that other rows
made. The trees are boosted on the logistic loss over binned features; raw sums of trees that did not see a row calibrate the score.

The sample: up to ``most`` labelled ids, the first in the order of a seeded hash
of the id, and of each id one text, the one with the smallest hash, so at most
``most`` rows whether or not ids repeat. Lexicon, trees and calibration depend
on that sample alone and have bounded sizes, so they can be broadcast; whole
texts are read in training and in scoring, however long, a few hundred at a
time. Defined results: a null text counts as empty; an empty text has the score
that rows without any feature get; without labels of both kinds every score is
the rate of label 1 (0 without labels); a label whose id is null or has no
document is not used, and of several labels for an id the largest counts; words
of equal rank in a lexicon go by name, splits of equal gain by feature and
value; repeated rows and rows of equal or null id are scored one by one; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from rowdex.llm._common import staged, tidy, unused
from rowdex.llm.token_count import rows_at_a_time

SAMPLE, LEXICON, NEAR, FOLDS = 20_000, 400, 4, 3
WORD = re.compile(r"[^\W\d_]+")
BROKEN = re.compile(r"\b[^\W\d_]+[0-9@$!*|]+[^\W\d_]+[\w@$!*|]*|\b[^\W\d_](?:[.\-_* ][^\W\d_]){3,}\b")
RUNS = re.compile(r"[!?]{2,}|\.{4,}")

#: Second-person pronouns of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch euer ihr sie tu te toi ton ta tes vous votre vos "
    "usted ustedes tú ti tus vosotros vuestro".split()
)
#: What a digit or sign stands for inside a word.
UNDO = str.maketrans("013457@$!|", "oieastasil")
FEATURES = (
    "log_words", "strong", "strong_log", "strong_kinds", "weak", "near_second", "second", "capitals", "shouted",
    "marks", "runs", "broken", "broken_hits", "stars",
)


def features(text: str | None, strong: frozenset[str], weak: frozenset[str]) -> list[float]:
    text = text or ""
    words = WORD.findall(text)
    n = max(1, len(words))
    low = text.lower()
    lowered = WORD.findall(low)
    hits = [k for k, w in enumerate(lowered) if w in strong]
    faint = sum(w in weak for w in lowered)
    near = sum(1 for k in hits if not SECOND_PERSON.isdisjoint(lowered[max(0, k - NEAR) : k + NEAR + 1]))
    second = sum(map(SECOND_PERSON.__contains__, lowered))
    shouted = sum(1 for w in words if len(w) > 2 and w.isupper())
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=128)
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    broken = BROKEN.findall(low)
    undone = 0
    for token in broken:
        plain = re.sub(r"[^\w@$!|]", "", token).translate(UNDO)
        if plain in strong or "*" in token and any(len(w) == len(token) and all(a in ("*", b) for a, b in zip(token, w, strict=True)) for w in strong):
            undone += 1
    size = max(1, len(text))
    return [
        np.log1p(len(words)), 100 * len(hits) / n, np.log1p(len(hits)), np.log1p(len({lowered[k] for k in hits})), 100 * faint / n,
        100 * near / n, 100 * second / n, upper / max(1, upper + lower), 100 * shouted / n,
        100 * (counts[33] + counts[63]) / size, 100 * len(RUNS.findall(text)) / n, 100 * len(broken) / n, 100 * undone / n, 100 * counts[42] / size,
    ]


class Trees:
    """Boosted trees of one depth: each level of a tree splits all its nodes."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)
        self.start = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        raw = np.full(n, self.start)
        self.splits, self.leaves = [], []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            node, levels = np.zeros(n, int), []
            for level in range(self.depth):
                kinds = 1 << level
                gains, cuts = np.full((width, kinds), -1.0), np.zeros((width, kinds), int)
                for f in range(width):
                    cell = node * self.bins + binned[:, f]
                    gs = np.bincount(cell, g, kinds * self.bins).reshape(kinds, -1).cumsum(1)
                    hs = np.bincount(cell, h, kinds * self.bins).reshape(kinds, -1).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least) | (ht - hs < self.least)] = -1
                    cuts[f] = gain.argmax(1)
                    gains[f] = gain.max(1)
                best = gains.argmax(0)
                cut = np.where(gains.max(0) > 1e-6, cuts[best, np.arange(kinds)], self.bins)
                levels.append((best, cut))
                node = node * 2 + (binned[np.arange(n), best[node]] > cut[node])
            kinds = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, kinds) / (np.bincount(node, h, kinds) + self.ridge)
            self.splits.append(levels)
            self.leaves.append(leaf)
            raw += leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1)
        out, at = np.full(len(x), self.start), np.arange(len(x))
        for levels, leaf in zip(self.splits, self.leaves, strict=True):
            node = np.zeros(len(x), int)
            for best, cut in levels:
                node = node * 2 + (binned[at, best[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a rising curve from raw to rate."""
    at, back = np.unique(raw, return_inverse=True)
    weight = np.bincount(back).astype(float)
    blocks: list[list[float]] = []  # first and last raw value, weight, sum
    for x, w, s in zip(at, weight, np.bincount(back, y), strict=True):
        blocks.append([x, x, w, s])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            _, last, w2, s2 = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = last, blocks[-1][2] + w2, blocks[-1][3] + s2
    xs = [x for b in blocks for x in ((b[0],) if b[0] == b[1] else (b[0], b[1]))]
    ys = [b[3] / b[2] for b in blocks for _ in range(1 + (b[0] != b[1]))]
    return np.array(xs), np.array(ys)


class Model:
    def __init__(self, strong: frozenset[str], weak: frozenset[str], x: np.ndarray, y: np.ndarray, folds: np.ndarray):
        self.strong, self.weak, self.trees = strong, weak, None
        self.rate = float(y.mean()) if len(y) else 0.0
        if len(set(y.tolist())) < 2:
            return
        unseen = np.zeros(len(y))
        for k in range(FOLDS):
            inside = folds == k
            if inside.any() and len(set(y[~inside].tolist())) == 2:
                unseen[inside] = Trees().fit(x[~inside], y[~inside]).raw(x[inside])
        self.curve = isotonic(unseen, y)
        self.trees = Trees().fit(x, y)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.rate)
        x = np.array([features(t, self.strong, self.weak) for t in texts])
        return np.clip(np.interp(self.trees.raw(x), *self.curve), 0.0, 1.0)


def lexicons(sample: DataFrame) -> list[tuple[frozenset[str], frozenset[str]]]:
    """Strong and weak lexicon, of at most ``LEXICON`` words each, by log-odds of
    the texts that hold a word and by how sure these are: learned without the
    rows of each fold, and last from all rows."""
    part = lambda k: F.when(F.col("fold") == k, 1).otherwise(0)
    sums = [F.sum(F.col("label") * part(k)).alias(f"a{k}") for k in range(FOLDS)]
    sums += [F.sum((1 - F.col("label")) * part(k)).alias(f"b{k}") for k in range(FOLDS)]
    totals = sample.agg(*sums).first().asDict()
    words = sample.select("label", "fold", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("word"))
    table = staged(words.filter("word <> ''").groupBy("word").agg(*sums).filter(" + ".join(f"a{k}" for k in range(FOLDS)) + " >= 3"), "words")

    def learn(folds: list[int]) -> tuple[frozenset[str], frozenset[str]]:
        p, q = (float(sum(totals[f"{x}{k}"] or 0 for k in folds)) for x in "ab")
        a, b = (sum((F.col(f"{x}{k}") for k in folds), F.lit(0)) for x in "ab")
        odds = F.log((a + 0.5) / (p - a + 0.5)) - F.log((b + 0.5) / (q - b + 0.5))
        expected = (a + b) * (p / (p + q) if p and q else 0.5)
        # G-statistic of the word's texts being toxic at the common rate
        sure = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / (a + b - expected))).otherwise(0))
        found = table.filter(a >= 3).select("word", odds.alias("odds"), sure.alias("sure"))
        top = lambda rows: frozenset(r["word"] for r in rows.orderBy(F.desc("sure"), "word").limit(LEXICON).collect())
        strong = top(found.filter("odds >= 2 and sure >= 20"))
        return strong, top(found.filter("odds >= 0.7 and sure >= 11")) - strong

    return [learn([k for k in range(FOLDS) if k != left]) for left in range(FOLDS)] + [learn(list(range(FOLDS)))]


def train(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label: Column, most: int = SAMPLE, seed: int = 3) -> Model:
    """Learns from up to ``most`` rows of ``labels`` that have a document."""
    marked = labels.select(F.col(id_col).alias("__id"), label.cast("int").alias("label"))
    marked = marked.filter("__id is not null and label in (0, 1)").groupBy("__id").agg(F.max("label").alias("label"))
    chosen = staged(marked.orderBy(F.xxhash64(F.lit(seed), F.col("__id").cast("string")), "__id").limit(most), "toxicity-ids")
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("__id").cast("string")), F.lit(FOLDS)).cast("int")
    # bounded by ``most`` ids; partial sums leave one text of an id in each task
    held = texts.join(F.broadcast(chosen), "__id").groupBy("__id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = staged(held.withColumn("fold", fold), "toxicity")
    words = lexicons(sample)

    @tidy
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # a row's words did not make the lexicon that it is measured by
            rows = [features(t, *words[k]) for t, k in zip(batch["text"], batch["fold"], strict=True)]
            out = pd.DataFrame(rows, columns=list(FEATURES))
            yield out.assign(label=batch["label"].to_numpy(), fold=batch["fold"].to_numpy(), id=batch["__id"].astype(str).to_numpy())

    schema = ", ".join(f"{f} double" for f in FEATURES) + ", label int, fold int, id string"
    table = sample.mapInPandas(measure, schema).toPandas().sort_values(["id", *FEATURES])
    x, y = table[list(FEATURES)].to_numpy(float), table["label"].to_numpy(float)
    return Model(*words[FOLDS], x, y, table["fold"].to_numpy())


def score(docs: DataFrame, model: Model, columns: list[Column], text_col: str = "text", name: str = "score") -> DataFrame:
    """``columns`` of each row, then the score of its text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*columns).schema.fields
    names = [f.name for f in kept]
    rows = docs.select(*columns, docs[text_col].cast("string").alias(unused("text", names)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches):
            found = sent.value.score(batch.column(len(names)).to_pylist())
            out = [*(batch.column(k) for k in range(len(names))), pa.array(found, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, [*names, name])

    return rows.mapInArrow(run, StructType([*kept, StructField(name, DoubleType())]))
