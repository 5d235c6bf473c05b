"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, every run of other characters is one space, and the
n-grams of 1 to 3 characters of that string are hashed into buckets. Training
sums bucket counts by language over the sample on the executors; the matrix of
log-probabilities (languages by buckets, a size that the parameters bound) is
broadcast. A batch is scored as a sparse matrix, documents by buckets in
compressed rows, times that dense matrix: values are gathered by bucket and
summed by row.

The sample: the rows of each language are dealt to ``per_language`` bins by a
seeded hash of id and text, and the row with the smallest hash of each bin is
learned from. That is one aggregation with partial sums, gives at most
``per_language`` rows of a language however many share an id, and takes nothing
for granted about ids. Equal rows are one, as equal texts of one id teach the
same; rows without an id are learned from like others. A language with few rows
loses those that share a bin (of 200 rows in 1000 bins about 20).

Whole texts are read in training and in scoring; a text of more than
``SEGMENT`` characters is taken in segments, so memory does not follow its
length. Defined results: null text, or text without a letter (by
``str.isalpha``; combining marks and emoji are none), is ``und`` with score 0;
with nothing to learn from, every text is ``und``; ties between languages go to
the first in order of name; repeated rows and rows of equal or null id get a row
each; an empty table gives no rows; more than ``MOST_LANGUAGES`` languages raise
ValueError, as the matrix would outgrow a broadcast; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from rowdex.llm._common import staged, tidy, unused
from rowdex.llm.token_count import in_pieces, rows_at_a_time

ORDERS, BUCKET_BITS, PER_LANGUAGE, MOST_LANGUAGES = (1, 2, 3), 16, 1000, 400
#: Characters that are hashed at a time.
SEGMENT = 1 << 18
UNDETERMINED = "und"
#: Odd multipliers of the hash, one for each place in an n-gram.
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point its lower-case letter (a mark stands for itself), or
    the space if it is neither."""
    table = np.full(0x110000, 32, np.uint32)
    for point in range(0x110000):
        if (c := chr(point)).isalpha() or unicodedata.category(c)[0] == "M":
            table[point] = ord(c.lower()[0])
    return table


@lru_cache(maxsize=1)
def is_letter() -> np.ndarray:
    return np.array([chr(point).isalpha() for point in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(chars: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Buckets of the n-grams of a string of letters and spaces."""
    last = max(0, len(chars) - n + 1)
    mixed = np.full(last, n, np.uint32)
    for k in range(n):
        mixed = (mixed ^ chars[k : k + last]) * FACTORS[k]
        mixed ^= mixed >> np.uint32(15)
    return (mixed * FACTORS[3]) >> np.uint32(32 - bits)


def grams(texts: list[str], bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Compressed rows of the n-grams of texts: row starts, buckets; and for each
    text whether it has a letter."""
    points = [code_points(t) for t in texts]
    sizes = np.array([len(p) + 1 for p in points])
    space = np.array([32], np.uint32)
    chars = np.concatenate([x for p in points for x in (space, p)] or [space])
    row = np.repeat(np.arange(len(texts)), sizes)
    lettered = np.bincount(row[is_letter()[chars[: len(row)]]], minlength=len(texts)) > 0
    chars = letters()[chars]
    keep = (chars != 32) | np.r_[True, chars[:-1] != 32] | np.r_[True, row[1:] != row[:-1]]
    chars, row = chars[keep], row[keep]
    buckets, rows = [], []
    for n in ORDERS:
        if len(chars) < n:
            continue
        last = len(chars) - n + 1
        whole = row[:last] == row[n - 1 :]
        buckets.append(hashed(chars, n, bits)[whole])
        rows.append(row[:last][whole])
    if not buckets:
        return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), lettered
    counts = [np.bincount(r, minlength=len(texts)) for r in rows]
    starts = np.r_[0, np.cumsum(sum(counts))]
    out = np.empty(starts[-1], np.uint32)
    offset = starts[:-1].copy()
    for b, r, c in zip(buckets, rows, counts, strict=True):
        first = np.r_[0, np.cumsum(c)][:-1]
        out[offset[r] + np.arange(len(r)) - first[r]] = b
        offset += c
    return starts, out, lettered


def long_counts(text: str, bits: int = BUCKET_BITS) -> tuple[np.ndarray, bool]:
    """How often each bucket comes in one long text, and whether it has a letter."""
    sums, lettered = np.zeros(1 << bits, np.int64), False
    held = np.array([32], np.uint32)  # the last characters before the segment, as they were kept
    if 1 in ORDERS:
        sums += np.bincount(hashed(held, 1, bits), minlength=1 << bits)
    for start in range(0, len(text), SEGMENT):
        points = code_points(text[start : start + SEGMENT])
        lettered = lettered or bool(is_letter()[points].any())
        chars = np.r_[held, letters()[points]]
        keep = (chars != 32) | np.r_[True, chars[:-1] != 32]
        keep[: len(held)] = True
        chars = chars[keep]
        for n in ORDERS:
            # n-grams that end in this segment
            sums += np.bincount(hashed(chars[max(0, len(held) - n + 1) :], n, bits), minlength=1 << bits)
        held = chars[-(max(ORDERS) - 1) :]
    return sums, lettered


def short_and_long(texts: list[str]) -> Iterator[list[str]]:
    """Texts in order, some at a time; one longer than a segment by itself."""
    held: list[str] = []
    for text in texts:
        if len(text) > SEGMENT:
            yield from in_pieces(held)
            yield [text]
            held = []
        else:
            held.append(text)
    yield from in_pieces(held)


class Model:
    """Log-probabilities, languages by buckets, and log-priors."""

    def __init__(self, counts: pd.DataFrame, documents: dict[str, int], bits: int = BUCKET_BITS):
        self.names, self.bits = sorted(documents), bits
        matrix = np.full((len(self.names), 1 << bits), 0.5)
        place = {name: k for k, name in enumerate(self.names)}
        if len(counts):
            np.add.at(matrix, (counts["lang"].map(place).to_numpy(), counts["bucket"].to_numpy()), counts["n"].to_numpy())
        self.logs = np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32).T.copy()
        total = np.array([documents[name] for name in self.names], float)
        self.prior = np.log(total / total.sum()) if len(total) else total

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.names or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.names)))
        if len(texts) == 1 and len(texts[0]) > SEGMENT:
            sums, found = long_counts(texts[0], self.bits)
            at, lettered = np.flatnonzero(sums), np.array([found])
            for k in range(len(self.names)):
                total[0, k] = sums[at] @ self.logs[at, k].astype(np.float64)
        else:
            starts, buckets, lettered = grams(texts, self.bits)
            some = np.diff(starts) > 0
            if some.any():
                for k in range(len(self.names)):
                    total[some, k] = np.add.reduceat(self.logs[buckets, k].astype(np.float64), starts[:-1][some])
        total += self.prior
        best = total.argmax(1)
        odds = np.exp(total - total.max(1, keepdims=True))
        score = odds[np.arange(len(texts)), best] / odds.sum(1)
        names = [self.names[k] if ok else UNDETERMINED for k, ok in zip(best, lettered, strict=True)]
        return names, np.where(lettered, score, 0.0)


def draw(docs: DataFrame, lang: Column, text: Column, ident: Column, per_language: int, seed: int) -> DataFrame:
    """lang and text of the rows to learn from, at most ``per_language`` of a language."""
    rows = docs.select(lang.cast("string").alias("lang"), text.cast("string").alias("text"), ident.cast("string").alias("ident"))
    rows = rows.filter("lang is not null and text is not null").withColumn("mark", F.xxhash64(F.lit(seed), "ident", "text"))
    least = rows.groupBy("lang", F.pmod("mark", F.lit(per_language)).alias("bin")).agg(F.min("mark").alias("mark"))
    chosen = staged(least.select("lang", "mark"), "langid-marks")
    # languages times per_language rows of 16 bytes; ``train`` bounds the languages
    near = rows.join(F.broadcast(chosen), ["lang", "mark"]).select("lang", "mark", "text")
    return staged(near.dropDuplicates(["lang", "mark"]).select("lang", "text"), "langid")


def train(docs: DataFrame, lang: Column, text: Column, ident: Column, per_language: int = PER_LANGUAGE, seed: int = 5) -> Model:
    """Learns from up to ``per_language`` rows of each language."""
    few = docs.select(lang.cast("string").alias("lang")).filter("lang is not null").distinct().limit(MOST_LANGUAGES + 1).count()
    if few > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sample = draw(docs, lang, text, ident, per_language, seed)

    @tidy
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, texts in batch.groupby("lang")["text"]:
                sums = np.zeros(1 << BUCKET_BITS, np.int64)
                for part in short_and_long(list(texts)):
                    if len(part) == 1 and len(part[0]) > SEGMENT:
                        sums += long_counts(part[0])[0]
                    else:
                        sums += np.bincount(grams(part)[1], minlength=1 << BUCKET_BITS)
                at = np.flatnonzero(sums)
                yield pd.DataFrame({"lang": name, "bucket": at, "n": sums[at]})

    counts = sample.mapInPandas(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    documents = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # at most MOST_LANGUAGES times the buckets
    return Model(counts.toPandas(), documents)


def identify(docs: DataFrame, model: Model, columns: list[Column], text_col: str = "text") -> DataFrame:
    """``columns`` of each row, then lang_pred and score of its text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*columns).schema.fields
    names = [f.name for f in kept]
    rows = docs.select(*columns, docs[text_col].cast("string").alias(unused("text", names)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches):
            langs, scores = [], []
            for texts in short_and_long([t or "" for t in batch.column(len(names)).to_pylist()]):
                found, score = sent.value.predict(texts)
                langs += found
                scores += score.tolist()
            out = [*(batch.column(k) for k in range(len(names))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(out, [*names, "lang_pred", "score"])

    return rows.mapInArrow(run, StructType([*kept, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
