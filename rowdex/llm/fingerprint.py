"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over the last 7 bytes of the UTF-8 text ends a chunk wherever its
low ``k`` bits are zero; each chunk gives one of 64 characters, from a hash of
its bytes. ``k`` is the smallest for which the text has at most 64 chunks, so it
follows from the text alone, and every boundary for ``k + 1`` is one for ``k``.
A fingerprint is ``2**k:signature:signature for k + 1``.

Two fingerprints are compared where they hold signatures for one block size (2**k equal, or
one twice the other): 1 less the edit distance (insert or delete) over the sum of both lengths,
and 0 unless the signatures share some characters in a row (four; down to two where one is short). Distances of a batch are found together, one bit for each character.

``edit_report`` needs the document that comes next in descending order of id.
Rows are dealt once, by Spark's ranges of id, text hash and input partition, and
sorted; a task finishes all its rows but the last, whose next one is the first
row of a later range. These two rows of each range, with their texts, are
written with the finished ones and joined by the number of the range, a table
with one short row for each range. The driver holds no ids.

Texts are read whole, in segments, so memory follows the batch and not a
multiple of the longest text. Defined results: a null text counts as empty; the
empty text has an empty signature, which is like another empty one (1.0) and
nothing else; rows of equal id go by a hash of the text, equal rows by the input
partition; null ids come last; a single row is its own next one; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rowdex.llm._common import named, staged, tidy
from rowdex.llm._hashing import BASE, SEGMENT, UP, down
from rowdex.llm.token_count import rows_at_a_time

WINDOW, LEAST_LEVEL, LENGTH, SHARED = 7, 2, 64, 4
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
ROLL = np.array([pow(0x9E3779B1, j, 1 << 32) for j in range(1, WINDOW + 1)], np.uint32)


def boundaries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Chunk ends at the least level or above: places, levels, sums of the
    polynomial up to each; and the whole sum."""
    raw = np.frombuffer(data, np.uint8)
    places, levels, sums, total = [], [], [], 0
    for start in range(0, len(raw), SEGMENT):
        own = raw[start : start + SEGMENT]
        near = np.zeros(len(own) + WINDOW - 1, np.uint32)
        before = raw[max(0, start - WINDOW + 1) : start]
        near[WINDOW - 1 - len(before) : WINDOW - 1] = before
        near[WINDOW - 1 :] = own
        roll = np.zeros(len(own), np.uint32)
        for j in range(WINDOW):
            roll += near[WINDOW - 1 - j : WINDOW - 1 - j + len(own)] * ROLL[j]
        roll ^= roll >> np.uint32(15)
        roll *= np.uint32(0x85EBCA77)
        roll ^= roll >> np.uint32(13)
        at = np.flatnonzero((roll & np.uint32((1 << LEAST_LEVEL) - 1)) == 0)
        hit = roll[at] | np.uint32(1 << 31)
        levels.append(np.log2((hit & (~hit + np.uint32(1))).astype(np.float64)).astype(np.int64))
        running = np.cumsum((own.astype(np.uint64) + np.uint64(1)) * UP[: len(own)], dtype=np.uint64)
        far = np.uint64(pow(BASE, start, 1 << 64))
        places.append(at + start)
        sums.append(running[at] * far + np.uint64(total))
        total = (total + int(running[-1]) * int(far)) % (1 << 64)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(places, np.int64), join(levels, np.int64), join(sums, np.uint64), total


def fingerprint(text: str | None) -> str:
    data = (text or "").encode("utf-8", "surrogatepass")
    places, levels, sums, total = boundaries(data)
    above = np.cumsum(np.bincount(levels, minlength=34)[::-1])[::-1]  # boundaries at a level or above
    level = next(k for k in range(LEAST_LEVEL, 34) if above[k] < LENGTH)
    signatures = []
    for k in (level, level + 1):
        at = levels >= k
        ends, upto = places[at], sums[at]
        if len(data) and (not len(ends) or ends[-1] != len(data) - 1):
            ends, upto = np.r_[ends, len(data) - 1], np.r_[upto, np.uint64(total)]
        starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
        own = (upto - np.r_[np.zeros(1, np.uint64), upto[:-1]][: len(upto)]) * down(starts)
        own ^= own >> np.uint64(29)
        own *= np.uint64(0xBF58476D1CE4E5B9)
        signatures.append(ALPHABET[(own >> np.uint64(58)).astype(np.int64)].tobytes().decode())
    return f"{1 << level}:{signatures[0]}:{signatures[1]}"


def _matrix(signatures: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, signatures), np.int64, len(signatures))
    chars = np.frombuffer("".join(s.ljust(LENGTH, "\0") for s in signatures).encode(), np.uint8)
    return chars.reshape(-1, LENGTH), length


def signature_likeness(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair of signatures of at most 64 characters."""
    a, la = _matrix(left)
    b, lb = _matrix(right)
    same = (a[:, :, None] == b[:, None, :]) & (a != 0)[:, :, None]
    masks = np.packbits(same, axis=1, bitorder="little").transpose(0, 2, 1).copy().view(np.uint64)[:, :, 0]
    row = np.full(len(left), np.iinfo(np.uint64).max, np.uint64)
    for j in range(LENGTH):
        hit = row & masks[:, j]
        row = (row + hit) | (row & ~masks[:, j])
    common = np.unpackbits((~row)[:, None].view(np.uint8), axis=1).sum(1)
    least = np.minimum(la, lb)
    need = np.minimum(least, np.clip(least // 3, 2, SHARED))
    run, shared = same, np.where(need <= 1, same.any((1, 2)), False)
    for n in range(2, SHARED + 1):
        run = run[:, :-1, :-1] & same[:, n - 1 :, n - 1 :]
        shared = np.where(need == n, run.any((1, 2)), shared)
    both = la + lb
    return np.where(both == 0, 1.0, np.where(shared, 2 * common / np.maximum(1, both), 0.0))


def likeness(left: list[str], right: list[str]) -> np.ndarray:
    """For each pair of fingerprints, from 0 to 1."""
    out = np.zeros(len(left))
    pairs: list[tuple[int, str, str]] = []
    for k, (x, y) in enumerate(zip(left, right, strict=True)):
        (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
        if bx == by:
            pairs += [(k, x1, y1), (k, x2, y2)]
        elif int(bx) == 2 * int(by):
            pairs.append((k, x1, y2))
        elif int(by) == 2 * int(bx):
            pairs.append((k, x2, y1))
    for start in range(0, len(pairs), 512):
        part = pairs[start : start + 512]
        found = signature_likeness([p[1] for p in part], [p[2] for p in part])
        np.maximum.at(out, [p[0] for p in part], found)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches):
            found = pa.array([fingerprint(t) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], [id_col, "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, fingerprint string")


def in_ranges(docs: DataFrame, id_col: str, text_col: str, range_bytes: int) -> DataFrame:
    """id and text, dealt by ranges of descending id and sorted."""
    rows = docs.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = max(1, min(int(size[1]), -(-int(size[0] or 0) // range_bytes)))
    # equal ids and equal rows, however many, do not meet in one range
    keys = [F.desc_nulls_last("id"), F.col("mark"), F.col("origin")]
    rows = rows.withColumns({"mark": F.xxhash64("text"), "origin": F.spark_partition_id()})
    return rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "text", F.spark_partition_id().alias("part"))


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def report(text: str, own: str, after: str) -> tuple[int, str, str, str]:
    """Length, digest of the edited text, fingerprint, and that of the edited text."""
    moved = len(text) // 3
    edited = text[: len(text) - moved] + after[:moved]
    return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, fingerprint(edited)


def measured(held: list[tuple]) -> list[list]:
    """Columns of rows of ``report`` and the next fingerprint."""
    sizes, shas, own, edited, following = map(list, zip(*held, strict=True))
    return [sizes, shas, own, edited, likeness(own, edited), likeness(own, following)]


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 16 << 20) -> DataFrame:
    """For each document its fingerprint and that of its edited text, in which
    the last third gives way to the start of the next document, and the likeness
    of its fingerprint to that one and to the next document's."""
    schema = pa.schema([("id", pa.int64()), *zip(NAMES, KINDS, strict=True), ("part", pa.int32()), ("edge", pa.int32()), ("text", pa.string())])

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held = [], []
        last, part = None, None  # id, text and fingerprint of the row whose next one is due

        def flush() -> pa.RecordBatch:
            none = [None] * len(ids)
            out = batch_of([ids[:], *measured(held), none, none, none])
            ids.clear()
            held.clear()
            return out

        def edge(which: int, ident: int | None, text: str) -> pa.RecordBatch:
            return batch_of([[ident], *([None] for _ in KINDS), [part], [which], [text]])

        for batch in rows_at_a_time(batches):
            for ident, text, number in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                own = fingerprint(text)
                if last is None:
                    part = number
                    yield edge(0, ident, text)
                else:
                    ids.append(last[0])
                    held.append((*report(last[1], last[2], text), own))
                last = ident, text, own
                if len(held) >= 1000:
                    yield flush()
        if held:
            yield flush()
        if last is not None:
            yield edge(1, last[0], last[1])

    found = staged(in_ranges(docs, id_col, text_col, range_bytes).mapInArrow(run, f"id long, {SCHEMA}, part int, edge int, text string"), "reports")
    done = found.filter("edge is null").select("id", *NAMES)

    # one row for each range, in order; the last one's next is the first
    firsts = found.filter("edge = 0")
    order = firsts.select("part", F.min("part").over(Window.partitionBy()).alias("first"), F.lead("part").over(Window.orderBy("part")).alias("after"))
    order = order.select("part", F.coalesce("after", "first").alias("after"))
    lasts = found.filter("edge = 1").select("id", "text", "part").join(order, "part")
    pairs = lasts.join(firsts.select(F.col("part").alias("after"), F.col("text").alias("next_text")), "after").select("id", "text", "next_text")

    @tidy
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_at_a_time(batches, 50):
            texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if texts:
                columns = measured([(*report(t, fingerprint(t), n), fingerprint(n)) for t, n in zip(texts, following, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, KINDS, strict=True))], ["id", *NAMES])

    rows = done.unionByName(pairs.mapInArrow(finish, f"id long, {SCHEMA}"))
    return rows.select(F.col("id").alias(id_col), *NAMES)
