"""Token counts of a byte-level BPE by rank-synchronous merging of numpy arrays.

The distinct pre-tokens of a batch that have no count yet are held as one ragged
array of symbols with the number of their sequence. In each round every sequence
finds the lowest rank among its pairs and merges that pair everywhere it stands,
all sequences at once; a sequence without a known pair is finished and counted.
As a merge makes only pairs of higher rank, this is the order of the merge list.

Counts of pre-tokens are kept during a task in a table of bounded size; a
text's count is a sum over its pre-tokens. Texts are cut into pre-tokens a few
at a time, so memory is bounded by the longest text and not by the batch.
Defined results: a null text counts as empty, with no byte and no token; other
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowdex.llm._common import tidy

#: Entries kept of the counts of pre-tokens, and bytes of text that are cut at a time.
KEPT, CUT_BYTES = 150_000, 2 << 20


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte: printable Latin-1
    bytes for themselves, all others for the characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class MergeTable:
    """Ranks of pairs, from the JSON file of a tokenizer."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        self.width = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        letters = byte_alphabet()
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        #: Special strings that the library takes out of a text before the pattern.
        self.special = [t["content"] for t in model.get("added_tokens", []) if t.get("special")]
        self.none = len(pairs)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols that are left of each piece after all merges."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbols = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), length)
        out = np.zeros(len(pieces), np.int64)
        rank = np.full(len(symbols), self.none, np.int64)
        if len(symbols) > 1:
            rank[:-1] = np.where(owner[1:] == owner[:-1], self.rank(symbols[:-1], symbols[1:]), self.none)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == self.none
            if done.any():
                out[owner[starts[done]]] = sizes[done]
                alive = np.repeat(~done, sizes)
                symbols, owner, rank = symbols[alive], owner[alive], rank[alive]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, sizes)
            at = np.flatnonzero(hit)
            # of a run of hits side by side (one symbol repeated), every other one merges
            run = np.r_[True, np.diff(at) > 1]
            within = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[within % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            place = np.cumsum(stay) - 1
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            new = place[at]
            redo = np.unique(np.r_[new, new[new > 0] - 1])
            rank[redo] = self.none
            redo = redo[redo + 1 < len(symbols)]
            redo = redo[owner[redo] == owner[redo + 1]]
            rank[redo] = self.rank(symbols[redo], symbols[redo + 1])
        return out


class Recent(dict):
    """What is known about pre-tokens, up to twice ``most`` entries: when the
    table is full it becomes the older one, from which what is used comes back."""

    def __init__(self, most: int = KEPT):
        super().__init__()
        self.most, self.older = most, {}

    def forget(self) -> None:
        """At the end of a task: an idle worker should hold no table."""
        self.older = {}
        self.clear()

    def unknown(self, wanted: set[str]) -> list[str]:
        """What of ``wanted`` is in neither table; the rest is in this one afterwards."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        missing = [p for p in wanted if p not in self]
        if not self.older:
            return missing
        older = self.older
        self.update((p, older[p]) for p in missing if p in older)
        return [p for p in missing if p not in older]


class Counter:
    """Counts tokens of texts; keeps what it knows about pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.table, self.known = MergeTable(path), Recent()
        self.pieces = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, self.table.special))) if self.table.special else None

    def cut(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stood between them."""
        if self.special is None or not any(s in text for s in self.table.special):
            return self.pieces(text), 0
        parts = self.special.split(text)
        return [p for part in parts for p in self.pieces(part)], len(parts) - 1

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        new = self.known.unknown({p for pieces, _ in cut for p in pieces})
        if new:
            self.known.update(zip(new, self.table.counts([p.encode("utf-8") for p in new]).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, pieces)) + n for pieces, n in cut]


_COUNTERS: dict[tuple[str, str], Counter] = {}


def counter(path: str, pattern: str) -> Counter:
    """One for each worker process."""
    if (path, pattern) not in _COUNTERS:
        _COUNTERS[path, pattern] = Counter(path, pattern)
    return _COUNTERS[path, pattern]


def in_pieces(texts: list[str], most: int = CUT_BYTES) -> Iterator[list[str]]:
    """Neighbouring texts together, up to so many characters."""
    held, size = [], 0
    for text in texts:
        if held and size + len(text) > most:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def rows_at_a_time(batches: Iterator[pa.RecordBatch], most: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: Python objects of a few hundred texts at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most)


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_bytes, n_tokens, over_limit."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary, pattern)
        for batch in rows_at_a_time(batches):
            sizes, tokens = [], []
            for texts in in_pieces([t or "" for t in batch.column(1).to_pylist()]):
                sizes += [len(t.encode("utf-8")) for t in texts]
                tokens += count.count(texts)
            columns = [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_bytes", "n_tokens", "over_limit"])
        count.known.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
