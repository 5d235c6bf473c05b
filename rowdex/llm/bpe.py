"""Byte-level BPE encoding and decoding with the tokenizers library.

The ranks of a vocabulary give its merge list: the two parts of a token are
what is left when its bytes are merged by lower ranks alone. A text is cut by
the pre-token pattern; the library encodes the distinct pre-tokens of a batch,
whose bytes it sees as printable characters (one for each byte). Offsets come
from the bytes that each id stands for and a table from the text's bytes to its
characters; a character that two tokens share is in the offsets of both.
Decoding reverses the byte table: the symbols of the ids, as the library spells
them, become the bytes that their characters stand for, and only the bytes
joined make characters, so a split character comes back whole.

Ids of pre-tokens are kept during a task in a table of bounded size, and texts
are taken a few at a time, so memory follows the longest text.
Defined results: a null text counts as empty and has no token; an id that the
vocabulary lacks raises KeyError on decoding; bytes that are not UTF-8 decode to
the replacement character where text is asked for; pairs of equal rank cannot
occur, as a rank is one token; repeated rows and rows of equal or null id get a
row each; an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowdex.llm._common import tidy
from rowdex.llm.token_count import Recent, byte_alphabet, in_pieces, rows_at_a_time

#: Pre-tokens that the library gets as one sequence of words.
TOGETHER = 256

#: Entries kept of the ids of pre-tokens, and bytes of text that are cut at a time: a
#: pre-token is a Python object, many times its bytes.
KEPT, CUT_BYTES = 75_000, 1 << 19


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token, in order of rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], rank))
            if ranks.get(parts[best] + parts[best + 1], rank) >= rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class Codec:
    """Encodes and decodes by one file of ranks."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

        ranks = read_ranks(path)
        letters = byte_alphabet()
        spell = lambda token: "".join(map(letters.__getitem__, token))
        merges = [(spell(a), spell(b)) for a, b in merges_of(ranks)]
        self.library = Tokenizer(models.BPE({spell(t): r for t, r in ranks.items()}, merges))
        self.library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        #: What each id's symbol stands for, by the byte table reversed.
        back = str.maketrans({letter: chr(byte) for byte, letter in letters.items()})
        self.tokens = {i: symbol.translate(back).encode("latin-1") for symbol, i in self.library.get_vocab().items()}
        self.widths = np.zeros(max(self.tokens) + 1, np.int64)
        for i, token in self.tokens.items():
            self.widths[i] = len(token)
        self.pattern = regex.compile(pattern)
        #: The ids of a pre-token are bytes, four for each: a third of what Python's numbers take.
        self.known = Recent(KEPT)
        self.digits = {rank: str(rank) for rank in self.tokens}

    def learn(self, pieces: set[str]) -> None:
        new = self.known.unknown(pieces)
        parts = [new[k : k + TOGETHER] for k in range(0, len(new), TOGETHER)]
        for k in range(0, len(parts), 64):
            held = parts[k : k + 64]
            for part, found in zip(held, self.library.encode_batch(held, is_pretokenized=True, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, np.int32).tobytes()
                cut = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(part) + 1))).tolist()
                self.known.update(zip(part, [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        cut = [self.pattern.findall(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        return [np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.int32) for pieces in cut]

    def offsets(self, text: str, ids: np.ndarray) -> np.ndarray:
        """The characters [start, end) that each token of a text touches, as two
        rows; tokens that share a character both have it."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.cumsum(self.widths[ids])
        starts = np.r_[0, ends[:-1]] if len(ends) else ends
        if len(raw) == len(text) and (not len(ends) or ends[-1] == len(raw)):
            return np.stack([starts, ends])
        char = np.cumsum((raw & 0xC0) != 0x80) - 1  # the character of each byte
        if len(ends) and ends[-1] != len(raw):  # the pattern leaves some characters out
            inside = np.zeros(len(text), bool)
            for m in self.pattern.finditer(text):
                inside[m.start() : m.end()] = True
            char = char[inside[char]]
        return np.stack([char[starts], char[ends - 1] + 1]) if len(ends) else np.zeros((2, 0), np.int64)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One for each worker process."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (array of int) and offsets (array of start and end) of each text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary, pattern)
        for batch in rows_at_a_time(batches):
            found = [(ids, code.offsets(t, ids)) for texts in in_pieces(_texts(batch.column(1)), CUT_BYTES) for t, ids in zip(texts, code.encode(texts), strict=True)]
            sizes = pa.array(np.cumsum([0, *(len(ids) for ids, _ in found)]), pa.int32())
            spans = np.concatenate([np.zeros((2, 0), np.int64), *(s for _, s in found)], 1).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(spans[0]), pa.array(spans[1])], ["start", "end"])
            ids = pa.array(np.concatenate([np.zeros(0, np.int32), *(i for i, _ in found)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(sizes, ids), pa.ListArray.from_arrays(sizes, pairs)], [id_col, "ids", "offsets"])
        code.known.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, ids array<int>, offsets array<struct<start:int,end:int>>"
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, schema)


def decode(rows: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each row of ids."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary, pattern)
        for batch in rows_at_a_time(batches):
            texts = [code.decode(ids or []).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(
    docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_offsets: bool = False
) -> DataFrame:
    """One row for each text: id, n_tokens, SHA-256 of its ids (decimal, one space
    between) and of the bytes that these ids decode to. with_ids: ids. with_offsets:
    n_shared, the tokens that start inside a character of the token before, and
    offsets_sha256, of all starts, then all ends, each four bytes, the low one first."""
    kinds = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    kinds += [("ids", "array<int>")] * with_ids + [("n_shared", "long"), ("offsets_sha256", "string")] * with_offsets

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(vocabulary, pattern)
        for batch in rows_at_a_time(batches):
            out: dict[str, list] = {name: [] for name, _ in kinds}
            for texts in in_pieces(_texts(batch.column(1)), CUT_BYTES):
                for text, found in zip(texts, code.encode(texts), strict=True):
                    ids = found.tolist()
                    out["n_tokens"].append(len(ids))
                    out["ids_sha256"].append(hashlib.sha256(" ".join(map(code.digits.__getitem__, ids)).encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(code.decode(ids)).hexdigest())
                    if with_ids:
                        out["ids"].append(found)
                    if with_offsets:
                        spans = code.offsets(text, found)
                        out["n_shared"].append(int((spans[0, 1:] < spans[1, :-1]).sum()))
                        out["offsets_sha256"].append(hashlib.sha256(spans.astype("<i4").tobytes()).hexdigest())
            arrow = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
            columns = [batch.column(0), *(pa.array(out[name], arrow[kind]) for name, kind in kinds)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, *out])
        code.known.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {kind}", *(f"{name} {k}" for name, k in kinds)])
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, schema)
