"""Licence scan: identifier tags and notice phrases, and licence expressions.

Text is lower-cased (A-Z) and cut into words; an Aho-Corasick automaton over the
words, joined by single spaces, finds every notice phrase and every identifier
tag in one pass. Where the automaton ends a tag, the rest of that raw line, if a
colon opens it, is a licence expression, which a shunting-yard parser turns into
postfix form and evaluates: ``or`` takes the freer side, ``and`` the stricter
one, ``with`` adds an exception to a licence.

An identifier is made of letters, digits, ``.``, ``+`` and ``-``; it has the
label of the table entry that it equals or continues behind ``-`` or ``.``, else
the label ``unknown``. Labels hold no comma.

Every text is scanned whole, however long, a few hundred texts at a time, so
memory follows the longest text and not the input. Defined results: a null or
empty text has no word, no place, no label and score 0; an expression that does
not parse yields the identifiers of the table that it names; a tag with nothing
behind it on its line yields nothing; phrases that overlap all count, and of
several places of one start each counts; repeated rows and rows of equal or null
id are scanned one by one; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from rowdex.llm.token_count import rows_at_a_time

#: The base phrases, whose places are counted, and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further notice phrases and their labels.
NOTICE_PHRASES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "boost software license": "bsl",
    "isc license": "isc",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "all rights reserved": "proprietary",
}

#: The identifier tag, as words and as it is written.
TAG, TAG_TEXT = "spdx license identifier", b"spdx-license-identifier"

#: Identifiers by their beginning, the longest first, and their label.
IDENTIFIERS = {
    "apache-2": "apache-2", "mit": "mit", "bsd": "bsd", "isc": "isc", "bsl": "bsl", "cc0": "cc0",
    "unlicense": "public-domain", "agpl": "agpl", "lgpl": "lgpl", "gpl": "gpl", "mpl": "mpl", "epl": "epl",
    "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by",
}

#: How freely text under a label may be used, from 0 to 1.
FREEDOM = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "bsl": 0.95, "apache-2": 0.9, "cc-by": 0.9,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "unknown": 0.4, "gpl": 0.3, "agpl": 0.2, "cc-by-nd": 0.2, "cc-by-nc": 0.1, "proprietary": 0.0,
}
UNKNOWN, EXCEPTION_GAIN = "unknown", 0.2

SMALL_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+-]+|[^\s()A-Za-z0-9.+-]+")
NAME = re.compile(r"[A-Za-z0-9.+-]+")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: What may stand behind a tag, and what frames an expression in a comment.
BEHIND, FRAME = re.compile(rb"[ \t]*:([^\r\n]*)"), " \t*/#->;,."
BINDING = {"or": 1, "and": 2, "with": 3}


def normalise(text: str | None) -> tuple[str, int]:
    """Words between single spaces, one byte a character, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(SMALL_BYTES).split()
    return f" {b' '.join(words).decode('latin-1')} ", len(words)


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICE_PHRASES, **BASE_PHRASES}.items():
        found.add_word(f" {phrase} ", (phrase in BASE_PHRASES, label, len(phrase.split())))
    found.add_word(f" {TAG} ", (False, None, len(TAG.split())))
    found.make_automaton()
    return found


def label_of(identifier: str) -> str:
    """The label of the longest table entry that the identifier equals or continues."""
    name = identifier.lower().rstrip("+")
    starts = (k for k in IDENTIFIERS if name == k or name.startswith((f"{k}-", f"{k}.")))
    start = max(starts, key=len, default=None)
    return IDENTIFIERS[start] if start else UNKNOWN


def to_postfix(expression: str) -> list[str]:
    """Shunting yard. Raises ValueError on an expression that does not parse."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression):
        word = token.lower()
        if word == "(":
            if not operand_next:
                raise ValueError("operator expected")
            held.append(word)
        elif word == ")":
            if operand_next:
                raise ValueError("operand expected")
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                raise ValueError("unbalanced parenthesis")
            held.pop()
        elif word in BINDING:
            if operand_next:
                raise ValueError("operand expected")
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[word]:
                out.append(held.pop())
            held.append(word)
            operand_next = True
        else:
            if not operand_next:
                raise ValueError("operator expected")
            if not NAME.fullmatch(token):
                raise ValueError("not an identifier")
            out.append(token)
            operand_next = False
    if operand_next:
        raise ValueError("operand expected")
    while held:
        if held[-1] == "(":
            raise ValueError("unbalanced parenthesis")
        out.append(held.pop())
    return out


def evaluate(expression: str) -> tuple[set[str], float]:
    """Labels that the expression names and its freedom."""
    try:
        postfix = to_postfix(expression)
    except ValueError:
        names = {label_of(t) for t in TOKEN.findall(expression)} - {UNKNOWN}
        return names, min((FREEDOM[n] for n in names), default=0.0)
    values: list[tuple[set[str], float]] = []
    for token in postfix:
        if token not in BINDING:
            name = label_of(token)
            values.append(({name}, FREEDOM[name]))
            continue
        (right, free_right), (left, free_left) = values.pop(), values.pop()
        if token == "with":
            values.append((left, min(1.0, free_left + EXCEPTION_GAIN)))
        else:
            values.append((left | right, (max if token == "or" else min)(free_left, free_right)))
    return values[0]


def expressions(text: str, tags: list[int]) -> Iterator[str]:
    """Behind each tag, given by the number of its first word in ascending order,
    the expression on its line."""
    data, due = text.encode("utf-8", "surrogatepass"), iter(tags)
    wanted, begin = next(due, None), 0
    for k, word in enumerate(WORD.finditer(data)):
        if wanted is None:
            return
        if k == wanted:
            begin = word.start()
        if k == wanted + 2:
            line = BEHIND.match(data, word.end()) if data[begin : word.end()].lower() == TAG_TEXT else None
            if line:
                yield line[1].decode("utf-8", "replace").strip(FRAME)
            wanted = next(due, None)


def scan(text: str | None) -> tuple:
    """(words, base places, first, last, base labels, labels, freedom)"""
    line, n_words = normalise(text)
    places, base, labels, free, tags = [], set(), set(), [], []
    spaces = upto = 0
    for end, (is_base, label, length) in automaton().iter(line):
        spaces, upto = spaces + line.count(" ", upto, end), end
        if label is None:
            tags.append(spaces - length)
            continue
        labels.add(label)
        free.append(FREEDOM[label])
        if is_base:
            places.append(spaces - length)
            base.add(label)
    for expression in expressions(text, tags) if tags else ():
        names, freedom = evaluate(expression)
        labels |= names
        if names:
            free.append(freedom)
    return (
        n_words, len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), min(free, default=0.0),
    )


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
ARROW = pa.schema(
    [(c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")]
    + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows_at_a_time(batches):
        found = list(zip(*map(scan, batch.column(1).to_pylist()), strict=True)) or [[]] * len(ARROW)
        columns = [pa.array(v, f.type) for v, f in zip(found, ARROW, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [batch.schema.names[0], *ARROW.names])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: its id and the columns of ``scan``. score is
    the freedom of all that was found taken together, 0 where nothing was."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(_scan_batches, f"`{id_col}` {kind}, {SCHEMA}")
