"""N-gram Jaccard join: which documents share at least 80 of 100 word n-grams.

The join is the product of the incidence matrix, documents by n-grams, with its
transpose, of which only entries above a bound are wanted. It is taken in
blocks, and each block only as far as the sizes of its rows require:

1. Columns are ordered by how many documents hold them, rare ones first. Two
   documents that link share one of the first ``n - ceil(0.8 n) + 1`` n-grams of
   each, so only these columns (prefixes) name candidates. The order comes from
   counts of all documents in a table of fixed size; any order gives all links,
   this one keeps passages that many documents share out of the prefixes.
2. A candidate pair needs sizes within 0.8 of each other and, from the places of
   the shared n-gram, room for the overlap that its sizes require. Then its
   sketches, a bit of parity for each class of hashes, must not differ in more
   places than the sets may. Only rows of pairs that pass are read in whole.
3. Blocks of rows are multiplied on numpy arrays: left rows, and the right rows
   that are paired with one of them. All entries of a block accumulate overlap
   counts at once, and pairs below the bound of their sizes are discarded. Blocks
   hold bounded numbers of rows and n-grams; a left row with very many right rows
   is in several.

Documents with one and the same set are one row of the matrix, named by a number
that is given once to each set, not by an id. The pairs inside a group of near
copies are not formed: first each column's rows meet one centre for each band of
sizes, and the links found join rows into components. These rounds go on while
they close many of the pairs that are open. Then every pair of rows that share a
prefix column and lie in different components is tested, so no link between
components is lost: as a pair of rows where a column leaves few such pairs, and
where it leaves many inside blocks of a group, which give back links only. In
such a block stand rows outside their group's main component against rows of the
whole group.

Links are exact but for equal 64-bit hashes of different n-grams. Defined
results: a text with fewer words than ``n`` is one n-gram; without words (or
null) it has none and links with nothing; a long text is read in segments and
has one set like others; rows that share an id are one document, which links as
each of its texts does, and all of them have its component; rows without an id
are documents of their own, and their component is the smallest id that links
reach, null if they reach none; ties do not occur, as each pair either links or
not; an empty table gives no rows; other columns are ignored, whatever their
names, and kept as they are by ``drop_similar_documents``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowdex.llm._common import BitFilter, named, packed, rows_once, rows_without, staged, tidy
from rowdex.llm._hashing import BASE, SEGMENT, UP, down, mix
from rowdex.llm.components import components
from rowdex.llm.token_count import in_pieces

WORDS, PERCENT = 5, 80
#: Cells of the table of counts, and the blocks in which it is summed.
CELL_BITS, BLOCK_BITS = 24, 14
#: Sets after which a task gives its counts away: its cells of 16 bits would overflow only
#: if each set had four n-grams in one cell. Rows of an Arrow batch of texts.
CELL_SETS, TEXT_ROWS = 16_384, 1000
#: Rounds with centres end when open pairs are fewer than this many for each prefix entry.
OPEN_PAIRS, MOST_ROUNDS = 0.5, 12
#: A column with more open pairs is left to blocks; rows and n-grams of a block's two sides.
#: Right rows are as many as the group has left rows, but SQUARE_ROWS at least, so that
#: copies of left rows do not outnumber the group and a block of few left rows is small.
WIDE_PAIRS, SQUARE_ROWS = 200, 256
LEFT_ROWS, RIGHT_ROWS, LEFT_GRAMS, RIGHT_GRAMS = 1024, 4096, 200_000, 800_000
#: Right rows and n-grams that one left row meets in a block of pairs.
PAIR_ROWS, PAIR_GRAMS = 256, 800_000

SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
IS_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word of some bytes, a segment at a time. raw
    ends with a space."""
    words, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    total, inside, open_at, open_sum = 0, False, 0, np.uint64(0)
    for start in range(0, len(raw), SEGMENT):
        own = raw[start : start + SEGMENT]
        held = ~IS_SPACE[own]
        edge = np.flatnonzero(np.diff(np.r_[inside, held].astype(np.int8)))
        far = np.uint64(pow(BASE, start, 1 << 64))
        sums = np.r_[np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * UP[: len(own)], dtype=np.uint64)]
        at, upto = edge + start, sums[edge] * far + np.uint64(total)
        if inside:  # the word that the last segment left open
            at, upto = np.r_[open_at, at], np.r_[open_sum, upto]
        total = (total + int(sums[-1]) * int(far)) % (1 << 64)
        inside = bool(held[-1])
        if inside:
            open_at, open_sum = at[-1], upto[-1]
            at, upto = at[:-1], upto[:-1]
        first = at[::2]
        words.append(mix((upto[1::2] - upto[::2]) * down(first)))
        starts.append(first)
    return np.concatenate(words), np.concatenate(starts)


def ngram_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """The distinct n-gram hashes of each text, in ascending order."""
    datas = [t.encode("utf-8", "surrogatepass").translate(SMALL) for t in texts]
    bounds = np.cumsum([0, *(len(d) + 1 for d in datas)])
    raw = np.frombuffer(b"\n".join([*datas, b""]), np.uint8)
    del datas
    words, starts = word_hashes(raw)
    bounds = np.searchsorted(starts, bounds)
    grams = words[: max(0, len(words) - n + 1)].copy()
    for k in range(1, n):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams += words[k : k + len(grams)]
        grams ^= grams >> np.uint64(32)
    grams = mix(grams)
    out = [np.zeros(0, np.uint64)] * len(texts)
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if b - a >= n:
            out[k] = np.unique(grams[a : b - n + 1])
        elif b > a:
            whole = hashlib.blake2b(words[a:b].tobytes(), digest_size=8, salt=b"short").digest()
            out[k] = np.frombuffer(whole, np.uint64).copy()
    return out


def sketch(grams: np.ndarray) -> bytes:
    """Parities of the numbers of n-grams by class, a bit for each; about as many
    classes as n-grams. Sets differ in at least as many places as their sketches."""
    bits = max(64, 1 << (len(grams) - 1).bit_length()) if len(grams) else 64
    classes = (grams >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(classes.astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def sketch_distance(left: bytes, right: bytes) -> int:
    """In how many places two sketches differ; the wider one is folded first."""
    a, b = int.from_bytes(left, "little"), int.from_bytes(right, "little")
    n, m = 8 * len(left), 8 * len(right)
    while n > m:
        n //= 2
        a = (a >> n) ^ (a & ((1 << n) - 1))
    while m > n:
        m //= 2
        b = (b >> m) ^ (b & ((1 << m) - 1))
    return (a ^ b).bit_count()


def set_name(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """The other columns of each row, and the set of its text, the last column."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            *others, texts = (c.to_pylist() for c in part.columns)
            rows, at = list(zip(*others, strict=True)), 0
            for some in in_pieces([t or "" for t in texts], 1 << 20):
                yield from zip(rows[at : at + len(some)], ngram_sets(some, n), strict=True)
                at += len(some)


def _batch(columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _count_pass(n: int):
    """Rows of a partition: the name and size of each document's set, and blocks
    of the counts of n-grams by cell (sets that repeat inside a partition count once)."""
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary()), ("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("name", pa.binary()), ("n", pa.int64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen, held, counted = np.zeros(1 << CELL_BITS, np.uint16), set(), [], 0

        def flush() -> pa.RecordBatch:
            empty = [None] * len(held)
            out = _batch([empty, empty, *zip(*held, strict=True)], schema)
            held.clear()
            return out

        def blocks() -> Iterator[pa.RecordBatch]:
            size = 1 << BLOCK_BITS
            for start in range(0, len(cells) // size, 64):
                some = [k for k in range(start, start + 64) if cells[k * size : (k + 1) * size].any()]
                packed_counts = [zlib.compress(cells[k * size : (k + 1) * size].tobytes(), 1) for k in some]
                yield _batch([some, packed_counts, *[[None] * len(some)] * 5], schema)
            cells[:] = 0

        for (ident, k1, k2), grams in _sets(batches, n):
            name = set_name(grams)
            held.append((ident, k1, k2, name, len(grams)))
            if name is not None and name not in seen:
                seen.add(name)
                np.add.at(cells, grams & np.uint64((1 << CELL_BITS) - 1), 1)
                counted += 1
                if counted % CELL_SETS == 0:
                    yield from blocks()
            if len(held) >= 5000:
                yield flush()
        if held:
            yield flush()
        yield from blocks()

    return run, "block int, counts binary, id long, k1 long, k2 long, name binary, n long"


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a partition, whose rows come sorted by block; each
    count as the integer part of 12 times its logarithm, as only its rank matters."""
    at, total = None, None

    def row():
        packed = np.minimum(255, 12 * np.log1p(total)).astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed], pa.binary())], ["block", "ranks"])

    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if block != at:
                if at is not None:
                    yield row()
                at, total = block, np.zeros(1 << BLOCK_BITS, np.uint64)
            total += np.frombuffer(zlib.decompress(counts), np.uint16)
    if at is not None:
        yield row()


def prefix_length(size: int, percent: int = PERCENT) -> int:
    return size - -(-percent * size // 100) + 1


def _set_pass(n: int, percent: int, sent):
    """Each set that a partition holds, once: its name, a row that has it, size,
    sketch, and the n-grams of its prefix in their order."""
    schema = pa.schema([("name", pa.binary()), ("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary()), ("prefix", pa.list_(pa.int64()))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, seen, held, rows = sent.value, set(), [], 0
        for (_, k1, k2), grams in _sets(batches, n):
            name = set_name(grams)
            if name is None or name in seen:
                continue
            seen.add(name)
            order = np.argsort(ranks[grams & np.uint64((1 << CELL_BITS) - 1)], kind="stable")
            first = grams[order[: prefix_length(len(grams), percent)]].view(np.int64)
            held.append((name, k1, k2, len(grams), sketch(grams), first))
            rows += len(first)
            if rows >= 100_000:
                yield _batch(zip(*held, strict=True), schema)
                held, rows = [], 0
        if held:
            yield _batch(zip(*held, strict=True), schema)

    return run, "name binary, k1 long, k2 long, size int, sketch binary, prefix array<long>"


def needed(left: str, right: str, percent: int):
    """The overlap that two sizes require: percent / (100 + percent) of their sum, rounded up."""
    return F.ceil((F.col(left) + F.col(right)) * F.lit(percent) / F.lit(100 + percent))


def _within(percent: int):
    """Whether sizes and places of a shared prefix n-gram leave room for a link."""
    sizes = F.least("size", "size2") * 100 >= F.greatest("size", "size2") * percent
    room = F.least("place", "place2") + 1 + F.least(F.col("size") - F.col("place"), F.col("size2") - F.col("place2")) - 1
    return sizes & (room >= needed("size", "size2", percent))


def _near(percent: int):
    """Pairs (a, b) whose sketches and sizes leave room for a link, with the size of b."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, size, size2 = (batch.column(k).to_numpy() for k in range(4))
            apart = [sketch_distance(x, y) for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)]
            both = size + size2
            keep = np.array(apart, np.int64) <= both - 2 * -(-percent * both // (100 + percent))
            columns = [pa.array(a[keep], pa.int64()), pa.array(b[keep], pa.int64()), pa.array(size2[keep], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "size"])

    return run


def product(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of all rows of ``left`` with all of ``right``."""
    out = np.zeros((len(left), len(right)), np.float32)
    lc, rc = np.concatenate(left), np.concatenate(right)
    lrow = np.repeat(np.arange(len(left)), [len(x) for x in left])
    rrow = np.repeat(np.arange(len(right)), [len(x) for x in right])
    both = np.intersect1d(lc, rc)
    if not len(both):
        return out
    at = np.minimum(np.searchsorted(both, lc), len(both) - 1)
    lin = both[at] == lc
    lcol, lrow = at[lin], lrow[lin]
    at = np.minimum(np.searchsorted(both, rc), len(both) - 1)
    rin = both[at] == rc
    rcol, rrow = at[rin], rrow[rin]
    nl, nr = np.bincount(lcol, minlength=len(both)), np.bincount(rcol, minlength=len(both))
    dense = nl * nr > out.size / 100
    for some in np.array_split(np.flatnonzero(dense), max(1, -(-int(dense.sum()) // 512))):
        if len(some):
            a, b = np.zeros((len(left), len(some)), np.float32), np.zeros((len(right), len(some)), np.float32)
            for rows, cols, part in ((lrow, lcol, a), (rrow, rcol, b)):
                place = np.minimum(np.searchsorted(some, cols), len(some) - 1)
                hit = some[place] == cols
                part[rows[hit], place[hit]] = 1
            out += a @ b.T
    # the other columns: each right entry with all left entries of its column
    order = np.argsort(lcol, kind="stable")
    lrow, first = lrow[order], np.r_[0, np.cumsum(nl)][:-1]
    thin = ~dense[rcol]
    rcol, rrow = rcol[thin], rrow[thin]
    upto = np.cumsum(nl[rcol])
    start = 0
    while start < len(rcol):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + 4_000_000, "right")))
        times = nl[rcol[start:end]]
        within = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        np.add.at(out, (lrow[np.repeat(first[rcol[start:end]], times) + within], np.repeat(rrow[start:end], times)), 1)
        start = end
    return out


def linked(overlap: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (left[:, None] + right[None, :] - overlap)


def _sets_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


def own_overlaps(left: list[np.ndarray], right: list[np.ndarray], owner: np.ndarray) -> np.ndarray:
    """The product's entries at (owner of each right row, right row): how many
    n-grams each right row shares with its left row."""
    if not len(right):
        return np.zeros(0, np.int64)
    mark = np.uint64(0xD6E8FEB86659FD93)
    keys = np.concatenate(left) ^ (np.repeat(np.arange(len(left)), [len(x) for x in left]).astype(np.uint64) * mark)
    keys.sort()
    sizes = [len(x) for x in right]
    row = np.repeat(np.arange(len(right)), sizes)
    asked = np.concatenate(right) ^ (owner[row].astype(np.uint64) * mark)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.bincount(row[keys[at] == asked], minlength=len(right))


def _multiply(percent: int):
    """Links among pairs. Rows come sorted by left row a and part: first the set
    of a, then those of the right rows b of that part."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        names: list[int] = []
        right: list[np.ndarray] = []
        pairs: list[tuple[int, int]] = []  # place in left, b
        held = 0

        def block() -> pa.RecordBatch:
            owner = np.array([p for p, _ in pairs], np.int64)
            both = np.array([len(x) for x in left])[owner] + np.array([len(x) for x in right])
            overlap = own_overlaps(left, right, owner)
            keep = np.flatnonzero(100 * overlap >= percent * (both - overlap))
            a, b = [names[pairs[k][0]] for k in keep], [pairs[k][1] for k in keep]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for a, b, grams in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), _sets_of(part.column(2)), strict=True):
                    if b is None:
                        left.append(grams)
                        names.append(a)
                    else:
                        right.append(grams)
                        pairs.append((len(left) - 1, b))
                    held += len(grams)
                    if held >= RIGHT_GRAMS and pairs:
                        yield block()
                        # the last left row goes on with the next block
                        left, names, right, pairs, held = left[-1:], names[-1:], [], [], len(left[-1])
        if pairs:
            yield block()

    return run


def _block(percent: int):
    """Links of one block between rows of different components, one for each row
    of its left side and component."""

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        ids, kinds = table.column("rep").to_numpy(), table.column("component").to_numpy()
        sets = _sets_of(table.column("grams"))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        pairs = set()
        if len(left) and len(right):
            sizes = np.array([len(x) for x in sets])
            found = linked(product([sets[k] for k in left], [sets[k] for k in right]), sizes[left], sizes[right], percent)
            found &= kinds[left][:, None] != kinds[right][None, :]
            seen = set()
            for x, y in zip(*np.nonzero(found), strict=True):
                if (x, kinds[right[y]]) not in seen:
                    seen.add((x, kinds[right[y]]))
                    pairs.add((int(ids[left[x]]), int(ids[right[y]])))
        a, b = map(list, zip(*sorted(pairs), strict=True)) if pairs else ([], [])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


class Join:
    """The state of one join; ``run`` gives its components."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, n: int = WORDS, percent: int = PERCENT, seed: int = 23):
        self.n, self.percent, self.seed = n, percent, seed
        self.rows = docs.select(*row_keys(id_col, text_col), named(text_col).cast("string").alias("text"))
        spark = docs.sparkSession
        counted = staged(self.rows.mapInArrow(*_count_pass(n)), "counts", TEXT_ROWS)
        self.documents = counted.filter("block is null").select("id", "k1", "k2", "name", "n")
        ranks = np.zeros(1 << CELL_BITS, np.uint8)
        blocks = counted.filter("block is not null").select("block", "counts").repartition(32, "block").sortWithinPartitions("block")
        for r in blocks.mapInArrow(_sum_blocks, "block int, ranks binary").collect():  # 16 MB in all, whatever the input
            ranks[r["block"] << BLOCK_BITS : (r["block"] + 1) << BLOCK_BITS] = np.frombuffer(r["ranks"], np.uint8)
        sent = spark.sparkContext.broadcast(ranks)
        made = self.rows.mapInArrow(*_set_pass(n, percent, sent)).dropDuplicates(["name"])
        # written once, so a set keeps its number
        self.sets = staged(made.withColumn("rep", F.monotonically_increasing_id()), "sets", TEXT_ROWS)

        entries = self.sets.select("rep", "size", F.posexplode("prefix").alias("place", "gram"))
        shared = entries.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram")
        shared = staged(shared, "shared-columns")
        self.entries = staged(BitFilter(shared, "gram", 24).keep(entries, "gram").join(shared, "gram", "left_semi"), "entries")
        candidates = self.entries.select("rep").distinct()
        self.sketches = staged(self.sets.select("rep", "size", "sketch").join(candidates, "rep", "left_semi"), "sketches")

    def repeated(self) -> DataFrame:
        """Ids whose rows have different sets (or some none)."""
        mark = F.xxhash64("name")
        ids = self.documents.filter("id is not null").groupBy("id").agg(F.min(mark).alias("lo"), F.max(mark).alias("hi"))
        return staged(ids.filter("lo <> hi").select("id"), "repeated")

    def read(self, reps: DataFrame) -> DataFrame:
        """rep and grams (the whole set, as bytes) of some sets. Of each set one
        row's text is read; texts of others are left out before any shuffle, but
        for what the filter lets through, and copies of a row are combined."""
        wanted = staged(reps.join(self.sets.select("rep", "k1", "k2", "name"), "rep"), "wanted")
        n = self.n

        @tidy
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(rep, g.tobytes()) for (rep, name), g in _sets([batch], n) if set_name(g) == name]
                reps, grams = zip(*found, strict=True) if found else ([], [])
                yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(grams, pa.binary())], ["rep", "grams"])

        slots = BitFilter(wanted, "k1", 24)
        rows = slots.keep(self.rows.select("k1", "k2", "text"), "k1").dropDuplicates(["k1", "k2"])
        rows = rows.join(wanted, ["k1", "k2"]).select("rep", "name", "text")
        return staged(rows.mapInArrow(run, "rep long, grams binary"), "row-sets", TEXT_ROWS)

    def test(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        left = self.sketches.select(F.col("rep").alias("a"), "size", F.col("sketch").alias("s"))
        right = self.sketches.select(F.col("rep").alias("b"), F.col("size").alias("size2"), F.col("sketch").alias("s2"))
        near = pairs.join(left, "a").join(right, "b").select("a", "b", "size", "size2", "s", "s2")
        near = staged(near.mapInArrow(_near(self.percent), "a long, b long, size int"), "near")
        sets = self.read(near.select(F.col("a").alias("rep")).unionByName(near.select(F.col("b").alias("rep"))).distinct())
        # a left row with many right rows is taken in parts of bounded size
        size = near.groupBy("a").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("g"))
        parts = F.greatest(F.lit(1), F.ceil(F.col("c") / PAIR_ROWS), F.ceil(F.col("g") / PAIR_GRAMS)).cast("int")
        size = staged(size.select("a", parts.alias("parts")), "pair-parts")
        own = F.pmod(F.xxhash64(F.lit(self.seed), "b"), F.col("parts")).cast("int").alias("part")
        rights = near.join(size, "a").select("a", "b", own).join(sets.withColumnRenamed("rep", "b"), "b").select("a", "b", "grams", "part")
        lefts = size.join(sets.withColumnRenamed("rep", "a"), "a").select("a", F.lit(None).cast("long").alias("b"), "grams", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        held = rights.unionByName(lefts).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
        return held.select("a", "b", "grams").mapInArrow(_multiply(self.percent), "a long, b long")

    def centred(self, labelled: DataFrame, turn: int) -> DataFrame:
        """Pairs of each column's rows with a centre, one for each band of sizes."""
        band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1.25)) + F.lit(0.5 * (turn % 2)))
        chance = F.xxhash64(F.lit(self.seed), F.lit(turn), "rep")
        # a row that holds few rare n-grams has common ones at an early place: it is near the middle of a group
        rows = labelled.withColumns({"band": band, "key": F.struct(F.col("place") if turn < 2 else F.lit(0), chance)})
        centre = rows.groupBy("gram", "band").agg(
            F.min(F.struct("key", F.col("rep").alias("rep2"), F.col("component").alias("component2"), F.col("size").alias("size2"), F.col("place").alias("place2"))).alias("m"),
            F.count(F.lit(1)).alias("c"),
        )
        # written, so that a column with very many rows can be split where it is joined
        centre = staged(centre.filter("c > 1").select("gram", "band", "m.rep2", "m.component2", "m.size2", "m.place2"), "centres")
        met = rows.join(centre, ["gram", "band"]).filter((F.col("component") != F.col("component2")) & _within(self.percent))
        return met.select(F.col("rep2").alias("a"), F.col("rep").alias("b")).distinct()

    def crossing(self, labelled: DataFrame) -> DataFrame:
        """Links between components, of all rows that share a column with another
        component. labelled: also has ``across``, the open pairs of the column."""
        narrow = labelled.filter(F.col("across") <= WIDE_PAIRS)
        kinds = staged(narrow.select("gram", "component").distinct(), "kinds")
        two = kinds.join(kinds.select("gram", F.col("component").alias("component2")), "gram").filter("component < component2")
        other = narrow.select(
            "gram", F.col("component").alias("component2"), F.col("rep").alias("rep2"), F.col("size").alias("size2"), F.col("place").alias("place2")
        )
        met = two.join(narrow, ["gram", "component"]).join(other, ["gram", "component2"]).filter(_within(self.percent))
        found = self.test(met.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct())
        wide = staged(labelled.filter(F.col("across") > WIDE_PAIRS), "wide")
        return found.unionByName(self.blocks(wide)) if wide.take(1) else found

    def blocks(self, wide: DataFrame) -> DataFrame:
        """The same for columns with many open pairs. Rows that such columns
        connect are one group, in which each pair is met in one block."""
        heads = wide.groupBy("gram").agg(F.min("rep").alias("a"))
        groups = components(wide.join(heads, "gram").select("a", F.col("rep").alias("b"))).select(F.col("v").alias("rep"), F.col("component").alias("team"))
        rows = wide.groupBy("rep").agg(F.min("component").alias("component"), F.min("size").cast("long").alias("size"))
        rows = staged(rows.join(groups, "rep"), "teams")
        kinds = rows.groupBy("team", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("g"))
        sides = kinds.groupBy("team").agg(
            F.sum("c").alias("c"), F.sum("g").alias("g"), F.max(F.struct("c", "component", "g")).alias("main")
        )
        cut = lambda c, g, most_c, most_g: F.greatest(F.lit(1), F.ceil(c / most_c), F.ceil(g / most_g)).cast("int")
        left_rows = F.col("c") - F.col("main.c")
        square = F.least(F.lit(RIGHT_ROWS), F.greatest(F.lit(min(SQUARE_ROWS, RIGHT_ROWS)), left_rows))
        sides = staged(
            sides.select(
                "team", F.col("main.component").alias("main"),
                cut(left_rows, F.col("g") - F.col("main.g"), LEFT_ROWS, LEFT_GRAMS).alias("lefts"),
                cut(F.col("c"), F.col("g"), square, RIGHT_GRAMS).alias("rights"),
            ),
            "sides",
        )
        rows = rows.join(sides, "team").withColumn("h", F.xxhash64(F.lit(self.seed), "rep"))
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rows.filter("component <> main").select("team", "rep", "component", F.lit(0).alias("side"), F.pmod("h", F.col("lefts")).cast("int").alias("i"), upto("rights").alias("j"))
        right = rows.select("team", "rep", "component", F.lit(1).alias("side"), upto("lefts").alias("i"), F.pmod("h", F.col("rights")).cast("int").alias("j"))
        sets = self.read(rows.select("rep"))
        held = left.unionByName(right).join(sets, "rep")
        return held.groupBy("team", "i", "j").applyInArrow(_block(self.percent), "a long, b long")

    def label(self, found: DataFrame | None) -> tuple[DataFrame, int, int]:
        """Entries with their component, of columns that more than one component
        has; their number, and how many pairs lie across (also for each column)."""
        rows = self.entries if found is None else self.entries.join(found.withColumnRenamed("v", "rep"), "rep", "left")
        rows = rows.withColumn("component", F.col("rep") if found is None else F.coalesce("component", "rep"))
        by_kind = rows.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("c"))
        open_columns = by_kind.groupBy("gram").agg(F.sum("c").alias("all"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count(F.lit(1)).alias("kinds"))
        across = (F.col("all").cast("double") * F.col("all") - F.col("same")) / 2
        open_columns = staged(open_columns.filter("kinds > 1").select("gram", "all", across.alias("across")), "open-columns")
        sums = open_columns.agg(F.sum("all"), F.sum("across")).first()
        labelled = staged(rows.join(open_columns.select("gram", "across"), "gram"), "labelled")
        return labelled, int(sums[0] or 0), int(sums[1] or 0)

    def same_ids(self, repeated: DataFrame) -> DataFrame:
        """Links between the sets of one id."""
        rows = self.documents.filter("name is not null").select("id", "name").join(repeated, "id").join(self.sets.select("name", "rep"), "name")
        rows = staged(rows.select("id", "rep").distinct(), "same-ids")
        return rows.join(rows.groupBy("id").agg(F.min("rep").alias("a")), "id").select("a", F.col("rep").alias("b"))

    def run(self, links: DataFrame | None = None) -> DataFrame | None:
        """v and component, of the sets that link with another. links: known ones."""
        found, before = None if links is None else components(links), None
        for turn in range(MOST_ROUNDS):
            labelled, held, across = self.label(found)
            if not held:
                break
            if across <= OPEN_PAIRS * held or (before is not None and across > 0.8 * before):
                found = components(self._more(links, self.crossing(labelled)))
                break
            links = self._more(links, self.test(self.centred(labelled, turn)))
            found, before = components(links), across
        else:
            labelled, held, _ = self.label(found)
            if held:
                found = components(self._more(links, self.crossing(labelled)))
        return found

    def _more(self, links: DataFrame | None, new: DataFrame) -> DataFrame:
        new = staged(new, "found", TEXT_ROWS)  # its rows carry whole sets
        return new if links is None else links.unionByName(new)

    def result(self) -> DataFrame:
        """Of each row id, k1, k2, n, component (a number, null without a set) and
        component_id (the smallest id in it)."""
        repeated = self.repeated()
        several = bool(repeated.take(1))
        found = self.run(self.same_ids(repeated) if several else None)
        names = self.sets.select("name", "rep")
        if found is not None:
            names = names.join(found.withColumnRenamed("v", "rep"), "rep", "left").select("name", F.coalesce("component", "rep").alias("component"))
        else:
            names = names.withColumnRenamed("rep", "component")
        low = self.documents.filter("name is not null").groupBy("name").agg(F.min("id").alias("low"))
        names = staged(names.join(low, "name"), "names")
        lowest = names.groupBy("component").agg(F.min("low").alias("component_id"))
        names = names.select("name", "component").join(lowest, "component")
        rows = self.documents.join(names, "name", "left").select("id", "k1", "k2", "n", "component", "component_id")
        if several:  # rows without a set go with their id's others
            rows = staged(rows, "rows")
            own = rows.join(repeated, "id").groupBy("id").agg(F.min("component").alias("c"), F.min("component_id").alias("i"))
            rows = rows.join(own, "id", "left").select("id", "k1", "k2", "n", F.coalesce("component", "c").alias("component"), F.coalesce("component_id", "i").alias("component_id"))
        return rows.withColumn("component_id", F.coalesce("component_id", "id"))


def row_keys(id_col: str, text_col: str) -> list:
    """The id, and two hashes that name a row by its id and text."""
    ident, text = named(id_col).cast("long"), F.coalesce(named(text_col).cast("string"), F.lit(""))
    return [ident.alias("id"), F.xxhash64(ident, text).alias("k1"), F.crc32(text.cast("binary")).alias("k2")]


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id (the
    smallest id that links reach, itself included)."""
    rows = Join(docs, id_col, text_col, n, percent).result()
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: a row of the smallest
    id (any row where none has an id), of several the one with the smallest hash.
    Rows without a word stay, unless their id has a row with words."""
    found = staged(Join(docs, id_col, text_col, n, percent).result(), "similar")
    grouped = found.filter("component is not null")
    lowest = grouped.filter("component_id <=> id").groupBy("component").agg(F.min("k1").alias("best"))
    verdicts = grouped.join(lowest, "component").withColumn("stays", F.col("component_id").eqNullSafe(F.col("id")) & (F.col("k1") == F.col("best")))
    verdicts = staged(verdicts.select("k1", "k2", "stays"), "verdicts")
    keys = ["k1", "k2"]
    gone = staged(verdicts.filter("not stays").select(*keys).distinct(), "gone")
    again = staged(verdicts.filter("stays").groupBy(*keys).count().filter("count > 1").select(*keys), "again")
    rows = docs.select(*row_keys(id_col, text_col)[1:], packed(docs))
    return rows_once(rows_without(rows, gone, keys), again, keys).select("row.*")
