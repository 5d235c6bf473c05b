"""The index of a split: its files and row groups in order, from footers alone."""

from __future__ import annotations

import bisect
import hashlib
import json
import os
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import cached_property

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from rowdex.errors import CorruptParquetError, IndexOutOfBoundsError
from rowdex.sources.stores import data_files, in_store, store_footer
from rowdex.sources.transport import is_remote, remote_footer


@dataclass(frozen=True)
class RowGroup:
    """One row group. Rows [start, end) of the split, bytes [byte_start, byte_end) of the file."""

    file_index: int
    path: str
    rg_index: int
    num_rows: int
    start: int
    end: int
    byte_start: int
    byte_end: int

    @property
    def byte_length(self) -> int:
        return max(0, self.byte_end - self.byte_start)


def byte_span(group: pq.RowGroupMetaData) -> tuple[int, int]:
    """First byte of any page and last byte of any chunk."""
    starts, ends = [], []
    for k in range(group.num_columns):
        c = group.column(k)
        first = c.dictionary_page_offset if c.dictionary_page_offset else c.data_page_offset
        first = min(first, c.data_page_offset)
        starts.append(first)
        ends.append(first + c.total_compressed_size)
    return (min(starts), max(ends)) if starts else (0, 0)


def read_footer(path: str, token: str | None = None, spark: SparkSession | None = None) -> dict:
    """What the index keeps of a file's footer."""
    try:
        if is_remote(path):
            size, meta = remote_footer(path, token)
        elif in_store(path) and spark is not None:
            size, meta = store_footer(spark, path)
        else:
            size, meta = os.path.getsize(path), pq.read_metadata(path)
    except (pa.ArrowInvalid, FileNotFoundError) as e:
        raise CorruptParquetError(path, str(e)) from e
    groups = [(meta.row_group(k).num_rows, *byte_span(meta.row_group(k))) for k in range(meta.num_row_groups)]
    return {"size": size, "groups": groups, "schema": meta.schema.to_arrow_schema().serialize().to_pybytes().hex()}


class SplitIndex:
    """Files of a split in order, their row groups, and the schema of the first file."""

    def __init__(self, files: Sequence[str], footers: Sequence[dict], split: str = "train"):
        self.split, self.files, self.sizes = split, list(files), [f["size"] for f in footers]
        self.groups: list[RowGroup] = []
        self.file_starts: list[int] = []
        row = 0
        for k, (path, footer) in enumerate(zip(files, footers, strict=True)):
            self.file_starts.append(row)
            for j, (rows, first, last) in enumerate(footer["groups"]):
                self.groups.append(RowGroup(k, path, j, rows, row, row + rows, first, last))
                row += rows
        self.num_rows = row
        self.schema = pa.ipc.read_schema(pa.py_buffer(bytes.fromhex(footers[0]["schema"])))
        self._ends = [g.end for g in self.groups]
        #: Spark's schema of the files, once it is known.
        self.spark_schema = None

    def __len__(self) -> int:
        return self.num_rows

    @cached_property
    def features(self) -> dict | None:
        """Description that some writers keep with the schema; None if unreadable."""
        found = (self.schema.metadata or {}).get(b"huggingface")
        try:
            return json.loads(found)["info"]["features"] if found else None
        except (ValueError, KeyError, TypeError):
            return None

    def locate_row(self, row: int) -> tuple[RowGroup, int]:
        """Row group and place in it; negative rows count from the end."""
        at = row + self.num_rows if row < 0 else row
        if not 0 <= at < self.num_rows:
            raise IndexOutOfBoundsError(row, self.num_rows)
        group = self.groups[bisect.bisect_right(self._ends, at)]
        return group, at - group.start

    def locate_range(self, start: int, stop: int) -> list[tuple[RowGroup, int, int]]:
        """Row groups of rows [start, stop), each with the places wanted in it."""
        start, stop = max(0, start), min(stop, self.num_rows)
        out = []
        k = bisect.bisect_right(self._ends, start) if start < stop else len(self.groups)
        while k < len(self.groups) and self.groups[k].start < stop:
            g = self.groups[k]
            if g.num_rows:
                out.append((g, max(start, g.start) - g.start, min(stop, g.end) - g.start))
            k += 1
        return out

    def files_of(self, start: int, stop: int) -> list[int]:
        return sorted({g.file_index for g, _, _ in self.locate_range(start, stop)})

    def to_df(self, spark: SparkSession) -> DataFrame:
        schema = "file_index int, path string, rg_index int, num_rows long, start long, `end` long, byte_start long, byte_end long"
        return spark.createDataFrame([tuple(asdict(g).values()) for g in self.groups], schema)

    def to_dict(self) -> dict:
        footers = [{"size": s, "groups": [], "schema": ""} for s in self.sizes]
        for g in self.groups:
            footers[g.file_index]["groups"].append([g.num_rows, g.byte_start, g.byte_end])
        footers[0]["schema"] = self.schema.serialize().to_pybytes().hex()
        return {"split": self.split, "files": self.files, "footers": footers}

    @classmethod
    def from_dict(cls, held: dict) -> SplitIndex:
        return cls(held["files"], held["footers"], held["split"])

    def save(self, path: str) -> None:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        fd, part = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f)
        os.replace(part, path)

    @classmethod
    def load(cls, path: str) -> SplitIndex | None:
        """None if there is none, it is damaged, or a local file has another size now."""
        try:
            with open(path, encoding="utf-8") as f:
                found = cls.from_dict(json.load(f))
            same = all(is_remote(p) or os.path.getsize(p) == s for p, s in zip(found.files, found.sizes, strict=True))
            return found if same else None
        except (OSError, ValueError, KeyError, TypeError, IndexError, pa.ArrowInvalid):
            return None


def cache_path(cache_dir: str, split: str, files: Sequence[str]) -> str:
    """The name holds paths, times and sizes, so a changed file has another one."""
    marks = [(p, None, None) if is_remote(p) else (p, (s := os.stat(p)).st_mtime_ns, s.st_size) for p in files]
    return os.path.join(cache_dir, "indices", f"{split}_{hashlib.sha256(json.dumps([split, marks]).encode()).hexdigest()[:24]}.json")


def build_index(
    files: Sequence[str], split: str = "train", spark: SparkSession | None = None, cache_dir: str | None = None, token: str | None = None,
    on_executors: int = 64,
) -> SplitIndex:
    """Reads footers: on the driver for a few files and for stores that only Spark
    reaches, else as one Spark job with a row for each file. A folder stands for
    the files below it, by name."""
    files = [file for path in files for file in data_files(path, spark)]
    if not files:
        raise ValueError("an index needs at least one file")
    stored = any(map(in_store, files))
    place = cache_path(cache_dir, split, files) if cache_dir and not stored else None
    if place and (found := SplitIndex.load(place)):
        return found
    if spark is None or stored or len(files) < on_executors:
        footers = [read_footer(p, token, spark) for p in files]
    else:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = [json.dumps(read_footer(p, token)) for p in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.string())], ["k", "footer"])

        listed = spark.createDataFrame(list(enumerate(files)), "k long, path string").repartition(min(len(files), 1000))
        footers = [json.loads(r["footer"]) for r in sorted(listed.mapInArrow(run, "k long, footer string").collect())]
    index = SplitIndex(files, footers, split)
    if place:
        index.save(place)
    return index
