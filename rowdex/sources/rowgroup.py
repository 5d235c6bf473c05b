"""The ``rowgroup`` data source: one partition for each row group that holds
wanted positions. Spark's own Parquet scan prunes files but not row groups by
position; this one does, for sparse selections.

It also reads files that Spark's readers cannot open, by HTTP ranges of the row
groups and columns that are wanted.

Options: ``files`` (JSON list) or ``index`` (JSON of an index, so that footers
are not read again), ``columns`` (JSON list, optional), ``start`` and ``stop``
(positions, optional), ``groups`` (JSON list of row group numbers, optional),
``token``. With ``pushdown=true`` filters on ``pos`` prune
partitions too; ``spark.sql.python.filterPushdown.enabled`` must be set then.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.pandas.types import from_arrow_schema

from rowdex.sources.files import read_group
from rowdex.sources.index import SplitIndex, build_index

READABLE = {pa.float16(): pa.float32()}


def readable(kind: pa.DataType) -> pa.DataType:
    """A type that Spark takes: times as microseconds, nanoseconds cut."""
    if pa.types.is_timestamp(kind) and kind.unit == "ns":
        return pa.timestamp("us", kind.tz)
    if pa.types.is_time(kind) or pa.types.is_uint64(kind):
        return pa.int64() if pa.types.is_time(kind) else pa.decimal128(20, 0)
    if pa.types.is_dictionary(kind):
        return readable(kind.value_type)
    if pa.types.is_decimal256(kind):
        raise TypeError(f"{kind} has more digits than Spark's decimals")
    return READABLE.get(kind, kind)


def cast_readable(column: pa.ChunkedArray) -> pa.ChunkedArray:
    kind = readable(column.type)
    if kind == column.type:
        return column
    if pa.types.is_time(column.type):
        column = column.cast(pa.time64("us"))
    return column.cast(kind, safe=False)


class Part(InputPartition):
    def __init__(self, path: str, group: int, first: int, start: int, stop: int, token: str | None = None):
        self.path, self.group, self.first, self.start, self.stop, self.token = path, group, first, start, stop, token


class Reader(DataSourceReader):
    def __init__(self, index: dict, columns: list[str], start: int, stop: int, groups: list[int] | None = None, token: str | None = None):
        self.index, self.columns, self.start, self.stop, self.groups, self.token = index, columns, start, stop, groups, token

    def partitions(self) -> list[InputPartition]:
        index = SplitIndex.from_dict(self.index)
        wanted = None if self.groups is None else {(index.groups[k].file_index, index.groups[k].rg_index) for k in self.groups}
        found = [f for f in index.locate_range(self.start, self.stop) if wanted is None or (f[0].file_index, f[0].rg_index) in wanted]
        return [Part(g.path, g.rg_index, g.start, a, b, self.token) for g, a, b in found] or [Part("", 0, 0, 0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.start >= part.stop:
            return
        table = read_group(part.path, part.group, self.columns, part.token)
        table = table.slice(part.start, part.stop - part.start)
        held = [cast_readable(c) for c in table.columns]
        pos = pa.array(range(part.first + part.start, part.first + part.stop), pa.int64())
        yield from pa.table([pos, *held], ["pos", *self.columns]).to_batches()


class PushingReader(Reader):
    """Spark takes a reader with ``pushFilters`` only where pushing is enabled."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("pos",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.start = max(self.start, f.value)
                if isinstance(f, GreaterThan):
                    self.start = max(self.start, f.value + 1)
                if isinstance(f, (EqualTo, LessThanOrEqual)):
                    self.stop = min(self.stop, f.value + 1)
                if isinstance(f, LessThan):
                    self.stop = min(self.stop, f.value)
            yield f  # Spark checks rows again


class RowGroupSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rowgroup"

    def _index(self) -> SplitIndex:
        if "index" in self.options:
            return SplitIndex.from_dict(json.loads(self.options["index"]))
        return build_index(json.loads(self.options["files"]), token=self.options.get("token"))

    def _columns(self, index: SplitIndex) -> list[str]:
        return json.loads(self.options["columns"]) if "columns" in self.options else index.schema.names

    def schema(self):
        index = self._index()
        fields = [pa.field("pos", pa.int64())] + [pa.field(c, readable(index.schema.field(c).type)) for c in self._columns(index)]
        return from_arrow_schema(pa.schema(fields))

    def reader(self, schema) -> DataSourceReader:
        index = self._index()
        start, stop = int(self.options.get("start", 0)), int(self.options.get("stop", index.num_rows))
        kind = PushingReader if self.options.get("pushdown") == "true" else Reader
        groups = json.loads(self.options["groups"]) if "groups" in self.options else None
        return kind(index.to_dict(), self._columns(index), start, stop, groups, self.options.get("token"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RowGroupSource)


def read_rows(
    spark: SparkSession, index: SplitIndex, columns: list[str] | None = None, start: int = 0, stop: int | None = None, groups: list[int] | None = None,
    token: str | None = None,
) -> DataFrame:
    """``pos`` and columns of some positions, or of some row groups, of an index."""
    register(spark)
    reader = spark.read.format("rowgroup").option("index", json.dumps(index.to_dict())).option("start", start)
    given = {"columns": columns and json.dumps(columns), "stop": stop, "groups": None if groups is None else json.dumps(groups), "token": token}
    for name, value in given.items():
        if value is not None:
            reader = reader.option(name, value)
    return reader.load()
