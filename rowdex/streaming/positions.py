"""Positions as a stream: rows of a split from any position on, in order, with
the position as the offset, so a query resumes where its checkpoint stands."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSourceStreamReader, InputPartition

from rowdex.sources.index import SplitIndex
from rowdex.sources.rowgroup import Part, Reader, RowGroupSource


class PositionStream(DataSourceStreamReader):
    """Each micro-batch takes up to ``rows`` more positions; a partition of it is
    a row group, read on an executor."""

    def __init__(self, index: dict, columns: list[str], start: int, rows: int):
        self.index, self.columns, self.start, self.rows = index, columns, start, rows
        self.total = SplitIndex.from_dict(index).num_rows
        self.known = start

    def initialOffset(self) -> dict:
        return {"pos": self.start}

    def latestOffset(self) -> dict:
        self.known = min(self.total, self.known + self.rows)
        return {"pos": self.known}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.known = max(self.known, end["pos"])
        return Reader(self.index, self.columns, start["pos"], end["pos"]).partitions()

    def read(self, part: Part) -> Iterator[tuple]:
        yield from Reader(self.index, self.columns, 0, 0).read(part)

    def commit(self, end: dict) -> None:
        pass


class PositionSource(RowGroupSource):
    """Options as for ``rowgroup``, and ``rows`` (for each micro-batch)."""

    @classmethod
    def name(cls) -> str:
        return "positions"

    def streamReader(self, schema) -> DataSourceStreamReader:
        index = self._index()
        return PositionStream(index.to_dict(), self._columns(index), int(self.options.get("start", 0)), int(self.options.get("rows", 10_000)))


def read_stream(spark: SparkSession, files: list[str], columns: list[str] | None = None, start: int = 0, rows: int = 10_000) -> DataFrame:
    spark.dataSource.register(PositionSource)
    reader = spark.readStream.format("positions").option("files", json.dumps(files)).option("start", start).option("rows", rows)
    return (reader.option("columns", json.dumps(columns)) if columns else reader).load()


def drain(stream: DataFrame, path: str, checkpoint: str, stop_at: int) -> None:
    """Runs a position stream until position ``stop_at`` is written to Parquet
    below ``path``. A micro-batch writes its own folder, again on a retry."""
    done = {"pos": -1}

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        found = batch.agg({"pos": "max"}).first()[0]
        done["pos"] = max(done["pos"], -1 if found is None else found)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
    try:
        while query.isActive and done["pos"] < stop_at - 1:
            query.awaitTermination(1)
        if query.exception() is not None:
            raise query.exception()
    finally:
        query.stop()
