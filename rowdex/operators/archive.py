"""Archives: row groups saved one by one, so that an interrupted copy goes on
where it stopped. What is on disk says what is saved; the manifest repeats it."""

from __future__ import annotations

import json
import os
import threading
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdex.errors import RowdexError
from rowdex.sources.files import read_group
from rowdex.sources.index import SplitIndex


def group_name(file_index: int, rg_index: int) -> str:
    return f"rg_{file_index:05d}_{rg_index:05d}.feather"


def write_group(folder: str, file_index: int, rg_index: int, table: pa.Table) -> None:
    """A file takes its name once it is whole; writing it again changes nothing."""
    target = os.path.join(folder, group_name(file_index, rg_index))
    part = f"{target}.tmp.{os.getpid()}.{threading.get_ident()}"
    feather.write_feather(table, part, compression="zstd")
    os.replace(part, target)


class Archive:
    def __init__(
        self, target: str, index: SplitIndex | None, split: str, source: object = None, columns: Sequence[str] | None = None, token: str | None = None, workers: int = 4
    ):
        self.token, self.workers, self.error = token, workers, None
        self.target, self.index, self.split, self.source = target, index, split, source
        self.folder = os.path.join(target, "row_groups", split)
        os.makedirs(self.folder, exist_ok=True)
        self.columns = list(columns) if columns is not None else None
        self._stop, self._thread, self._lock = threading.Event(), None, threading.Lock()
        self._count = self._due = 0  # groups saved here, and at how many the manifest is written again
        for name in os.listdir(self.folder):
            if ".tmp" in name:
                os.remove(os.path.join(self.folder, name))
        self._write_manifest()

    @property
    def manifest_path(self) -> str:
        return os.path.join(self.target, f"{self.split}_manifest.json")

    @property
    def total(self) -> int:
        return len(self.index.groups) if self.index is not None else 0

    def saved(self) -> list[tuple[int, int]]:
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".feather"))
        return [(int(n[3:8]), int(n[9:14])) for n in names]

    def is_saved(self, file_index: int, rg_index: int) -> bool:
        return os.path.exists(os.path.join(self.folder, group_name(file_index, rg_index)))

    def get(self, file_index: int, rg_index: int, columns: Sequence[str] | None = None) -> pa.Table | None:
        """None if it isn't saved, can't be read, or lacks a column."""
        try:
            table = feather.read_table(os.path.join(self.folder, group_name(file_index, rg_index)))
            return table if columns is None else table.select(list(columns))
        except (OSError, KeyError, pa.ArrowInvalid):
            return None

    def save(self, file_index: int, rg_index: int, table: pa.Table) -> bool:
        """Whether it was written; one saved with all these columns stays."""
        if self.get(file_index, rg_index, table.column_names) is not None:
            return False
        write_group(self.folder, file_index, rg_index, table)
        with self._lock:
            self._count += 1
            due = self._count >= self._due
            if due:  # each time for some percent more, so that all writes stay in proportion
                self._due = self._count + 1 + self._count // 20
        if due:
            self._write_manifest()
        return True

    def progress(self) -> float:
        """The part that is saved; raises what ended a background thread."""
        self._check()
        return len(self.saved()) / self.total if self.total > 0 else 1.0

    def is_complete(self) -> bool:
        return self.total <= 0 or len(self.saved()) >= self.total

    def _state(self) -> dict:
        saved = self.saved()
        return {"source_path": self.source, "total_row_groups": self.total, "is_complete": self.is_complete(), "saved_row_groups": saved, "saved_count": len(saved), "columns": self.columns}

    def _write_manifest(self) -> None:
        with self._lock:
            part = f"{self.manifest_path}.tmp.{os.getpid()}"
            with open(part, "w", encoding="utf-8") as f:
                json.dump({"split_name": self.split, **self._state()}, f)
            os.replace(part, self.manifest_path)

    def finalize(self) -> dict:
        state = self._state()
        info = {"split": self.split, **state, "saved_row_groups": state["saved_count"], "format": "feather_row_groups"}
        if self.index is not None:
            info |= {"total_rows": self.index.num_rows, "columns": self.columns or self.index.schema.names}
        with open(os.path.join(self.target, f"{self.split}_info.json"), "w", encoding="utf-8") as f:
            json.dump(info, f)
        self._write_manifest()
        return info

    # filling
    def missing(self, spark: SparkSession, start: int = 0) -> DataFrame:
        """Row groups still to save, in order from one on and round to it."""
        groups = self.index.to_df(spark)
        numbered = groups.join(spark.createDataFrame([(g.file_index, g.rg_index, k) for k, g in enumerate(self.index.groups)], "file_index int, rg_index int, g int"), ["file_index", "rg_index"])
        return missing_groups(numbered, spark.createDataFrame(self.saved(), "file_index int, rg_index int"), start, self.total)

    def fill(self, spark: SparkSession, start: int = 0) -> int:
        """Saves what is missing as one job, a row group at a time on each core.
        The target must be a folder that all executors share."""
        folder, columns, token = self.folder, self.columns, self.token

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    table = read_group(row["path"], row["rg_index"], columns, token)
                    write_group(folder, row["file_index"], row["rg_index"], table)
                yield pa.RecordBatch.from_arrays([batch.column("rg_index")], ["rg_index"])

        due = self.missing(spark, start)
        done = due.orderBy("turn").repartition(max(1, min(self.total, 1000)), "turn").select("path", "file_index", "rg_index").mapInArrow(run, "rg_index int").count()
        self._write_manifest()
        return done

    def start(self, start: int = 0) -> Archive:
        """Saves in the background, some row groups at a time, from one on and
        round to it. What fails is raised by ``join`` and ``progress``."""
        if self.is_alive():
            return self
        self._stop.clear()
        self.error = None

        def save(g) -> None:
            if not self._stop.is_set() and not self.is_saved(g.file_index, g.rg_index):
                self.save(g.file_index, g.rg_index, read_group(g.path, g.rg_index, self.columns, self.token))

        def run() -> None:
            groups = self.index.groups
            try:
                with ThreadPoolExecutor(self.workers) as pool:
                    for k in range(0, len(groups), 4 * self.workers):
                        turn = [groups[(start + j) % len(groups)] for j in range(k, min(len(groups), k + 4 * self.workers))]
                        list(pool.map(save, turn))
                        if self._stop.is_set():
                            break
            except BaseException as e:
                self.error = e
            finally:
                self._write_manifest()

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return self

    def _check(self) -> None:
        if self.error is not None:
            raise RowdexError(f"saving {self.split!r} to {self.target!r} failed: {self.error}") from self.error

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()

    def join(self, timeout: float | None = None) -> None:
        if self._thread is not None:
            self._thread.join(timeout)
        self._check()

    def is_alive(self) -> bool:
        return self._thread is not None and self._thread.is_alive()

    def to_parquet(self) -> str:
        """The archive as one file, row groups in order."""
        path = os.path.join(self.target, f"{self.split}.parquet")
        names = sorted(n for n in os.listdir(self.folder) if n.endswith(".feather"))
        if not names:
            raise RowdexError(f"nothing is saved in {self.folder!r}")
        first = feather.read_table(os.path.join(self.folder, names[0]))
        with pq.ParquetWriter(f"{path}.tmp", first.schema) as out:
            for name in names:
                out.write_table(feather.read_table(os.path.join(self.folder, name)))
        os.replace(f"{path}.tmp", path)
        return path


def missing_groups(groups: DataFrame, saved: DataFrame, start: int, total: int) -> DataFrame:
    """groups: file_index, rg_index, g (number). Adds turn, the order of saving."""
    return groups.join(saved, ["file_index", "rg_index"], "left_anti").withColumn("turn", (F.col("g") - F.lit(start) + F.lit(total)) % F.lit(max(1, total)))


def read_manifest(target: str, split: str) -> dict | None:
    try:
        with open(os.path.join(target, f"{split}_manifest.json"), encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None
