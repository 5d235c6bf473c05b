"""Views: a split's rows under stable positions, as lazy DataFrame plans.

A view is an index, a selection, and columns. Building one costs no job; its
length comes from footers. ``to_df`` plans the rows with their ordinal ``ord``:
an unbroken selection becomes a filter on position over just the files it
touches, a listed one a join with (ord, pos).
"""

from __future__ import annotations

import json
import os
import re
import shutil
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowdex.errors import IndexOutOfBoundsError, SplitNotFoundError
from rowdex.functions import order
from rowdex.operators.cache import TableCache
from rowdex.plans.selection import Keyed, Perm, Range, Selection, shard
from rowdex.sources import rowgroup
from rowdex.sources.files import read_group
from rowdex.sources.index import RowGroup, SplitIndex, build_index
from rowdex.sources.transport import is_remote

#: Listed positions up to this many (16 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Rows up to which a shuffle lists its order on the driver; beyond, positions are computed.
LISTED_ROWS = 5_000_000
#: Rows of a file that a save writes; a longer view becomes several files.
SAVE_ROWS = 2_000_000


def spark_uri(spark: SparkSession, path: str) -> str:
    """A path as ``_metadata.file_path`` spells it, but for the slashes of a local one."""
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = held.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(held).toUri().toString()
    return re.sub("^file:/+", "/", full)


def positioned(spark: SparkSession, index: SplitIndex, files: Sequence[int] | None = None) -> DataFrame:
    """Rows of some files (all by default) with ``pos``."""
    chosen = range(len(index.files)) if files is None else files
    if not len(chosen):
        return positioned(spark, index, [0]).limit(0)
    paths = [index.files[k] for k in chosen]
    rows = spark.read.schema(spark_schema(spark, index)).parquet(*paths)
    if len(paths) == 1:
        return rows.withColumn("pos", F.col("_metadata.row_index") + F.lit(index.file_starts[chosen[0]]))
    starts = spark.createDataFrame([(spark_uri(spark, p), index.file_starts[k]) for k, p in zip(chosen, paths, strict=True)], "__path string, __start long")
    rows = rows.select("*", F.regexp_replace("_metadata.file_path", "^file:/+", "/").alias("__path"), F.col("_metadata.row_index").alias("__row"))
    # one row for each file
    return rows.join(F.broadcast(starts), "__path").withColumn("pos", F.col("__start") + F.col("__row")).drop("__path", "__start", "__row")


def spark_schema(spark: SparkSession, index: SplitIndex):
    """Spark's schema of the files, found once for an index."""
    if index.spark_schema is None:
        index.spark_schema = spark.read.parquet(index.files[0]).schema
    return index.spark_schema


def listed(spark: SparkSession, positions: np.ndarray) -> DataFrame:
    table = pa.table({"ord": pa.array(np.arange(len(positions)), pa.int64()), "pos": pa.array(positions, pa.int64())})
    return spark.createDataFrame(table)


class View:
    """An immutable selection of rows and columns of one split."""

    def __init__(
        self, spark: SparkSession, index: SplitIndex, selection: Selection | None = None, columns: Sequence[str] | None = None,
        seed: int | None = None, buffer_size: int | None = None, dataset_id: str | None = None, cache: TableCache | None = None,
    ):
        self._spark, self.index, self.token = spark, index, None
        self.selection = Range(0, index.num_rows) if selection is None else selection
        self.columns = list(index.schema.names if columns is None else columns)
        self.seed, self.buffer_size, self.dataset_id = seed, buffer_size, dataset_id
        self.cache = cache if cache is not None else TableCache(2)
        self.archive, self.closed = None, False
        #: Row groups on disk; whole files with their URLs by local path; groups read of each file.
        self.disk_cache, self.file_cache, self.urls, self.read_groups = None, None, {}, {}

    @classmethod
    def open(cls, spark: SparkSession, files: Sequence[str], split: str = "train", **more) -> View:
        return cls(spark, build_index(files, split, spark), **more)

    @property
    def spark(self) -> SparkSession:
        """Its session, or in another process the one that is active there."""
        if self._spark is None:
            self._spark = SparkSession.builder.getOrCreate()
        return self._spark

    def __getstate__(self) -> dict:
        """Without what belongs to one process: session, archive, open caches."""
        return {**self.__dict__, "_spark": None, "archive": None}

    def _with(self, **changes) -> View:
        held = dict(selection=self.selection, columns=self.columns, seed=self.seed, buffer_size=self.buffer_size, cache=self.cache)
        out = View(self._spark, self.index, **{**held, **changes})
        out.token = self.token
        out.archive, out.disk_cache = self.archive, self.disk_cache
        out.file_cache, out.urls, out.read_groups = self.file_cache, self.urls, self.read_groups
        return out

    # what it shows, without reading rows
    def __len__(self) -> int:
        return len(self.selection)

    num_rows = property(__len__)

    @property
    def split(self) -> str:
        return self.index.split

    @property
    def column_names(self) -> list[str]:
        return list(self.columns)

    @property
    def schema(self) -> pa.Schema:
        return pa.schema([self.index.schema.field(c) for c in self.columns], self.index.schema.metadata)

    @property
    def features(self) -> dict | None:
        return self.index.features

    @property
    def n_files(self) -> int:
        return len(self.index.files)

    def file_urls(self) -> list[str]:
        return list(self.index.files)

    @property
    def is_permuted(self) -> bool:
        return not isinstance(self.selection, Range)

    @property
    def status(self) -> dict:
        saved = self.archive.progress() if self.archive else 0.0
        return {"id": self.dataset_id, "split": self.split, "rows": len(self), "columns": self.columns, "is_permuted": self.is_permuted, "closed": self.closed, "save_progress": saved}

    def __repr__(self) -> str:
        shown = ", ".join(self.columns[:5]) + (", ..." if len(self.columns) > 5 else "")
        return f"View(split={self.split!r}, rows={len(self)}, columns=[{shown}], permuted={self.is_permuted}, id={self.dataset_id!r})"

    # projection, limit, offset, shards
    def select_columns(self, columns: str | Sequence[str]) -> View:
        columns = [columns] if isinstance(columns, str) else list(columns)
        unknown = [c for c in columns if c not in self.index.schema.names]
        if unknown:
            raise ValueError(f"{unknown} not in dataset columns {self.index.schema.names}")
        return self._with(columns=columns)

    def take(self, n: int) -> View:
        return self.slice(0, n)

    def skip(self, n: int) -> View:
        return self.slice(n, len(self))

    def slice(self, start: int, length: int) -> View:
        start = min(max(0, start), len(self))
        return self._with(selection=self.selection.slice(start, min(len(self), start + max(0, length))))

    def rows(self, part: slice) -> View:
        """A Python slice of the view, as a view."""
        return self._with(selection=self.selection.slice(*part.indices(len(self))))

    def select(self, ordinals: Sequence[int]) -> View:
        n = len(self)
        for k in ordinals:
            if not -n <= k < n:
                raise IndexOutOfBoundsError(k, n)
        return self._with(selection=self.selection.pick([k + n if k < 0 else k for k in ordinals]))

    def shard(self, num_shards: int, index: int, contiguous: bool = False) -> View:
        return self._with(selection=shard(self.selection, num_shards, index, contiguous))

    def shuffle(self, seed: int | None = None, buffer_size: int | None = None) -> View:
        """All rows in a seeded order; with a buffer, an order of iteration only.
        Up to ``LISTED_ROWS`` rows the order is that of Python's generator, beyond
        it a keyed permutation, whose positions are computed and never listed."""
        if buffer_size is not None:
            if buffer_size < 1:
                raise ValueError("buffer_size must be positive")
            return self._with(seed=seed, buffer_size=buffer_size)
        if len(self) > LISTED_ROWS and isinstance(self.selection, Range):
            return self._with(selection=Keyed.of(self.selection, seed), seed=seed, buffer_size=None)
        return self._with(selection=self.selection.pick(order.permutation(len(self), seed)), seed=seed, buffer_size=None)

    # row groups
    def _groups(self) -> list[tuple[RowGroup, list[int]]]:
        if isinstance(self.selection, Range) and self.selection.step == 1:
            s = self.selection
            return [(g, list(range(g.start + a - s.offset, g.start + b - s.offset))) for g, a, b in self.index.locate_range(s.offset, s.offset + s.length)]
        ends = np.array([g.end for g in self.index.groups])
        out: dict[int, list[int]] = {}
        for k, g in enumerate(np.searchsorted(ends, self.selection.positions(), "right").tolist()):
            out.setdefault(g, []).append(k)
        return [(self.index.groups[g], rows) for g, rows in out.items()]

    def row_group_indices(self) -> list[list[int]]:
        """Ordinals by row group, in order of first appearance."""
        return [rows for _, rows in self._groups()]

    def row_group_files(self) -> list[int]:
        return [g.file_index for g, _ in self._groups()]

    # plans
    def to_df(self) -> DataFrame:
        """``ord`` and the columns, in no order; sort by ``ord``."""
        return self._plan(self.selection).select("ord", *[F.col(f"`{c}`") for c in self.columns])

    def _positioned(self, files: Sequence[int], first: int, last: int, groups: list[int] | None = None) -> DataFrame:
        """Rows of positions first to last (or of some row groups) with ``pos``.
        What Spark's readers cannot open comes through the row-group source."""
        if any(map(is_remote, self.index.files)):
            return rowgroup.read_rows(self.spark, self.index, self.columns or None, first, last + 1, groups, self.token)
        return positioned(self.spark, self.index, files)

    def _plan(self, chosen: Selection) -> DataFrame:
        index, n = self.index, len(chosen)
        if not n:
            return self._positioned([0], 0, -1).limit(0).withColumn("ord", F.col("pos"))
        if isinstance(chosen, Range):
            first, last = sorted((chosen.position(0), chosen.position(n - 1)))
            rows = self._positioned(index.files_of(first, last + 1), first, last)
            away = F.col("pos") - F.lit(chosen.offset)
            rows = rows.filter((F.col("pos") >= first) & (F.col("pos") <= last))
            if chosen.step != 1:
                rows = rows.filter(away % F.lit(abs(chosen.step)) == 0)
            return rows.withColumn("ord", (away / F.lit(chosen.step)).cast("long") if abs(chosen.step) != 1 else away * F.lit(chosen.step))
        if isinstance(chosen, Keyed):
            first, last = sorted((chosen.base.position(0), chosen.base.position(len(chosen.base) - 1)))
            ordinal = F.pandas_udf(lambda pos: pd.Series(chosen.ordinals(pos.to_numpy())), "long")
            rows = self._positioned(index.files_of(first, last + 1), first, last).withColumn("ord", ordinal("pos"))
            return rows.filter("ord >= 0")
        held = chosen.positions()
        wanted = listed(self.spark, held)
        files = sorted(set((np.searchsorted(np.array(index.file_starts), held, "right") - 1).tolist()))
        groups = sorted(set(np.searchsorted(np.array([g.end for g in index.groups]), held, "right").tolist()))
        rows = self._positioned(files, 0, index.num_rows - 1, groups)
        return rows.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "pos")

    def ordered(self) -> DataFrame:
        return self.to_df().orderBy("ord")

    def hash_shuffled(self, seed: int) -> DataFrame:
        """All rows with ``ord`` in order of a seeded hash, without a list on the driver."""
        rows = self._plan(self.selection).drop("ord").select("pos", *self.columns)
        return order.hash_shuffle(rows, seed).select("ord", *self.columns)

    # reading
    def _row_group(self, group: RowGroup) -> pa.Table:
        key = (group.path, group.rg_index, tuple(self.columns))
        return self.cache.get_or(key, lambda: self._read_group(group))

    def _read_group(self, group: RowGroup) -> pa.Table:
        if self.archive is not None and (held := self.archive.get(group.file_index, group.rg_index, self.columns)) is not None:
            return held
        url = self.urls.get(group.path)
        if self.file_cache is None or url is None:
            table = self._read_columns(group, group.path)
        else:
            self.file_cache.acquire(url)  # it stays on disk while it is read
            try:
                table = self._read_columns(group, self.file_cache.get_or_download(url))
            finally:
                self.file_cache.release(url)
        if self.archive is not None:
            self.archive.save(group.file_index, group.rg_index, table)
        self._count_read(group)
        return table

    def _read_columns(self, group: RowGroup, path: str) -> pa.Table:
        if self.disk_cache is not None and (held := self.disk_cache.get(path, group.rg_index, self.columns)) is not None:
            return held
        if "://" in path and not is_remote(path):  # only Spark reaches it
            rows = positioned(self.spark, self.index, [group.file_index]).filter((F.col("pos") >= group.start) & (F.col("pos") < group.end))
            return rows.orderBy("pos").select(*self.columns).toArrow()
        table = read_group(path, group.rg_index, self.columns, self.token)
        if self.disk_cache is not None:
            self.disk_cache.put(path, group.rg_index, self.columns, table)
        return table

    def _count_read(self, group: RowGroup) -> None:
        """A file is consumed once each of its row groups was read."""
        if self.file_cache is None:
            return
        seen = self.read_groups.setdefault(group.file_index, set())
        seen.add(group.rg_index)
        if len(seen) == sum(g.file_index == group.file_index for g in self.index.groups):
            self.mark_file_consumed(group.file_index)

    def mark_file_consumed(self, file: int | str) -> None:
        path = self.index.files[file] if isinstance(file, int) else file
        if self.file_cache is not None:
            self.file_cache.mark_consumed(self.urls.get(path, path))

    def set_file_order(self, files: Sequence[int]) -> None:
        """In which order files will be read, for a cache that fetches ahead."""
        if self.file_cache is not None:
            self.file_cache.set_file_sequence([self.urls.get(self.index.files[k], self.index.files[k]) for k in files])

    def reset_consumption(self) -> None:
        self.read_groups.clear()
        if self.file_cache is not None:
            self.file_cache.reset_consumption()

    def _gather(self, chosen: Selection) -> pa.Table:
        """Rows of a selection in order, by row group; few rows stay off the cluster."""
        ends = np.array([g.end for g in self.index.groups])
        at = chosen.positions()
        group = np.searchsorted(ends, at, "right")
        parts, places = [self.schema.empty_table()], []
        for g in dict.fromkeys(group.tolist()):
            mine = np.flatnonzero(group == g)
            parts.append(self._row_group(self.index.groups[g]).take(pa.array(at[mine] - self.index.groups[g].start)))
            places.append(mine)
        table = pa.concat_tables([p.cast(self.schema) if p.schema != self.schema else p for p in parts])
        back = np.empty(len(at), np.int64)
        if places:
            back[np.concatenate(places)] = np.arange(len(at))
        return table.take(pa.array(back))

    def __getitem__(self, key):
        n = len(self)
        if isinstance(key, int):
            if not -n <= key < n:
                raise IndexOutOfBoundsError(key, n)
            group, at = self.index.locate_row(self.selection.position(key + n if key < 0 else key))
            return self._row_group(group).slice(at, 1).to_pylist()[0]
        if isinstance(key, slice):
            return self._gather(self.selection.slice(*key.indices(n))).to_pydict()
        if isinstance(key, (list, tuple)):
            return self._gather(self.select(key).selection).to_pydict()
        raise TypeError(f"a view takes an int, a slice or a list, not {type(key).__name__}")

    def _iteration(self, start: int, seed: int | None, buffer_size: int | None) -> Selection:
        n = len(self)
        start = min(max(0, start + n if start < 0 else start), n)
        if buffer_size:
            return self.selection.pick(order.rolling_buffer(n, buffer_size, seed, start))
        return self.selection.slice(start, n)

    def iter_from(self, start_index: int = 0, buffer_size: int | None = None, seed: int | None = None) -> Iterator[dict]:
        """Rows in order from an ordinal on, one partition ahead of the reader."""
        size = self.buffer_size if buffer_size is None else buffer_size
        chosen = self._iteration(start_index, self.seed if seed is None else seed, size)
        for k in range(0, len(chosen), 4096):
            yield from self._gather(chosen.slice(k, min(len(chosen), k + 4096))).to_pylist()

    def stream(self, start_index: int | None = None, from_index: int | None = None, **more) -> Iterator[dict]:
        return self.iter_from(start_index if start_index is not None else from_index or 0, **more)

    stream_from = iter_from

    def __iter__(self) -> Iterator[dict]:
        return self.iter_from(0)

    # export
    def to_arrow(self) -> pa.Table:
        return self.ordered().drop("ord").toArrow()

    def to_pandas(self) -> pd.DataFrame:
        return self.to_arrow().to_pandas()

    def to_hf_dataset(self):
        import datasets

        return datasets.Dataset(self.to_arrow())

    def save_to_disk(self, target: str) -> str:
        """``{split}.parquet``, ``{split}.feather`` and ``{split}_info.json``. The
        one Parquet part that Spark writes in order takes its name when complete.
        A view of more than ``SAVE_ROWS`` rows becomes ``{split}/part-*.parquet``,
        one file for each range of the order, written by as many tasks."""
        os.makedirs(target, exist_ok=True)
        info = {"split": self.split, "num_rows": len(self), "columns": self.columns}
        parts = -(-len(self) // SAVE_ROWS)
        if parts > 1:
            folder = os.path.join(target, self.split)
            rows = self.to_df().repartitionByRange(parts, "ord").sortWithinPartitions("ord").drop("ord")
            rows.write.mode("overwrite").parquet(folder)
            names = sorted(f for f in os.listdir(folder) if f.startswith("part-"))
            info |= {"data_file": None, "parquet_file": None, "parquet_files": [os.path.join(self.split, f) for f in names], "format": "parquet"}
        else:
            parquet, arrow = os.path.join(target, f"{self.split}.parquet"), os.path.join(target, f"{self.split}.feather")
            staging = os.path.join(target, f".{self.split}.staging")
            self.ordered().drop("ord").coalesce(1).write.mode("overwrite").parquet(staging)
            part = next(f for f in sorted(os.listdir(staging)) if f.startswith("part-"))
            os.replace(os.path.join(staging, part), parquet)
            shutil.rmtree(staging)
            with pq.ParquetFile(parquet) as held, pa.ipc.new_file(f"{arrow}.tmp", held.schema_arrow, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held.iter_batches():
                    out.write_batch(part)
            os.replace(f"{arrow}.tmp", arrow)
            info |= {"data_file": os.path.basename(arrow), "parquet_file": os.path.basename(parquet), "format": "feather"}
        with open(os.path.join(target, f"{self.split}_info.json"), "w", encoding="utf-8") as f:
            json.dump(info, f)
        return target

    def to_dataloader(self, batch_size: int = 1, **more):
        from rowdex.operators.batches import BatchLoader

        return BatchLoader(self, batch_size, **{"seed": self.seed, **more})

    # archive
    def save_progress(self) -> float:
        return self.archive.progress() if self.archive else 0.0

    def is_fully_saved(self) -> bool:
        return bool(self.archive) and self.archive.is_complete()

    def stream_and_save(self, show_progress: Callable[[float], None] | None = None) -> None:
        """Saves every row group of the split, then closes the archive."""
        self.archive.fill(self.spark)
        self.archive.finalize()
        if show_progress:
            show_progress(self.save_progress())

    def start_background_download(self, start_index: int = 0):
        """Fills the archive in the background, from the row group of an ordinal on."""
        if self.archive is None:
            return None
        group = self.index.locate_row(self.selection.position(start_index))[0] if len(self) else self.index.groups[0]
        return self.archive.start(self.index.groups.index(group))

    def stop_background_download(self) -> None:
        if self.archive is not None:
            self.archive.stop()

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.stop_background_download()
            self.cache.clear()

    def __enter__(self) -> View:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class SplitDict(dict):
    """Views by split; operations apply to each."""

    dataset_id: str | None = None

    def _each(self, call: Callable[[View], View]) -> SplitDict:
        return SplitDict({k: call(v) for k, v in self.items()})

    def select_columns(self, columns):
        return self._each(lambda v: v.select_columns(columns))

    def shuffle(self, seed=None, buffer_size=None):
        return self._each(lambda v: v.shuffle(seed, buffer_size))

    def take(self, n):
        return self._each(lambda v: v.take(n))

    def skip(self, n):
        return self._each(lambda v: v.skip(n))

    def slice(self, start, length):
        return self._each(lambda v: v.slice(start, length))

    def shard(self, num_shards, index, contiguous=False):
        return self._each(lambda v: v.shard(num_shards, index, contiguous))

    def to_df(self) -> DataFrame:
        """All splits in one plan, with a column ``split``."""
        parts = [v.to_df().withColumn("split", F.lit(k)) for k, v in self.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def to_hf_dataset(self):
        import datasets

        return datasets.DatasetDict({k: v.to_hf_dataset() for k, v in self.items()})

    @property
    def num_rows(self) -> dict[str, int]:
        return {k: len(v) for k, v in self.items()}

    @property
    def column_names(self) -> dict[str, list[str]]:
        return {k: v.column_names for k, v in self.items()}

    def save_progress(self) -> float:
        return sum(v.save_progress() for v in self.values()) / len(self) if self else 1.0

    def is_fully_saved(self) -> bool:
        return bool(self) and all(v.is_fully_saved() for v in self.values())

    def stream_and_save(self) -> None:
        for v in self.values():
            v.stream_and_save()

    def start_background_download(self, start_index: int = 0) -> None:
        for v in self.values():
            v.start_background_download(start_index)

    def stop_background_download(self) -> None:
        for v in self.values():
            v.stop_background_download()

    def save_to_disk(self, target: str) -> str:
        os.makedirs(target, exist_ok=True)
        for k, v in self.items():
            v.save_to_disk(os.path.join(target, k))
        with open(os.path.join(target, "dataset_dict.json"), "w", encoding="utf-8") as f:
            json.dump({"splits": list(self)}, f)
        return target

    def to_dataloader(self, split: str | None = None, **more):
        if split is not None and split not in self:
            raise SplitNotFoundError(split, list(self))
        return self[split].to_dataloader(**more) if split is not None else {k: v.to_dataloader(**more) for k, v in self.items()}

    @property
    def is_closed(self) -> bool:
        return all(v.closed for v in self.values())

    @property
    def status(self) -> dict:
        return {k: v.status for k, v in self.items()}

    def close(self) -> None:
        for v in self.values():
            v.close()

    def __enter__(self) -> SplitDict:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        return "SplitDict({" + ", ".join(f"{k!r}: {v!r}" for k, v in self.items()) + "})"
