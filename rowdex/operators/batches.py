"""Batches: samplers, a loader in strict order, and what slows it down."""

from __future__ import annotations

import multiprocessing
import os
import queue
import statistics
import threading
import time
import traceback
import warnings
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ProcessPoolExecutor, ThreadPoolExecutor
from concurrent.futures import TimeoutError as LateError
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rowdex.functions import order
from rowdex.functions.collate import COLLATE, pin
from rowdex.operators.cache import numbered
from rowdex.plans.selection import check_shard
from rowdex.plans.view import View, listed


def view_of(dataset: object) -> View | None:
    """The view behind wrappers that keep it in a well-known attribute."""
    seen = 0
    while dataset is not None and seen < 8:
        if isinstance(dataset, View):
            return dataset
        dataset = next((getattr(dataset, a) for a in ("data", "view", "parquet_dataset", "dataset") if getattr(dataset, a, None) is not None), None)
        seen += 1
    return None


class Sampler:
    """Ordinals of a dataset in some order."""

    epoch = 0

    def __init__(self, dataset):
        self.dataset = dataset

    def set_epoch(self, epoch: int) -> None:
        self.epoch = epoch

    def order(self) -> np.ndarray:
        return np.arange(len(self.dataset))

    def __iter__(self) -> Iterator[int]:
        return iter(self.order().tolist())

    def __len__(self) -> int:
        return len(self.dataset)


class SequentialSampler(Sampler):
    pass


class RandomSampler(Sampler):
    def __init__(self, dataset, seed: int | None = None, replacement: bool = False, num_samples: int | None = None):
        super().__init__(dataset)
        self.seed, self.replacement, self.num_samples = seed, replacement, num_samples

    def order(self) -> np.ndarray:
        seed = None if self.seed is None else self.seed + self.epoch
        return order.random_draws(len(self.dataset), seed, self.num_samples, self.replacement)

    def __len__(self) -> int:
        return len(self.dataset) if self.num_samples is None else self.num_samples


class BlockShuffledSampler(Sampler):
    """Shuffles files, row groups and rows, so that neighbours share a row group."""

    def __init__(self, dataset, window_blocks: int = 1, seed: int | None = 42, shuffle: bool = True):
        super().__init__(dataset)
        view = view_of(dataset)
        if view is None:
            raise ValueError("no view with row groups in this dataset")
        self.window, self.shuffle = window_blocks, shuffle
        self.seed = int.from_bytes(os.urandom(4), "little") if seed is None else seed
        n = len(dataset)
        held = [([r for r in rows if r < n], f) for rows, f in zip(view.row_group_indices(), view.row_group_files(), strict=True)]
        self.groups = [(rows, f) for rows, f in held if rows]

    def order(self) -> np.ndarray:
        if not self.shuffle:
            return np.array([r for rows, _ in self.groups for r in rows], np.int64)
        return order.block_order([g for g, _ in self.groups], [f for _, f in self.groups], self.seed + self.epoch, self.window)

    def file_order(self) -> list[int]:
        return order.file_order([f for _, f in self.groups], self.seed + self.epoch)

    def __len__(self) -> int:
        return sum(len(g) for g, _ in self.groups)


class DistributedSampler(Sampler):
    """One rank's part of a common order."""

    def __init__(self, dataset, num_replicas: int, rank: int, shuffle: bool = True, seed: int = 0, drop_last: bool = False, contiguous: bool = False, pad: bool = True):
        super().__init__(dataset)
        check_shard(num_replicas, rank)
        self.replicas, self.rank, self.shuffle, self.seed, self.drop_last, self.whole, self.pad = num_replicas, rank, shuffle, seed, drop_last, contiguous, pad

    def order(self) -> np.ndarray:
        if isinstance(self.dataset, Sampler):
            self.dataset.set_epoch(self.epoch)
            base = self.dataset.order()
        elif not self.shuffle:
            base = np.arange(len(self.dataset))
        elif view_of(self.dataset) is not None:
            block = BlockShuffledSampler(self.dataset, seed=self.seed)
            block.set_epoch(self.epoch)
            base = block.order()
        else:
            base = order.permutation(len(self.dataset), self.seed + self.epoch)
        return order.distributed(base, self.replicas, self.rank, self.drop_last, self.whole, self.pad)

    def __len__(self) -> int:
        n = len(self.dataset)
        if not self.pad and not self.drop_last:
            return len(range(self.rank, n, self.replicas))
        return n // self.replicas if self.drop_last else -(-n // self.replicas)


class BatchSampler:
    def __init__(self, sampler: Iterable[int], batch_size: int, drop_last: bool = False):
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        self.sampler, self.batch_size, self.drop_last = sampler, batch_size, drop_last

    def set_epoch(self, epoch: int) -> None:
        if hasattr(self.sampler, "set_epoch"):
            self.sampler.set_epoch(epoch)

    def __iter__(self) -> Iterator[list[int]]:
        return order.batches(list(self.sampler), self.batch_size, self.drop_last)

    def __len__(self) -> int:
        n = len(self.sampler)
        return n // self.batch_size if self.drop_last else -(-n // self.batch_size)


def batch_plan(view: View, sampler: Iterable[int] | None, batch_size: int, drop_last: bool = False) -> DataFrame:
    """All batches as one plan: batch_id, ord and the columns. A join for the
    whole epoch, dealt by ranges of batch_id, so a batch is in one partition."""
    if sampler is None:
        rows = view.to_df()
        count = len(view)
    else:
        drawn = np.fromiter(iter(sampler), np.int64)
        count = len(drawn)
        rows = view._with(selection=view.selection.pick(drawn)).to_df()
    rows = rows.withColumn("batch_id", F.floor(F.col("ord") / F.lit(batch_size)).cast("long"))
    if drop_last:
        rows = rows.filter(F.col("batch_id") < count // batch_size)
    return rows.select("batch_id", "ord", *[F.col(f"`{c}`") for c in view.columns])


def collected(batches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each batch, with its rows in order (nulls kept)."""
    held = F.sort_array(F.collect_list(F.struct("ord", *[F.col(f"`{c}`") for c in columns])))
    return batches.groupBy("batch_id").agg(held.alias("rows"))


#: A step is slow that takes more than FACTOR times the mean of the BACK before it, and LEAST seconds.
BACK, FACTOR, LEAST = 4, 5.0, 0.2


def is_slow(spent: float, recent: float) -> bool:
    return spent > LEAST and spent > FACTOR * recent


def latency_report(profile: DataFrame, step: str, order_by: str, back: int = BACK, factor: float = FACTOR, least: float = LEAST, block: int = 4096) -> DataFrame:
    """Steps slower than ``factor`` times the mean of the ``back`` before them. Steps
    are numbered and dealt to blocks; the last ones of a block also go to the next."""
    rows = numbered(profile, "__k", order_by).withColumn("__k", F.col("__k") - 1)
    own = F.floor(F.col("__k") / block)
    ends = F.when(F.col("__k") % block >= block - back, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows = rows.select("*", F.explode(ends).alias("__copy")).withColumn("__block", own + F.col("__copy").cast("int"))
    before = Window.partitionBy("__block").orderBy("__k").rowsBetween(-back, -1)
    held = rows.withColumns({"recent": F.avg(step).over(before), "__held": F.count(F.lit(1)).over(before)}).filter(~F.col("__copy"))
    held = held.withColumn("spike", (F.col("__held") == back) & (F.col(step) > factor * F.col("recent")) & (F.col(step) > least))
    return held.drop("__held", "__k", "__copy", "__block")


@dataclass
class BatchRecord:
    index: int
    rows: int
    wait_s: float
    fetch_s: float
    collate_s: float
    step_s: float = 0.0


@dataclass
class BenchmarkResult:
    batches: int
    samples: int
    total_s: float
    batches_per_s: float
    samples_per_s: float
    mean_ms: float
    min_ms: float
    max_ms: float
    stdev_ms: float
    error: str | None = None
    records: list[BatchRecord] = field(default_factory=list)

    def to_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "records"}


def safe_len(loader) -> int | None:
    try:
        return len(loader)
    except TypeError:
        return None


def fetch(view, ordinals: list[int]):
    """Rows of a batch, as a view gives them, or as a list."""
    if isinstance(view, View):
        if len(ordinals) == 1:
            return [view[ordinals[0]]]
        first = ordinals[0]
        if ordinals == list(range(first, first + len(ordinals))):
            return view[first : first + len(ordinals)]
        return view[ordinals]
    return [view[k] for k in ordinals]


def made(dataset, collate: Callable, ordinals: list[int]) -> tuple:
    """A batch, its rows, and the seconds to fetch and to collate them."""
    began = time.perf_counter()
    raw = fetch(dataset, ordinals)
    fetched = time.perf_counter()
    value = collate(raw)
    return value, len(ordinals), fetched - began, time.perf_counter() - fetched


#: What a worker process makes batches of.
_WORK: dict[str, object] = {}


def _begin_worker(packed: bytes) -> None:
    """In a new process: the dataset, without a session, and the collation."""
    _WORK["dataset"], _WORK["collate"] = cloudpickle.loads(packed)


def _work(ordinals: list[int]) -> tuple:
    return made(_WORK["dataset"], _WORK["collate"], ordinals)


class GroupsAhead:
    """Reads the row groups of the batches to come, at most half of what the
    view's cache holds, while the consumer works on earlier ones."""

    def __init__(self, view: View, batches: list[list[int]]):
        self.view, self.batches, self.next = view, batches, 0
        self.most = max(1, min(4, view.cache.max_entries // 2))
        self.ends = np.array([g.end for g in view.index.groups])
        self.due: deque[tuple[int, int]] = deque()  # row group, first batch that needs it
        self.asked: list[int] = []
        self.pool = ThreadPoolExecutor(min(2, self.most))

    def advance(self, batch: int) -> None:
        """The consumer is at ``batch``."""
        while self.due and self.due[0][1] < batch:
            self.due.popleft()
        self.next = max(self.next, batch)
        while self.next < len(self.batches) and len(self.due) < self.most:
            if part := self.batches[self.next]:
                group = int(np.searchsorted(self.ends, self.view.selection.position(part[0]), "right"))
                if all(group != g for g, _ in self.due):
                    self.due.append((group, self.next))
                    self.asked.append(group)
                    self.pool.submit(self._read, group)
            self.next += 1

    def _read(self, group: int) -> None:
        try:
            self.view._row_group(self.view.index.groups[group])
        except Exception:  # the batch that needs it meets the error and raises it
            pass

    def close(self) -> None:
        self.pool.shutdown(wait=False, cancel_futures=True)


class BatchLoader:
    """Batches of a dataset, in the order of its sampler whatever runs in parallel.

    dataset: a view, any sequence, or an iterable without a length (its batches
    are then dealt to shards by batch). num_workers: threads, or with
    worker_type "process" processes, that fetch ahead; a process gets the dataset
    pickled, and reads its row groups by itself.
    """

    def __init__(
        self, dataset, batch_size: int = 1, shuffle: bool = False, sampler=None, batch_sampler=None, num_workers: int | None = 0,
        collate_fn: Callable | str | None = None, drop_last: bool = False, timeout: float = 300.0, prefetch_factor: int = 2, pin_memory: bool = False,
        debug: bool = False, seed: int | None = None, num_shards: int | None = None, shard_id: int | None = None, world_size: int | None = None,
        rank: int | None = None, contiguous_shards: bool = False, worker_type: str = "thread",
    ):
        if worker_type not in ("thread", "process"):
            raise ValueError("worker_type is 'thread' or 'process'")
        self.worker_type, self.ahead_groups = worker_type, None
        if num_workers is not None and num_workers < -1:
            raise ValueError("num_workers must be >= -1")
        if batch_sampler is not None and (sampler is not None or shuffle):
            raise ValueError("batch_sampler excludes sampler and shuffle")
        if isinstance(dataset, dict):
            raise TypeError("a loader takes one split; choose one of the dict")
        self.dataset, self.timeout, self.drop_last, self.batch_size = dataset, timeout, drop_last, batch_size
        self.workers = (os.cpu_count() or 1) if num_workers in (None, -1) else num_workers
        self.ahead, self.pin, self.debug, self.closed = max(1, prefetch_factor), pin_memory, debug, False
        self.collate = COLLATE[collate_fn] if collate_fn is None or isinstance(collate_fn, str) else collate_fn
        shards = num_shards if num_shards is not None else world_size
        own = shard_id if shard_id is not None else rank
        self.shards, self.shard_id = shards or 1, own or 0
        check_shard(self.shards, self.shard_id)
        self.indexed = hasattr(dataset, "__getitem__") and hasattr(dataset, "__len__")
        self.records: list[BatchRecord] = []
        self.batch_sampler = None
        if not self.indexed:
            if shuffle:
                warnings.warn("shuffle has no effect on a dataset without a length", stacklevel=2)
            if batch_size <= 0:
                raise ValueError("batch_size must be positive")
            return
        if batch_sampler is not None:
            self.batch_sampler = batch_sampler
            return
        if self.shards > 1:
            base = dataset if sampler is None else sampler
            sampler = DistributedSampler(base, self.shards, self.shard_id, shuffle=shuffle and base is dataset, seed=seed or 0, drop_last=drop_last, contiguous=contiguous_shards)
        elif sampler is None:
            if not shuffle:
                sampler = SequentialSampler(dataset)
            elif view_of(dataset) is not None:
                sampler = BlockShuffledSampler(dataset, seed=42 if seed is None else seed)
            else:
                sampler = RandomSampler(dataset, seed)
        self.batch_sampler = BatchSampler(sampler, batch_size, drop_last)

    def __len__(self) -> int:
        if self.batch_sampler is None:
            raise TypeError("an iterable dataset has no static len")
        return len(self.batch_sampler)

    def set_epoch(self, epoch: int) -> None:
        """A new epoch: its order, nothing consumed, and files fetched ahead in its order."""
        if hasattr(self.batch_sampler, "set_epoch"):
            self.batch_sampler.set_epoch(epoch)
        if (view := view_of(self.dataset)) is not None:
            view.reset_consumption()
        self._announce_files()

    def _announce_files(self) -> None:
        view, sampler = view_of(self.dataset), getattr(self.batch_sampler, "sampler", None)
        if view is not None and view.file_cache is not None:
            order = sampler.file_order() if hasattr(sampler, "file_order") else []
            view.set_file_order(order or range(view.n_files))

    def plan(self) -> DataFrame:
        """The epoch as one DataFrame: batch_id, ord, columns."""
        view, batches = view_of(self.dataset), self.batch_sampler
        if type(batches) is BatchSampler:  # batches of one size: their numbers follow from ord
            sampler = None if type(batches.sampler) is SequentialSampler else batches.sampler
            return batch_plan(view, sampler, batches.batch_size, batches.drop_last)
        drawn = [np.asarray(part, np.int64) for part in batches]
        number = np.repeat(np.arange(len(drawn)), [len(part) for part in drawn])
        ids = listed(view.spark, number).withColumnRenamed("pos", "batch_id")
        chosen = view.selection.pick(np.concatenate([np.zeros(0, np.int64), *drawn]))
        return view._with(selection=chosen).to_df().join(ids, "ord").select("batch_id", "ord", *view.columns)

    def _fetch(self, ordinals: list[int]):
        return fetch(self.dataset, ordinals)

    def _make(self, ordinals: list[int]):
        value, *rest = made(self.dataset, self.collate, ordinals)
        return (pin(value) if self.pin else value), *rest

    def _workers(self):
        if self.worker_type == "thread":
            return ThreadPoolExecutor(self.workers), self._make
        packed = cloudpickle.dumps((self.dataset, self.collate))
        context = multiprocessing.get_context("spawn")  # a fork would share the session's sockets
        return ProcessPoolExecutor(self.workers, context, _begin_worker, (packed,)), _work

    def __iter__(self):
        if self.closed:
            raise RuntimeError("Cannot iterate over a closed loader")
        self.records, self._warned = [], set()
        self._announce_files()
        source = self._streamed() if self.batch_sampler is None else self._ordered()
        for k, (value, rows, wait, fetch, collate) in enumerate(source):
            record = BatchRecord(k, rows, wait, fetch, collate)
            self._check(value, record)
            self.records.append(record)
            began = time.perf_counter()
            yield value
            record.step_s = time.perf_counter() - began

    def _ordered(self):
        if self.workers == 0:
            for part in self.batch_sampler:
                value, rows, fetched, collate = self._make(part)
                yield value, rows, 0.0, fetched, collate
            return
        tasks = list(self.batch_sampler)
        pool, make = self._workers()
        view = self.dataset if isinstance(self.dataset, View) and self.worker_type == "thread" else None
        self.ahead_groups = GroupsAhead(view, tasks) if view is not None and view.cache.max_entries >= 2 else None
        due, sent = deque(), 0
        try:
            for k in range(len(tasks)):
                if self.ahead_groups is not None:
                    self.ahead_groups.advance(k)
                while sent < len(tasks) and len(due) < self.workers * self.ahead:
                    due.append(pool.submit(make, tasks[sent]))
                    sent += 1
                began = time.perf_counter()
                try:
                    value, rows, fetched, collate = due.popleft().result(self.timeout)
                except LateError:
                    raise TimeoutError(f"timed out waiting for batch {k} after {self.timeout} s") from None
                except Exception as e:
                    raise RuntimeError(f"a worker failed on batch {k}: {e}\n{traceback.format_exc()}") from e
                if self.pin and self.worker_type == "process":
                    value = pin(value)
                yield value, rows, time.perf_counter() - began, fetched, collate
        finally:
            for task in due:
                task.cancel()
            pool.shutdown(wait=False, cancel_futures=True)
            if self.ahead_groups is not None:
                self.ahead_groups.close()

    def _streamed(self):
        """Batches of an iterable, read by one thread ahead of the consumer."""
        held: queue.Queue = queue.Queue(max(2, self.ahead * max(1, self.workers)))
        stop, end = threading.Event(), object()

        def put(x) -> bool:
            while not stop.is_set():
                try:
                    held.put(x, timeout=0.1)
                    return True
                except queue.Full:
                    pass
            return False

        def produce() -> None:
            part, number = [], 0
            try:
                for row in self.dataset:
                    part.append(row)
                    if len(part) == self.batch_size:
                        if number % self.shards == self.shard_id and not put(part):
                            return
                        part, number = [], number + 1
                if part and not self.drop_last and number % self.shards == self.shard_id:
                    put(part)
                put(end)
            except BaseException as e:
                put(e)

        threading.Thread(target=produce, daemon=True).start()
        try:
            number = 0
            while True:
                began = time.perf_counter()
                try:
                    part = held.get(timeout=self.timeout)
                except queue.Empty:
                    raise TimeoutError(f"timed out waiting for batch {number} after {self.timeout} s") from None
                if part is end:
                    return
                if isinstance(part, BaseException):
                    raise RuntimeError(f"the source failed: {part}") from part
                ready = time.perf_counter()
                yield self.collate(part), len(part), ready - began, 0.0, time.perf_counter() - ready
                number += 1
        finally:
            stop.set()

    def _check(self, value, record: BatchRecord) -> None:
        def warn(kind: str, text: str) -> None:
            if kind not in self._warned:
                self._warned.add(kind)
                warnings.warn(text, UserWarning, stacklevel=4)

        empty = value is None or hasattr(value, "__len__") and not len(value) or isinstance(value, dict) and any(hasattr(v, "__len__") and not len(v) for v in value.values())
        if empty:
            warn("empty", f"batch {record.index} is empty or contains empty columns")
        if record.index < 5:
            return
        spent = lambda r: r.wait_s + (r.fetch_s + r.collate_s if self.workers == 0 else 0.0)
        recent = statistics.mean(map(spent, self.records[-BACK:]))
        if is_slow(spent(record), recent):
            warn("slow", f"batch {record.index} took {spent(record):.2f} s, slower than recent average of {recent:.2f} s")
        total = sum(r.wait_s + r.step_s for r in self.records)
        waited = sum(r.wait_s for r in self.records)
        if waited >= 0.05 and waited >= 0.8 * total:
            warn("starved", f"the consumer waited for data {100 * waited / total:.0f} % of the time")

    def benchmark(self, num_batches: int = 50, warmup: int = 5) -> BenchmarkResult:
        times, samples, seen = [], 0, 0
        rows = iter(self)
        try:
            while len(times) < num_batches:
                began = time.perf_counter()
                if next(rows, None) is None:
                    break
                seen += 1
                if seen > warmup:
                    times.append(time.perf_counter() - began)
                    samples += self.records[-1].rows
        finally:
            rows.close()
        if not times:
            return BenchmarkResult(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, error="no batches after the warm-up")
        total = max(sum(times), 1e-9)
        spread = 1e3 * statistics.stdev(times) if len(times) > 1 else 0.0
        return BenchmarkResult(
            len(times), samples, total, len(times) / total, samples / total, 1e3 * statistics.mean(times), 1e3 * min(times), 1e3 * max(times), spread, None, self.records
        )

    def bottleneck_report(self) -> dict:
        sums = {k: sum(getattr(r, k) for r in self.records) for k in ("wait_s", "fetch_s", "collate_s", "step_s")}
        total = sum(v for k, v in sums.items() if k != "step_s") or 1e-9
        share = {k[:-2]: 100 * v / total for k, v in sums.items() if k != "step_s"}
        verdict = "balanced"
        if share["wait"] >= 50 or share["fetch"] >= 60:
            verdict = "I/O"
        elif share["collate"] >= 40:
            verdict = "collate"
        return {"batches": len(self.records), **sums, "percent": share, "bottleneck": verdict}

    def enable_debug(self) -> None:
        self.debug = True

    def disable_debug(self) -> None:
        self.debug, self.records = False, []

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> BatchLoader:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def __repr__(self) -> str:
        return f"BatchLoader(batch_size={self.batch_size}, workers={self.workers}, batches={safe_len(self)}, closed={self.closed})"


def benchmark_loader(loader: BatchLoader, num_batches: int = 50, warmup: int = 5) -> dict:
    return loader.benchmark(num_batches, warmup).to_dict()


def shard_of_batch(batch: Column, shards: int, index: int) -> Column:
    """Batches that one shard of an iterable source takes."""
    check_shard(shards, index)
    return batch % F.lit(shards) == F.lit(index)
