"""Index, views, orders, batches, archives, caches and resolution on small layouts."""

from __future__ import annotations

import json
import os
import pickle
import random
import threading
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import rowdex
from rowdex import cli, queries
from rowdex.functions import order
from rowdex.functions.collate import default_collate, numpy_collate
from rowdex.operators import batches, cache
from rowdex.operators.archive import Archive
from rowdex.operators.cache import DiskCache, FileCache, TableCache
from rowdex.operators.lifecycle import Registry, managed_datasets
from rowdex.plans.selection import Range, contiguous
from rowdex.plans.view import SplitDict, View
from rowdex.sources import resolve, rowgroup
from rowdex.sources.index import SplitIndex, build_index, cache_path


def sample(path, rows=100, group=25, start=0):
    ids = list(range(start, start + rows))
    table = pa.table({"id": pa.array(ids, pa.int64()), "text": [f"sample_text_{i}" for i in ids], "value": [i * 1.5 for i in ids], "payload": [f"payload_{i}".encode() for i in ids]})
    os.makedirs(os.path.dirname(path), exist_ok=True)
    pq.write_table(table, path, row_group_size=group)
    return str(path)


@pytest.fixture(scope="module")
def data(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    sample(f"{root}/train-00000.parquet", 50)
    sample(f"{root}/train-00001.parquet", 50, start=50)
    sample(f"{root}/validation-00000.parquet", 30, 30, start=1000)
    return str(root)


@pytest.fixture
def train(spark, data):
    return View.open(spark, [f"{data}/train-00000.parquet", f"{data}/train-00001.parquet"])


def ids(view):
    return [r["id"] for r in view.ordered().select("id").collect()]


def test_index(tmp_path):
    files = [sample(f"{tmp_path}/f1.parquet", 40, 20), sample(f"{tmp_path}/f2.parquet", 60, 30, 40)]
    index = build_index(files)
    assert [g.start for g in index.groups] + [index.num_rows] == [0, 20, 40, 70, 100]
    assert all(g.byte_length > 0 for g in index.groups)
    assert [(g.rg_index, a, b) for g, a, b in index.locate_range(15, 45)] == [(0, 15, 20), (1, 0, 20), (0, 0, 5)]
    assert index.locate_range(30, 30) == [] and len(index.locate_range(-5, 1000)) == 4
    assert index.locate_row(-1)[1] == 29 and index.locate_row(40)[0].file_index == 1
    for bad in (100, -101):
        with pytest.raises(IndexError, match="out of bounds"):
            index.locate_row(bad)
    with pytest.raises(ValueError):
        build_index([])
    again = SplitIndex.from_dict(json.loads(json.dumps(index.to_dict())))
    assert again.groups == index.groups and again.schema == index.schema


def test_index_cache(tmp_path, spark):
    file = sample(f"{tmp_path}/f.parquet", 30, 10)
    cache = str(tmp_path / "cache")
    assert len(build_index([file], cache_dir=cache).groups) == 3
    place = cache_path(cache, "train", [file])
    assert os.path.exists(place)
    with open(place, "w") as f:
        f.write("{")
    assert len(build_index([file], cache_dir=cache).groups) == 3
    sample(file, 10, 5)
    assert build_index([file], cache_dir=cache).num_rows == 10
    many = [sample(f"{tmp_path}/m{k}.parquet", 3, 2, 3 * k) for k in range(5)]
    assert build_index(many, spark=spark, on_executors=2).to_dict() == build_index(many).to_dict()


def test_reading(train):
    assert len(train) == 100
    for k in (0, 24, 25, 49, 50, 99, -1, -100):
        assert train[k]["id"] == k % 100
    assert train[5]["payload"] == b"payload_5"
    assert train[48:52]["id"] == [48, 49, 50, 51] and train[90:80:-5]["id"] == [90, 85]
    assert train[3:3] == {"id": [], "text": [], "value": [], "payload": []}
    assert train[[7, 99, 7, -1]]["id"] == [7, 99, 7, 99]
    for bad in (100, -101):
        with pytest.raises(rowdex.IndexOutOfBoundsError):
            train[bad]
    with pytest.raises(TypeError):
        train["id"]
    narrow = train.select_columns(["value", "id"])
    assert list(narrow[3]) == ["value", "id"] and narrow.schema.names == ["value", "id"]
    assert narrow.select_columns("text").column_names == ["text"]
    with pytest.raises(ValueError, match="not in dataset columns"):
        train.select_columns(["nope"])


def chain(view, model, rng):
    n = len(model)
    kind = rng.randrange(7)
    if kind == 0:
        k = rng.randint(0, n + 2)
        return view.take(k), model[:k]
    if kind == 1:
        k = rng.randint(0, n // 2 + 1)
        return view.skip(k), model[k:]
    if kind == 2:
        a, m = rng.randint(0, n + 1), rng.randint(0, n + 1)
        return view.slice(a, m), model[a : a + m]
    if kind == 3 and n:
        picked = [rng.randrange(-n, n) for _ in range(rng.randint(1, 30))]
        return view.select(picked), [model[k] for k in picked]
    if kind == 4:
        shards = rng.randint(1, 4)
        k = rng.randrange(shards)
        if rng.random() < 0.5:
            a, b = contiguous(n, shards, k)
            return view.shard(shards, k, contiguous=True), model[a:b]
        return view.shard(shards, k), model[k::shards]
    if kind == 5:
        seed = rng.randrange(100)
        held = list(model)
        random.Random(seed).shuffle(held)
        return view.shuffle(seed), held
    part = slice(rng.choice([None, rng.randint(-n, n)]), rng.choice([None, rng.randint(-n, n)]), rng.choice([None, 1, 2, -1, 3]))
    return view.rows(part), model[part]


def test_random_chains(train):
    for seed in range(500):
        rng = random.Random(seed)
        view, model = train, list(range(100))
        for _ in range(rng.randint(1, 6)):
            view, model = chain(view, model, rng)
        assert view.selection.positions().tolist() == model and len(view) == len(model)
        if seed < 40:
            assert view[:]["id"] == model
        if seed < 6:
            assert ids(view) == model


def test_plans_read_only_files_they_need(train):
    assert train.rows(slice(10, 20)).to_df().inputFiles()[0].endswith("train-00000.parquet")
    assert len(train.rows(slice(10, 20)).to_df().inputFiles()) == 1
    assert len(train.select([70, 80]).to_df().inputFiles()) == 1
    assert len(train.to_df().inputFiles()) == 2
    plan = train.select_columns("id").to_df()._jdf.queryExecution().executedPlan().toString()
    assert "payload" not in plan
    assert ids(train.take(0)) == []


def test_bad_shards(train):
    for bad in ((0, 0), (2, 2), (2, -1)):
        with pytest.raises(ValueError, match="positive|range"):
            train.shard(*bad)
    assert isinstance(train.shard(3, 1).selection, Range)


#: The first entries of seeded orders.
def test_orders():
    assert order.permutation(10, 42).tolist() == [7, 3, 2, 8, 5, 6, 9, 4, 0, 1]
    assert order.permutation(100, 42)[:8].tolist() == [42, 41, 91, 9, 65, 50, 1, 70]
    assert order.rolling_buffer(100, 20, 42)[:8].tolist() == [3, 0, 8, 7, 23, 4, 20, 17]
    assert sorted(order.rolling_buffer(100, 20, 42, 30)) == list(range(30, 100))
    groups = [range(a, a + 25) for a in range(0, 100, 25)]
    assert order.block_order(groups, [0, 0, 1, 1], 42)[:8].tolist() == [93, 91, 85, 96, 95, 81, 80, 86]
    assert order.block_order(groups, [0, 0, 0, 0], 42, 2)[:8].tolist() == [30, 73, 49, 61, 66, 70, 67, 57]
    assert order.random_draws(100, 7, 6, True).tolist() == [41, 19, 50, 83, 6, 9]
    ten = np.arange(10)
    assert order.distributed(ten, 4, 3).tolist() == [3, 7, 1]
    assert order.distributed(ten, 4, 3, drop_last=True).tolist() == [3, 7]
    assert order.distributed(ten, 4, 3, whole=True).tolist() == [9, 0, 1]
    assert order.distributed(np.arange(2), 5, 4).tolist() == [0]
    assert sorted(x for k in range(4) for x in order.distributed(ten, 4, k, pad=False)) == list(range(10))
    assert [contiguous(10, 4, k) for k in range(4)] == [(0, 3), (3, 6), (6, 8), (8, 10)]


def plain_buffer(n, size, seed):
    draw, held = random.Random(seed), list(range(min(n, size)))
    for k in range(size, n):
        at = draw.randint(0, size - 1)
        yield held[at]
        held[at] = k
    draw.shuffle(held)
    yield from held


def plain_blocks(n, block, per_file, seed):
    draw, files = random.Random(seed), []
    for first in range(0, n, block * per_file):
        files.append([list(range(a, min(n, a + block))) for a in range(first, min(n, first + block * per_file), block)])
    draw.shuffle(files)
    for groups in files:
        draw.shuffle(groups)
        for rows in groups:
            draw.shuffle(rows)
            yield from rows


def test_whole_orders(monkeypatch, spark, tmp_path):
    """The queries of whole tables against plain Python, on tables of another length than their SQL's."""
    n, sf = 4_321, str(tmp_path)
    pq.write_table(pa.table({"event_id": [3 * k for k in range(n)]}), f"{sf}/events.parquet")
    pq.write_table(pa.table({"o_orderkey": [5 * k for k in range(n)]}), f"{sf}/orders.parquet")
    vectors = [[float(k), k / 2] for k in range(n)]
    pq.write_table(pa.table({"vec_id": range(n), "embedding": vectors}), f"{sf}/embeddings.parquet")
    rows = lambda name: sorted(map(tuple, queries.QUERIES[name](spark, sf).select(*columns).collect()))
    columns = ["ord", "event_id"]
    assert rows("buffer_shuffle_all") == [(o, 3 * k) for o, k in enumerate(plain_buffer(n, 500, 42))]
    columns = ["ord", "o_orderkey"]
    assert rows("block_shuffle_all") == [(o, 5 * k) for o, k in enumerate(plain_blocks(n, 1000, 4, 42))]
    drawn = {}
    for seed in (3, 5, 42):
        drawn[seed] = list(range(n))
        random.Random(seed).shuffle(drawn[seed])
    monkeypatch.setattr(pq, "read_table", None)  # a saved table is not read as a whole
    assert rows("save_load_all") == [(o, 5 * k) for o, k in enumerate(drawn[5])]
    columns = ["ord", "batch_id", "o_orderkey"]
    assert rows("loader_plan_all") == [(o, o // 40, 5 * k) for o, k in enumerate(drawn[3])]
    columns = ["rg", "lo", "hi", "n"]
    at = [[o for o, k in enumerate(drawn[42]) if k // 1000 == g] for g in range(5)]
    assert rows("rowgroup_indices_all") == [(g, min(o), max(o), len(o)) for g, o in enumerate(at)]
    columns = ["ord", "vec_id", "embedding"]
    assert rows("nested_passthrough_all") == [(k, k, v) for k, v in enumerate(vectors)]


def test_iteration_and_resume(train):
    assert [r["id"] for r in train] == list(range(100))
    assert [r["id"] for r in train.iter_from(-5)] == [95, 96, 97, 98, 99]
    shuffled = train.shuffle(3)
    assert [r["id"] for r in shuffled.stream(80)] == ids(shuffled)[80:]
    held = train.shuffle(42, buffer_size=20)
    assert [r["id"] for r in held][:8] == [3, 0, 8, 7, 23, 4, 20, 17] and held[0]["id"] == 0
    again = [r["ord"] for r in train.hash_shuffled(5).collect()]
    assert sorted(again) == list(range(100))


def test_samplers(train):
    block = batches.BlockShuffledSampler(train, seed=42)
    assert list(block)[:8] == [93, 91, 85, 96, 95, 81, 80, 86] and len(block) == 100
    block.set_epoch(1)
    assert list(block)[:8] == [51, 71, 73, 70, 68, 57, 62, 67]
    assert sorted(block.file_order()) == [0, 1]
    parts = [list(batches.DistributedSampler(train, 3, k, seed=1)) for k in range(3)]
    assert {x for p in parts for x in p} == set(range(100)) and len({len(p) for p in parts}) == 1
    reverse = batches.RandomSampler(train, 5)
    wrapped = list(batches.DistributedSampler(reverse, 2, 0, shuffle=False))
    assert wrapped == list(reverse)[::2]
    assert list(batches.BatchSampler(range(5), 2)) == [[0, 1], [2, 3], [4]]
    assert len(batches.BatchSampler(range(5), 2, True)) == 2
    with pytest.raises(ValueError):
        batches.BatchSampler(range(5), 0)
    assert train.shuffle(1).row_group_files() and sorted(map(len, train.row_group_indices())) == [25] * 4


def test_collate():
    assert default_collate([]) == [] and default_collate(["a", None]) == ["a", None]
    assert default_collate([None, 1]) == [None, 1] and default_collate([b"x"]) == [b"x"]
    assert np.array_equal(np.asarray(default_collate([1, 2])), [1, 2]) and default_collate([1, None]) == [1, None]
    assert default_collate([[1], [1, 2]]) == [[1], [1, 2]]
    assert numpy_collate([{"a": 1, "b": "x"}, {"a": 2}])["b"] == ["x"]
    assert numpy_collate([[1, 2], [3, 4]]).shape == (2, 2)
    assert numpy_collate({"m": [np.ones((4, 4), np.float32)] * 2})["m"].shape == (2, 4, 4)
    assert numpy_collate([["a", 1], ["b", 2]])[0] == ["a", "b"]


@pytest.mark.parametrize("workers", [0, 3])
def test_loader(train, workers):
    held = train.select_columns(["id"])
    got = [b["id"].tolist() for b in held.to_dataloader(batch_size=16, num_workers=workers, collate_fn="numpy")]
    assert [x for b in got for x in b] == list(range(100)) and [len(b) for b in got] == [16] * 6 + [4]
    mixed = held.to_dataloader(batch_size=16, shuffle=True, num_workers=workers, drop_last=True, collate_fn="numpy")
    first = [x for b in mixed for x in b["id"].tolist()]
    mixed.set_epoch(1)
    assert len(first) == 96 and first != [x for b in mixed for x in b["id"].tolist()]
    began = time.perf_counter()
    for _ in held.to_dataloader(batch_size=5, num_workers=4):
        break
    assert time.perf_counter() - began < 1.5
    plan = held.shuffle(2).to_dataloader(batch_size=30).plan().orderBy("ord").collect()
    assert [r.batch_id for r in plan] == [k // 30 for k in range(100)] and [r.id for r in plan] == order.permutation(100, 2).tolist()
    report = mixed.bottleneck_report()
    assert report["batches"] == 6 and report["bottleneck"] in ("I/O", "collate", "balanced")
    assert held.to_dataloader(batch_size=4).benchmark(5, 1).batches == 5
    assert held.to_dataloader(batch_size=200).benchmark(5, 1).error


def test_loader_errors():
    rows = [{"x": k} for k in range(20)]
    for bad in ({"num_workers": -2}, {"batch_size": 0}, {"batch_sampler": [[1]], "shuffle": True}):
        with pytest.raises(ValueError):
            batches.BatchLoader(rows, **bad)
    with batches.BatchLoader(rows) as loader:
        assert len(loader) == 20
    with pytest.raises(RuntimeError, match="Cannot iterate over a closed"):
        next(iter(loader))

    class Failing(list):
        def __getitem__(self, k):
            if k == 7:
                raise ValueError("broken row")
            return super().__getitem__(k)

    with pytest.raises(RuntimeError, match="broken row"):
        list(batches.BatchLoader(Failing(rows), 2, num_workers=2))

    class Slow(list):
        def __getitem__(self, k):
            time.sleep(0.5)
            return super().__getitem__(k)

    with pytest.raises(TimeoutError, match="timed out waiting for batch"):
        list(batches.BatchLoader(Slow(rows), 1, num_workers=1, timeout=0.05))
    stream = batches.BatchLoader(iter(rows), 4, num_shards=2, shard_id=1)
    with pytest.raises(TypeError, match="has no static len"):
        len(stream)
    assert [b["x"].tolist() if hasattr(b["x"], "tolist") else b["x"] for b in stream] == [[4, 5, 6, 7], [12, 13, 14, 15]]
    with pytest.warns(UserWarning, match="empty or contains empty columns"):
        list(batches.BatchLoader(rows, 4, collate_fn=lambda b: {}))


def test_rowgroup_source(spark, train):
    rowgroup.register(spark)
    reader = spark.read.format("rowgroup").option("files", json.dumps(train.index.files))
    whole = reader.load()
    assert whole.columns == ["pos", "id", "text", "value", "payload"]
    assert whole.rdd.getNumPartitions() == 4 and sorted(r.pos for r in whole.collect()) == list(range(100))
    part = reader.option("start", 30).option("stop", 55).option("columns", '["id"]').load()
    assert part.rdd.getNumPartitions() == 2 and sorted(r.id for r in part.collect()) == list(range(30, 55))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        pushed = reader.option("start", 0).option("stop", 100).option("pushdown", "true").load().filter("pos >= 60 and pos < 70")
        assert pushed.rdd.getNumPartitions() == 1 and sorted(r.pos for r in pushed.collect()) == list(range(60, 70))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_odd_types(spark, tmp_path):
    table = pa.table({"t": pa.array([1, 2], pa.timestamp("ns")), "h": pa.array([1.5, 2.5], pa.float16()), "u": pa.array([1, 2**64 - 1], pa.uint64()), "d": pa.array(["a", "b"]).dictionary_encode()})
    pq.write_table(table, tmp_path / "x.parquet")
    rowgroup.register(spark)
    rows = spark.read.format("rowgroup").option("files", json.dumps([str(tmp_path / "x.parquet")])).load().collect()
    assert [float(r.h) for r in rows] == [1.5, 2.5] and int(rows[1].u) == 2**64 - 1 and rows[0].d == "a"


def test_resolve(data, tmp_path):
    assert {k: len(v) for k, v in resolve.resolve(data).items()} == {"train": 2, "validation": 1}
    with pytest.raises(rowdex.SplitNotFoundError):
        resolve.resolve(data, split="test")
    with pytest.raises(rowdex.DatasetNotFoundError):
        resolve.resolve(str(tmp_path / "none"))
    with pytest.raises(rowdex.RowdexError):
        resolve.resolve(42)
    assert resolve.resolve("https://h/x/train.parquet") == {"train": ["https://h/x/train.parquet"]}
    assert len(resolve.resolve(f"{data}/train-*.parquet")["train"]) == 2
    assert len(resolve.resolve(data_files={"a": f"{data}/train-*.parquet", "b": [f"{data}/none-*.parquet"]})["a"]) == 2
    sample(f"{tmp_path}/sub/x.parquet", 4)
    assert list(resolve.resolve(str(tmp_path))) == ["sub"] and list(resolve.resolve(str(tmp_path), split="test")) == ["test"]
    assert list(resolve.resolve(str(tmp_path), data_dir="sub")) == ["train"]
    assert resolve.parse_split_slice("train[3:9:2]") == ("train", slice(3, 9, 2))
    assert resolve.parse_split_slice("t[5]") == ("t", slice(5, 6)) and resolve.parse_split_slice(None) == (None, None)

    class Fake:
        def parquet_files(self, *_):
            return {"other": {"train": ["u1"]}, "default": {"test": ["u2"]}}

        def list_files(self, *_):
            return []

    assert resolve.resolve("a/b", hub=Fake()) == {"test": ["u2"]} and resolve.resolve("a/b", "other", hub=Fake()) == {"train": ["u1"]}


def test_token(monkeypatch, tmp_path):
    for name in resolve.TOKEN_NAMES:
        monkeypatch.delenv(name, raising=False)
    monkeypatch.setenv("HF_HOME", str(tmp_path))
    assert resolve.resolve_token() is None and resolve.resolve_token(False) is None and resolve.resolve_token(" a ") == "a"
    (tmp_path / "token").write_text("stored\n")
    assert resolve.resolve_token() == "stored"
    monkeypatch.setenv(resolve.TOKEN_NAMES[1], "env")
    assert resolve.resolve_token() == "env"


def test_load_save_and_dict(spark, data, tmp_path):
    held = rowdex.load_dataset(data, spark=spark, manage=False, cache_dir=str(tmp_path / "c"))
    assert isinstance(held, SplitDict) and held.num_rows == {"train": 100, "validation": 30}
    assert held.take(3).to_df().groupBy("split").count().count() == 2
    out = held.shuffle(1).take(10).save_to_disk(str(tmp_path / "saved"))
    back = rowdex.load_from_disk(out, spark=spark, manage=False)
    assert ids(back["train"]) == order.permutation(100, 1)[:10].tolist()
    assert rowdex.load_from_disk(out, "validation", spark=spark, manage=False).num_rows == 10
    with pytest.raises(rowdex.SplitNotFoundError):
        rowdex.load_from_disk(out, "test", spark=spark, manage=False)
    part = rowdex.load_dataset(data, split="train[10:50]", seed=4, start_index=5, num_shards=2, shard_id=1, spark=spark, manage=False, cache_dir=str(tmp_path / "c"))
    assert ids(part) == [10 + k for k in order.permutation(40, 4)[5:][1::2]]
    assert ids(rowdex.load_dataset(data, split="train[-5:]", spark=spark, manage=False, cache_dir=str(tmp_path / "c"))) == [95, 96, 97, 98, 99]
    table = pa.table({"id": [1, 2, 3]})
    os.makedirs(tmp_path / "arrow")
    with pa.OSFile(str(tmp_path / "arrow" / "test.arrow"), "wb") as f, pa.ipc.new_stream(f, table.schema) as w:
        w.write_table(table)
    assert ids(rowdex.load_from_disk(str(tmp_path / "arrow"), spark=spark, manage=False)) == [1, 2, 3]
    assert held["train"].to_pandas().id.tolist() == list(range(100))


def test_archive_and_resume(spark, tmp_path):
    files = [sample(f"{tmp_path}/src/f{k}.parquet", 10, 5, 10 * k) for k in range(3)]
    target = str(tmp_path / "archive")
    first = rowdex.load_dataset(files, split="train", spark=spark, save_to_disk=target, manage=False, cache_dir=str(tmp_path / "c"))
    assert first.save_progress() == 0.0
    first[12]
    assert first.archive.saved() == [(1, 0)] and 0 < first.save_progress() < 1
    with pytest.raises(rowdex.RowdexError, match="Incomplete progressive dataset"):
        rowdex.load_from_disk(target, allow_incomplete=False, spark=spark, manage=False)
    due = first.archive.missing(spark, 2).orderBy("turn").collect()
    assert [r.g for r in due] == [3, 4, 5, 0, 1]
    open(os.path.join(first.archive.folder, "rg_00000_00000.feather.tmp.1"), "w").close()
    again = rowdex.resume_dataset(target, files, "train", spark=spark, background_download=False, manage=False)
    assert not [n for n in os.listdir(again.archive.folder) if ".tmp" in n]
    again.start_background_download(10)
    again.archive.join(20)
    assert again.is_fully_saved()
    again.stream_and_save()
    back = rowdex.load_from_disk(target, allow_incomplete=False, spark=spark, manage=False)
    assert ids(back) == list(range(30))
    wide = Archive(str(tmp_path / "n"), again.index, "train")
    wide.save(0, 0, pa.table({"id": [1]}))
    assert wide.get(0, 0, ["id", "text"]) is None and wide.save(0, 0, pa.table({"id": [1], "text": ["a"]}))
    with pytest.raises(rowdex.RowdexError):
        rowdex.resume_dataset(str(tmp_path / "none"), spark=spark)


def test_table_cache():
    cache = TableCache(2)
    for k in "ab":
        cache.put(k, k)
    assert cache.get("a") == "a"
    cache.put("c", "c")
    assert cache.get("b") is None and cache.stats["hits"] == 1 and len(pickle.loads(pickle.dumps(cache))) == 0
    reads, gate = [], threading.Barrier(8)

    def read():
        reads.append(1)
        time.sleep(0.1)
        return "x"

    def ask():
        gate.wait()
        assert cache.get_or("k", read) == "x"

    threads = [threading.Thread(target=ask) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(reads) == 1
    with pytest.raises(ValueError):
        TableCache(0)


def test_disk_cache(tmp_path):
    cache = DiskCache(str(tmp_path))
    cache.put("u", 0, ["a"], pa.table({"a": [1]}))
    assert cache.get("u", 0, ["a"]).num_rows == 1 and cache.get("u", 0, None) is None
    with open(cache.path("u", 0, ["a"]), "w") as f:
        f.write("broken")
    assert cache.get("u", 0, ["a"]) is None
    cache.clear()
    assert not cache.contains("u", 0, ["a"])


def test_file_cache(tmp_path):
    fetched = []

    def fetch(url, path):
        fetched.append(url)
        time.sleep(0.02)
        with open(path, "wb") as f:
            f.write(b"x" * 100)

    url = lambda k: f"http://h/{k}/f.parquet"
    make = lambda name, **more: FileCache(str(tmp_path / name), fetch=fetch, prefetch_ahead=0, **more)
    cache = make("count", max_files=2)
    [cache.get_or_download(url(k)) for k in (1, 2, 3)]
    assert [cache.is_cached(url(k)) for k in (1, 2, 3)] == [False, True, True]
    cache = make("held", max_files=2)
    cache.get_or_download(url(1))
    cache.acquire(url(1))
    [cache.get_or_download(url(k)) for k in (2, 3)]
    assert [cache.is_cached(url(k)) for k in (1, 2, 3)] == [True, False, True]
    cache.mark_consumed(url(1))
    assert cache.is_cached(url(1))
    cache.release(url(1))
    assert not cache.is_cached(url(1))
    cache = make("bytes", max_files=None, max_bytes=150)
    [cache.get_or_download(url(k)) for k in (1, 2)]
    assert not cache.is_cached(url(1)) and cache.total_bytes == 100
    cache = make("keep", max_files=2, keep=True)
    cache.get_or_download(url(1))
    cache.mark_consumed(url(1))
    [cache.get_or_download(url(k)) for k in (2, 3)]
    assert all(cache.is_cached(url(k)) for k in (1, 2, 3)) and cache.stats["unconsumed_files"] == 2
    cache = make("ahead", max_files=2, max_bytes=100)
    cache.get_or_download(url(1))
    assert cache.prefetch([url(2)]) == []
    cache.mark_consumed(url(1))
    assert cache.prefetch([url(2), url(3)]) == [url(2), url(3)][: len(cache.prefetch([])) + 2]
    cache.close()
    cache = make("one", max_files=4)
    fetched.clear()
    threads = [threading.Thread(target=cache.get_or_download, args=(url(9),)) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert fetched == [url(9)]


def test_admission_by_ranges(monkeypatch, spark):
    """Running sums over ranges of the order, in more than one task."""
    monkeypatch.setattr(cache, "RANGE_ROWS", 50)
    rows = [(None if k == 0 else f"f{k:04d}", None if k % 7 == 1 else k % 13) for k in range(1000)]
    files = spark.createDataFrame(rows[::-1], "name string, size int").repartition(3)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = cache.admitted(files, "name", "size", 400, 2000).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(key)
    want, total = [], 0
    for k, (name, size) in enumerate(rows):
        want.append((name, size, k, total, k < 400 and total < 2000))
        total += size or 0
    assert sorted((r[:5] for r in got), key=lambda r: r[2]) == want
    assert max(Counter(r.task for r in got).values()) < len(rows)
    assert cache.admitted(files.limit(0), "name", "size", 40, 900).collect() == []


def test_registry(train, spark):
    held = Registry()
    assert held.register(train) == "dataset_1" and held.register(train.take(1), "x") == "x" and held.register(train.take(2), "x") == "x_1"
    assert "x" in held and len(held) == 3 and held.list_datasets()["x"]["rows"] == 1
    assert held.close("x") and not held.close("x") and held.close_all() == 2
    with managed_datasets() as registry:
        before = len(registry)
        registry.register(train.take(3))
        assert len(registry) == before + 1
    assert len(registry) == before


def test_cli(tmp_path, capsys, data, monkeypatch):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.tmp.1").write_text("")
    (tmp_path / "a" / "keep").write_text("")
    assert cli.main(["kill", "--cache-dir", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["removed"] == 1 and os.listdir(tmp_path / "a") == ["keep"]
    monkeypatch.setenv("ROWDEX_CACHE", str(tmp_path / "c"))
    assert cli.main(["benchmark", data, "--split", "train", "--runs", "2", "--columns", "id", "--loader"]) == 0
    out = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert out["rows"] == 100 and out["seek"]["mean_ms"] > 0 and out["loader"]["batches"] == 3


def test_feather_written_with_view(train, tmp_path):
    train.take(7).save_to_disk(str(tmp_path))
    assert feather.read_table(tmp_path / "train.feather").num_rows == 7
    with open(tmp_path / "train_info.json") as f:
        assert json.load(f)["num_rows"] == 7


def test_disk_cache_and_consumption(spark, data, tmp_path):
    held = rowdex.load_dataset(data, split="train", columns=["id"], disk_cache=True, spark=spark, manage=False, cache_dir=str(tmp_path))
    held[60]
    assert held.disk_cache.contains(held.index.files[1], 0, ["id"])

    class Fake:
        marked: list[str] = []

        def mark_consumed(self, url):
            self.marked.append(url)

        def reset_consumption(self):
            self.marked.clear()

    narrow = held.take(100)
    narrow.disk_cache, narrow.file_cache = None, Fake()
    assert len(narrow[:]["id"]) == 100
    assert Fake.marked == held.index.files
    narrow.reset_consumption()
    narrow.mark_file_consumed(1)
    assert Fake.marked == [held.index.files[1]]
