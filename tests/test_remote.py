"""Remote files by ranges, background archives, prefetch, worker processes, long orders and saves."""

from __future__ import annotations

import os
import pickle
import threading
import time
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import rowdex
from rowdex.errors import RowdexError
from rowdex.operators import batches
from rowdex.operators.cache import FileCache
from rowdex.plans import view as views
from rowdex.plans.selection import Keyed, Range, keyed
from rowdex.plans.view import View
from rowdex.sources import files as handles
from rowdex.sources import transport
from rowdex.sources.index import build_index
from rowdex.sources.serve import RangeServer
from tests.test_transport import server  # noqa: F401


@pytest.fixture(scope="module")
def remote(tmp_path_factory):
    """Four files of three row groups of 200 rows; 300 bytes a row that do not compress."""
    folder, rng = tmp_path_factory.mktemp("remote"), np.random.default_rng(0)
    for k in range(4):
        ids = list(range(600 * k, 600 * k + 600))
        table = pa.table({"id": ids, "blob": [rng.bytes(300) for _ in ids], "value": [i * 0.5 for i in ids]})
        pq.write_table(table, folder / f"part{k}.parquet", row_group_size=200)
    held = RangeServer(str(folder))
    yield held, [f"{held.url}/part{k}.parquet" for k in range(4)], folder
    held.close()


def load(spark, urls, tmp_path, **more):
    return rowdex.load_dataset(urls, split="train", spark=spark, manage=False, cache_dir=str(tmp_path / "cache"), **more)


def test_streaming_fetches_ranges_only(spark, remote, tmp_path):
    held, urls, folder = remote
    held.sent.clear(), held.requests.clear()
    view = load(spark, urls, tmp_path, streaming=True)
    footers = dict(held.sent)
    assert len(view) == 2400 and all(n <= transport.FOOTER_GUESS for n in footers.values())
    assert not [r for r in held.requests if r[0] == "HEAD" or r[2] is None]
    assert view[650]["id"] == 650
    group = view.index.locate_row(650)[0]
    spent = held.sent["part1.parquet"] - footers["part1.parquet"]
    assert group.byte_length <= spent <= group.byte_length + 2 * transport.FOOTER_GUESS
    assert {k: held.sent[k] for k in footers if k != "part1.parquet"} == {k: v for k, v in footers.items() if k != "part1.parquet"}
    before = sum(held.sent.values())
    narrow = view.select_columns(["id"])
    assert narrow[1900:1910]["id"] == list(range(1900, 1910))
    assert sum(held.sent.values()) - before < 3 * transport.FOOTER_GUESS + 10_000  # a column, and a footer
    assert not os.path.exists(tmp_path / "cache" / "downloads")


def test_plans_over_remote_files(spark, remote, tmp_path):
    held, urls, _ = remote
    view = load(spark, urls, tmp_path, streaming=True, columns=["id", "value"])
    held.sent.clear()
    assert [r.id for r in view.ordered().collect()] == list(range(2400))
    held.sent.clear()
    assert sorted(tuple(r) for r in view.rows(slice(1000, 700, -3)).to_df().select("ord", "id").collect()) == [(k, 1000 - 3 * k) for k in range(100)]
    assert set(held.sent) == {"part1.parquet"}
    drawn = [5, 2399, 5, 1200]
    assert [r.id for r in view.select(drawn).ordered().collect()] == drawn
    assert [r.id for r in view.shuffle(3).take(20).ordered().collect()] == view.shuffle(3)[0:20]["id"]
    plan = view.shuffle(3).to_dataloader(batch_size=100).plan()
    assert plan.groupBy("batch_id").count().filter("count <> 100").count() == 0
    saved = view.take(50).save_to_disk(str(tmp_path / "saved"))
    assert rowdex.load_from_disk(saved, spark=spark, manage=False)[49]["id"] == 49


def test_background_archive_of_remote_files(spark, remote, tmp_path):
    held, urls, folder = remote
    target = str(tmp_path / "archive")
    view = load(spark, urls, tmp_path, save_to_disk=target, background_download=True)
    view.archive.join(60)
    assert view.is_fully_saved() and view.save_progress() == 1.0
    again = rowdex.load_from_disk(target, allow_incomplete=False, spark=spark, manage=False)
    assert [r.id for r in again.select_columns("id").ordered().collect()] == list(range(2400))
    part = load(spark, urls, tmp_path, save_to_disk=str(tmp_path / "part"))
    part[700]
    assert 0 < part.save_progress() < 1
    more = rowdex.load_from_disk(str(tmp_path / "part"), "train", spark=spark, manage=False, resume=True)
    more.archive.join(60)
    assert more.is_fully_saved() and more[2399]["id"] == 2399
    bad = load(spark, urls, tmp_path, save_to_disk=str(tmp_path / "bad"))
    os.rename(folder / "part2.parquet", folder / "gone")
    try:
        handles.HANDLES.forget()
        bad.start_background_download()
        with pytest.raises(RowdexError, match="failed"):
            bad.archive.join(60)
        with pytest.raises(RowdexError):
            bad.save_progress()
    finally:
        os.rename(folder / "gone", folder / "part2.parquet")


def test_manifest_is_not_written_for_each_group(tmp_path, monkeypatch, remote):
    from rowdex.operators.archive import Archive

    index = build_index([str(remote[2] / "part0.parquet")])
    held, count = Archive(str(tmp_path), index, "train"), []
    whole = held._write_manifest
    monkeypatch.setattr(held, "_write_manifest", lambda: count.append(1) or whole())
    for k in range(400):
        held.save(0, k, pa.table({"id": [k]}))
    assert len(count) < 100 and len(held.saved()) == 400


def test_range_file(server):  # noqa: F811
    url, asked, fail, folder = server
    data = (folder / "wide.parquet").read_bytes()
    held = transport.RangeFile(f"{url}/wide.parquet", "secret", sleep=lambda _: None)
    assert held.size() == len(data) and asked[-1][3] == "Bearer secret"
    held.seek(100)
    assert held.read(50) == data[100:150] and held.tell() == 150
    count = len(asked)
    assert held.read(20) == data[150:170] and len(asked) == count  # from the block
    held.seek(-30, os.SEEK_END)
    assert held.read() == data[-30:] and held.read(5) == b"" and len(asked) == count  # from the footer's block
    held.seek(10)
    assert held.read(90_000) == data[10:90_010]
    fail["/wide.parquet"] = [503, 500]
    held.seek(transport.BLOCK * 2)
    assert held.read(3) == data[transport.BLOCK * 2 :][:3]
    fail["/wide.parquet"] = [429]
    held.seek(transport.BLOCK * 3 + 5)
    with pytest.raises(rowdex.errors.RateLimitError):
        held.read(3)


def test_handles(tmp_path):
    held = handles.Handles(2)
    paths = [str(tmp_path / f"f{k}.parquet") for k in range(3)]
    for k, path in enumerate(paths):
        pq.write_table(pa.table({"id": [k]}), path)
    first = held.open(paths[0])
    assert held.open(paths[0]) is first
    held.open(paths[1]), held.open(paths[2])
    assert len(held.held) == 2 and held.open(paths[0]) is not first
    pq.write_table(pa.table({"id": [7, 8]}), f"{paths[0]}.new")
    os.replace(f"{paths[0]}.new", paths[0])
    assert held.open(paths[0]).metadata.num_rows == 2  # replaced, so opened again
    seen = []
    thread = threading.Thread(target=lambda: seen.append(len(held.held)))
    thread.start(), thread.join()
    assert seen == [0]
    held.forget()
    assert not held.held


def test_download_once_among_threads(server, tmp_path):  # noqa: F811
    url, asked, _, _ = server
    target = str(tmp_path / "x" / "x.parquet")
    with batches.ThreadPoolExecutor(6) as pool:
        assert set(pool.map(lambda _: transport.download(f"{url}/x.parquet", target), range(6))) == {target}
    assert [a[0] for a in asked].count("GET") == 1


def test_files_in_use_stay(spark, remote, tmp_path):
    _, urls, _ = remote
    view = load(spark, urls, tmp_path, max_cached_files=1)
    cache, dropped = view.file_cache, []
    whole = view._read_columns

    def slow(group, path):
        cache.enforce()  # another reader would evict it here
        for other in urls:
            if other != view.urls[group.path]:
                cache.get_or_download(other)
        dropped.append(os.path.exists(path))
        return whole(group, path)

    view._read_columns = slow
    assert view[650]["id"] == 650 and view[10]["id"] == 10
    assert dropped == [True, True] and not cache._used


def test_epochs_set_the_file_sequence(spark, remote, tmp_path):
    _, urls, _ = remote
    view = load(spark, urls, tmp_path, max_cached_files=2, columns=["id"])
    loader = view.to_dataloader(batch_size=200, shuffle=True, seed=4)
    seen = set()
    for epoch in range(4):
        view.file_cache.mark_consumed(urls[0])
        loader.set_epoch(epoch)
        assert not view.file_cache.is_consumed(urls[0])
        order = [urls[k] for k in loader.batch_sampler.sampler.file_order()]
        assert view.file_cache.sequence == order and sorted(order) == sorted(urls)
        visited = list(dict.fromkeys(i // 600 for part in loader.batch_sampler for i in part))
        assert [urls[k] for k in visited] == order
        seen.add(tuple(order))
    assert len(seen) > 1
    view.file_cache.close()


def test_row_groups_come_ahead(spark, remote):
    view = View.open(spark, [str(remote[2] / f"part{k}.parquet") for k in range(4)])
    view.cache.max_entries = 6
    reads, whole = [], view._read_group
    view._read_group = lambda g: reads.append(view.index.groups.index(g)) or whole(g)
    loader = view.to_dataloader(batch_size=50, num_workers=1, prefetch_factor=1)
    rows = iter(loader)
    next(rows)
    deadline = time.time() + 10
    while len(set(reads)) < 3 and time.time() < deadline:
        time.sleep(0.01)
    assert set(loader.ahead_groups.asked) == {0, 1, 2} and set(reads) == {0, 1, 2}  # 3 = half of 6
    rows.close()
    assert [int(x) for part in view.to_dataloader(batch_size=70, num_workers=2, collate_fn="numpy") for x in part["id"]] == list(range(2400))
    assert Counter(reads).most_common(1)[0][1] <= 2


def test_worker_processes(spark, remote, tmp_path):
    _, urls, folder = remote
    local = View.open(spark, [str(folder / f"part{k}.parquet") for k in range(4)]).select_columns("id").shuffle(5)
    back = pickle.loads(pickle.dumps(local))
    assert back[0:5] == local[0:5] and back.selection.positions().tolist() == local.selection.positions().tolist()
    for view in (local, load(spark, urls, tmp_path, streaming=True, columns=["id"]).shuffle(5)):
        loader = view.take(600).to_dataloader(batch_size=100, num_workers=2, worker_type="process", collate_fn=lambda rows: ([2 * x for x in rows["id"]], os.getpid()))
        got = list(loader)
        assert [x for part, _ in got for x in part] == [2 * x for x in local[0:600]["id"]]
        assert os.getpid() not in {p for _, p in got}
    assert pickle.loads(pickle.dumps(back)).to_df().count() == 2400  # finds the session again
    with pytest.raises(ValueError):
        local.to_dataloader(worker_type="fibre")


# long orders and saves
def test_keyed_order():
    for n in (1, 2, 3, 7, 100, 4097):
        held = Keyed.of(Range(5, n, 3), 9)
        at = held.positions()
        assert sorted(at.tolist()) == Range(5, n, 3).positions().tolist() and (held.ordinals(at) == np.arange(n)).all()
        part = held.slice(1, n, 2)
        found = part.ordinals(at)
        assert (at[found >= 0] == part.positions()[found[found >= 0]]).all() and (found >= 0).sum() == len(part)
    n = 50_000_000
    keys = Keyed.of(Range(0, n), 1).keys
    drawn = keyed(np.arange(20_000), n, keys)
    assert (keyed(drawn, n, keys, back=True) == np.arange(20_000)).all() and abs(drawn.mean() / n - 0.5) < 0.01
    assert abs(np.corrcoef(drawn[1:], drawn[:-1])[0, 1]) < 0.03


def test_views_with_keyed_orders(spark, remote, monkeypatch):
    monkeypatch.setattr(views, "LISTED_ROWS", 100)
    view = View.open(spark, [str(remote[2] / f"part{k}.parquet") for k in range(4)]).select_columns("id")
    held = view.shuffle(8)
    assert isinstance(held.selection, Keyed) and held.is_permuted and view.shuffle(9)[0:9] != held[0:9]
    order = held[:]["id"]
    assert sorted(order) == list(range(2400)) and order != list(range(2400))
    assert [r.id for r in held.ordered().collect()] == order
    chain = held.skip(100).shard(4, 1).take(77)
    assert [r.id for r in chain.ordered().collect()] == chain[:]["id"] == order[101::4][:77]
    assert [r["id"] for r in held.iter_from(2390)] == order[2390:]
    assert held.select([3, -1])[:]["id"] == [order[3], order[-1]]
    assert [r.id for r in view.skip(50).shuffle(8).to_dataloader(batch_size=64).plan().orderBy("ord").collect()] == view.skip(50).shuffle(8)[:]["id"]


def test_plan_of_an_epoch(spark, remote):
    view = View.open(spark, [str(remote[2] / f"part{k}.parquet") for k in range(4)]).select_columns("id")
    for loader in (
        view.to_dataloader(batch_size=70), view.to_dataloader(batch_size=70, drop_last=True), view.to_dataloader(batch_size=70, shuffle=True, seed=2),
        view.to_dataloader(batch_sampler=[[1, 2], [5], [], [7, 7, 9]]),
    ):
        want = [(b, i) for b, part in enumerate(loader.batch_sampler) for i in part]
        got = loader.plan().orderBy("ord").collect()
        assert [(r.batch_id, r.id) for r in got] == want and [r.ord for r in got] == list(range(len(want)))


def test_long_views_are_saved_in_parts(spark, remote, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "SAVE_ROWS", 500)
    view = View.open(spark, [str(remote[2] / f"part{k}.parquet") for k in range(4)]).select_columns("id").shuffle(6)
    target = view.save_to_disk(str(tmp_path / "long"))
    assert len([f for f in os.listdir(f"{target}/train") if f.endswith(".parquet")]) > 2
    back = rowdex.load_from_disk(target, spark=spark, manage=False)
    assert back[:]["id"] == view[:]["id"]


def test_latency_by_blocks(spark):
    rng = np.random.default_rng(1)
    steps = [0.1 + 5 * float(x > 0.97) for x in rng.random(500)]
    rows = spark.createDataFrame(list(enumerate(steps)), "k long, s double").repartition(4)
    got = {r.k: (r.recent, r.spike) for r in batches.latency_report(rows, "s", "k", block=16).collect()}
    for k, s in enumerate(steps):
        before = steps[max(0, k - 4) : k]
        recent = sum(before) / len(before) if before else None
        assert (got[k][0] is None) == (recent is None) and (recent is None or abs(got[k][0] - recent) < 1e-9)
        assert got[k][1] == (len(before) == 4 and s > 5 * recent and s > 0.2)


def test_load_options(spark, remote, tmp_path, capsys):
    _, urls, _ = remote
    view = load(spark, urls, tmp_path, max_workers=3, show_progress=True)
    assert "4 of 4 files" in capsys.readouterr().err and view.file_cache is None
    cached = load(spark, urls, tmp_path / "b", cache_files=True)
    assert isinstance(cached.file_cache, FileCache) and cached.file_cache.max_files == 4 and cached[700]["id"] == 700
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert load(spark, urls, tmp_path / "c", cache_files=False, max_cached_files=2, streaming=True).file_cache is None
    assert view.select_columns("id").to_df().agg(F.sum("id")).first()[0] == 2399 * 1200
