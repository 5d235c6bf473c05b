"""Opening datasets: from a source, from disk, or an archive to go on with."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable

import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from rowdex.errors import DatasetNotFoundError, RowdexError, SplitNotFoundError
from rowdex.operators.archive import Archive, read_manifest
from rowdex.operators.cache import DiskCache, FileCache, TableCache
from rowdex.operators.lifecycle import REGISTRY
from rowdex.plans.view import SplitDict, View
from rowdex.sources.index import build_index
from rowdex.sources.resolve import Hub, parse_split_slice, resolve, resolve_local, resolve_token
from rowdex.sources.transport import download_all, is_remote


def default_dir(kind: str) -> str:
    """ROWDEX_CACHE and ROWDEX_SAVE name the folders, else ones in the home folder."""
    return os.environ.get(f"ROWDEX_{kind.upper()}") or os.path.join(os.path.expanduser("~/.rowdex"), kind)


def _arrange(view: View, part: slice | None, shuffle: bool | None, seed: int | None, buffer_size: int | None, start: int, shards: int | None, shard_id: int | None, contiguous: bool) -> View:
    """The fixed order of view operations: split slice, shuffle, skip, shard."""
    if part is not None:
        view = view.rows(part)
    if shuffle or shuffle is None and seed is not None:
        view = view.shuffle(seed, buffer_size)
    if start > 0:
        view = view.skip(start)
    if shards is not None and shards > 1:
        view = view.shard(shards, shard_id or 0, contiguous)
    return view


def _shown(name: str) -> Callable[[int, int], None]:
    return lambda done, total: print(f"{name}: {done} of {total} files", file=sys.stderr)


def load_dataset(
    path: object = None, name: str | None = None, data_dir: str | None = None, data_files: object = None, split: str | None = None, *,
    spark: SparkSession | None = None, cache_dir: str | None = None, streaming: bool = False, save_to_disk: bool | str = False,
    background_download: bool = False, columns: list[str] | None = None, token: str | bool | None = None, revision: str | None = None,
    max_cached_row_groups: int = 2, disk_cache: bool = False, shuffle: bool | None = None, seed: int | None = None, buffer_size: int | None = None, start_index: int = 0,
    from_index: int = 0, dataset_id: str | None = None, manage: bool = True, max_cached_files: int | None = None, max_cache_gb: float | None = None,
    num_shards: int | None = None, shard_id: int | None = None, world_size: int | None = None, rank: int | None = None,
    contiguous_shards: bool = False, hub: Hub | None = None, max_workers: int = 16, show_progress: bool = False, cache_files: bool | None = None,
) -> View | SplitDict:
    """A view of one split, or a dict of all. Only footers are read here.

    Remote files: with ``streaming`` (or ``save_to_disk``) rows come by HTTP ranges
    of the row groups and columns that are read, and no file is fetched whole; with
    ``cache_files``, or a bound on cached files, each file comes whole when its rows
    are read and leaves by that bound; else all come first, ``max_workers`` at a time.

    save_to_disk: a folder (or True for the default one) that becomes an archive
    as row groups are read; background_download fills it meanwhile.
    """
    spark = spark or SparkSession.builder.getOrCreate()
    cache_dir = cache_dir or default_dir("cache")
    wanted, part = parse_split_slice(split)
    found = resolve(path, name, split, data_files, data_dir, token, revision, hub)
    secret = resolve_token(token)
    shards, own = (num_shards if num_shards is not None else world_size), (shard_id if shard_id is not None else rank)
    target = None
    if save_to_disk:
        target = save_to_disk if isinstance(save_to_disk, str) else os.path.join(default_dir("save"), dataset_id or "dataset")
    views = SplitDict()
    for key, files in found.items():
        if wanted is not None and key != wanted:
            continue
        held, urls = None, {}
        if any(map(is_remote, files)):
            if cache_files or cache_files is None and (max_cached_files or max_cache_gb):
                most = max_cached_files or (None if max_cache_gb else 4)
                held = FileCache(os.path.join(cache_dir, "file_cache", key), most, max_gb=max_cache_gb, token=secret, keep=bool(target))
                held.set_file_sequence(files)  # files come when their rows are read; footers by range requests
                urls = {f: f for f in files}
            elif not (streaming or target):
                files = download_all(files, os.path.join(cache_dir, "downloads", key), secret, max_workers, _shown(key) if show_progress else None)
        index = build_index(files, key, spark, cache_dir, secret)
        unknown = [c for c in columns or [] if c not in index.schema.names]
        if unknown:
            raise ValueError(f"{unknown} not in dataset columns {index.schema.names}")
        view = View(spark, index, columns=columns, cache=TableCache(max_cached_row_groups))
        view.file_cache, view.urls, view.disk_cache = held, urls, DiskCache(cache_dir) if disk_cache else None
        view.token = secret
        if target:
            base = target if wanted is not None else os.path.join(target, key)
            view.archive = Archive(base, index, key, source=os.fspath(path) if isinstance(path, os.PathLike) else path or data_files, columns=columns, token=secret)
        view = _arrange(view, part, shuffle, seed, buffer_size, start_index or from_index, shards, own, contiguous_shards)
        if background_download:
            view.start_background_download(0)
        views[key] = view
    if target and wanted is None:
        os.makedirs(target, exist_ok=True)
        with open(os.path.join(target, "dataset_dict.json"), "w", encoding="utf-8") as f:
            json.dump({"splits": list(views)}, f)
    out = views[wanted] if wanted is not None else views
    if manage:
        REGISTRY.register(out, dataset_id)
    return out


def _newest(folder: str) -> str:
    held = [os.path.join(folder, d) for d in (os.listdir(folder) if os.path.isdir(folder) else [])]
    held = [d for d in held if os.path.isdir(d)]
    if not held:
        raise DatasetNotFoundError(folder, "nothing was saved there")
    return max(held, key=os.path.getmtime)


def _saved_files(path: str, split: str | None, allow_incomplete: bool) -> dict[str, list[str]]:
    """Files of a saved dataset; archives and Arrow files become Parquet once."""
    listing = os.path.join(path, "dataset_dict.json")
    if os.path.exists(listing):
        with open(listing, encoding="utf-8") as f:
            names = json.load(f)["splits"]
        out: dict[str, list[str]] = {}
        for name in names:
            out |= _saved_files(os.path.join(path, name), name, allow_incomplete)
        return out
    archives = os.path.join(path, "row_groups")
    if os.path.isdir(archives):
        out = {}
        for name in sorted(os.listdir(archives)):
            state = read_manifest(path, name) or {}
            if not allow_incomplete and not state.get("is_complete", False):
                raise RowdexError(f"Incomplete progressive dataset {path!r}, split {name!r}: {state.get('saved_count', 0)} of {state.get('total_row_groups')} row groups")
            out[name] = [Archive(path, None, name).to_parquet()]
        return out
    try:
        return resolve_local(path, split)
    except DatasetNotFoundError:
        pass
    out = {}
    for name in sorted(os.listdir(path)) if os.path.isdir(path) else []:
        stem, kind = os.path.splitext(name)
        file = os.path.join(path, name)
        if kind in (".feather", ".arrow"):
            out[stem] = [_as_parquet(file, os.path.join(path, f"{stem}.parquet"))]
        elif os.path.isdir(file):
            try:
                out |= {name: next(iter(_saved_files(file, name, allow_incomplete).values()))}
            except DatasetNotFoundError:
                continue
    if not out:
        raise DatasetNotFoundError(path, "neither an archive nor Parquet, Feather or Arrow files")
    return out


def _incomplete(path: str, split: str | None) -> bool:
    """Whether an archive below ``path`` lacks row groups of a split, or of any."""
    for place, _, names in os.walk(path):
        for name in names:
            if name.endswith("_manifest.json") and split in (None, name[: -len("_manifest.json")]):
                if not (read_manifest(place, name[: -len("_manifest.json")]) or {}).get("is_complete", True):
                    return True
    return False


def _as_parquet(file: str, target: str) -> str:
    try:
        table = feather.read_table(file)
    except pa.ArrowInvalid:
        with pa.memory_map(file) as f:
            table = pa.ipc.open_stream(f).read_all()
    pq.write_table(table, f"{target}.tmp")
    os.replace(f"{target}.tmp", target)
    return target


def load_from_disk(
    path: str | None = None, split: str | None = None, *, spark: SparkSession | None = None, columns: list[str] | None = None, allow_incomplete: bool = True,
    shuffle: bool | None = None, seed: int | None = None, buffer_size: int | None = None, start_index: int = 0, from_index: int = 0,
    dataset_id: str | None = None, manage: bool = True, num_shards: int | None = None, shard_id: int | None = None, world_size: int | None = None,
    rank: int | None = None, contiguous_shards: bool = False, token: str | bool | None = None, background_download: bool = True, resume: bool = False,
) -> View | SplitDict:
    """What ``save_to_disk`` or an archive left; without a path, the newest.

    resume: an archive that is not complete is opened as by ``resume_dataset``,
    with ``token`` for its source and ``background_download``.
    """
    path = path or _newest(default_dir("save"))
    wanted, _ = parse_split_slice(split)
    if resume and _incomplete(path, wanted):
        return resume_dataset(path, None, split, spark=spark, background_download=background_download, columns=columns, token=token, dataset_id=dataset_id, manage=manage, num_shards=num_shards if num_shards is not None else world_size, shard_id=shard_id if shard_id is not None else rank)
    found = _saved_files(path, None, allow_incomplete)
    if wanted is not None and wanted not in found:
        if len(found) > 1:
            raise SplitNotFoundError(wanted, list(found))
        found = {wanted: next(iter(found.values()))}
    out = load_dataset(
        found, split=split or (next(iter(found)) if len(found) == 1 and not os.path.exists(os.path.join(path, "dataset_dict.json")) else None), spark=spark,
        columns=columns, shuffle=shuffle, seed=seed, buffer_size=buffer_size, start_index=start_index, from_index=from_index, dataset_id=dataset_id,
        manage=manage, num_shards=num_shards, shard_id=shard_id, world_size=world_size, rank=rank, contiguous_shards=contiguous_shards,
    )
    return out


def resume_dataset(
    path: str, source_path: object = None, split: str | None = None, *, spark: SparkSession | None = None, background_download: bool = True,
    columns: list[str] | None = None, token: str | bool | None = None, dataset_id: str | None = None, manage: bool = True,
    num_shards: int | None = None, shard_id: int | None = None,
) -> View | SplitDict:
    """Goes on with an archive: its source is opened again and only row groups
    that are missing are read."""
    listing = os.path.join(path, "dataset_dict.json")
    if os.path.exists(listing) and split is None:
        with open(listing, encoding="utf-8") as f:
            names = json.load(f)["splits"]
        out = SplitDict()
        for name in names:
            out[name] = resume_dataset(
                os.path.join(path, name), source_path, name, spark=spark, background_download=background_download, columns=columns, token=token,
                manage=False, num_shards=num_shards, shard_id=shard_id,
            )
        if manage:
            REGISTRY.register(out, dataset_id)
        return out
    if split is None:
        held = sorted(n[: -len("_manifest.json")] for n in os.listdir(path) if n.endswith("_manifest.json")) if os.path.isdir(path) else []
        split = held[0] if held else None
    state = read_manifest(path, split) if split else None
    source = source_path or (state or {}).get("source_path")
    if not source:
        raise RowdexError(f"{path!r} does not say where its rows come from; give source_path")
    return load_dataset(
        source, split=split, spark=spark, save_to_disk=path, background_download=background_download, columns=columns or (state or {}).get("columns"),
        token=token, dataset_id=dataset_id, manage=manage, num_shards=num_shards, shard_id=shard_id,
    )
