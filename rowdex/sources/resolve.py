"""From what a user names to ``{split: [files in order]}``."""

from __future__ import annotations

import glob
import json
import os
import re
from collections.abc import Mapping, Sequence
from typing import Protocol

from rowdex.errors import DatasetNotFoundError, RowdexError, SplitNotFoundError

#: Suffixes of Parquet files, and environment names of a hub token in order.
SUFFIXES = (".parquet", ".pq")
TOKEN_NAMES = ("HF_TOKEN", "HUGGING_FACE_HUB_TOKEN")
#: Words that name a split, in the order in which they are tried.
SPLIT_WORDS = {
    "validation": ("val", "valid", "validation", "dev", "eval"),
    "test": ("test", "testing"),
    "train": ("train", "training"),
}
#: Parts of a name that still hint at a split, in the order in which they are tried.
SPLIT_HINTS = {"val": "validation", "dev": "validation", "test": "test", "train": "train"}

_SLICE = re.compile(r"^(?P<name>[^\[\]]+)\[(?P<body>[-0-9:]+)\]$")


class Hub(Protocol):
    """A remote store of datasets; the package ships no client of its own."""

    def parquet_files(self, repo: str, config: str | None, revision: str | None, token: str | None) -> Mapping[str, Mapping[str, Sequence[str]]]:
        """config -> split -> file URLs, or an empty mapping."""

    def list_files(self, repo: str, revision: str | None, token: str | None) -> Sequence[str]:
        """URLs of all files."""


def parse_split_slice(spec: str | None) -> tuple[str | None, slice | None]:
    """``"train[a:b:c]"`` to its name and slice; ``[k]`` is one row."""
    if spec is None:
        return None, None
    found = _SLICE.match(spec.strip())
    if not found:
        return spec.strip(), None
    parts = found["body"].split(":")
    try:
        numbers = [int(p) if p else None for p in parts]
    except ValueError as e:
        raise ValueError(f"bad slice in split {spec!r}") from e
    if len(numbers) > 3:
        raise ValueError(f"bad slice in split {spec!r}")
    if len(numbers) == 1:
        k = numbers[0]
        return found["name"], slice(k, k + 1 if k != -1 else None)
    return found["name"], slice(*numbers)


def infer_split_name(path: str) -> str:
    """Whole words of the file name, then of its folder, then parts of the name."""
    base = os.path.basename(path).lower()
    folder = os.path.basename(os.path.dirname(path)).lower()
    for text in (base, folder):
        words = set(re.split(r"[^a-z0-9]+", text))
        for split, names in SPLIT_WORDS.items():
            if words & set(names):
                return split
    return next((split for hint, split in SPLIT_HINTS.items() if hint in base), "train")


def resolve_token(token: str | bool | None = None) -> str | None:
    """False: none. Text: itself. Else the environment, then a stored login."""
    if token is False:
        return None
    if isinstance(token, str):
        return token.strip() or None
    for name in TOKEN_NAMES:
        if value := os.environ.get(name, "").strip():
            return value
    stored = os.path.join(os.environ.get("HF_HOME", os.path.expanduser("~/.cache/huggingface")), "token")
    try:
        with open(stored, encoding="utf-8") as f:
            return f.read().strip() or None
    except OSError:
        return None


def _is_parquet(path: str) -> bool:
    return path.lower().split("?")[0].endswith(SUFFIXES)


def resolve_local(path: str, split: str | None = None) -> dict[str, list[str]]:
    """Files below a path. A file right there goes by its name, a nested one by
    its first folder; one split only takes the name that was asked for."""
    if os.path.isfile(path):
        if not _is_parquet(path):
            raise DatasetNotFoundError(path, "not a Parquet file")
        return {split or infer_split_name(path): [path]}
    if not os.path.isdir(path):
        raise DatasetNotFoundError(path)
    listed = os.path.join(path, "dataset_dict.json")
    out: dict[str, list[str]] = {}
    if os.path.exists(listed):
        with open(listed, encoding="utf-8") as f:
            for name in json.load(f).get("splits", []):
                if files := _below(os.path.join(path, name)):
                    out[name] = files
        if out:
            return out
    for file in _below(path):
        parts = os.path.relpath(file, path).split(os.sep)
        out.setdefault(parts[0] if len(parts) > 1 else infer_split_name(file), []).append(file)
    if not out:
        raise DatasetNotFoundError(path, "no Parquet files")
    if split and split not in out and len(out) == 1:
        out = {split: next(iter(out.values()))}
    return out


def _below(folder: str) -> list[str]:
    return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if _is_parquet(f))


def _expand(pattern: str) -> list[str]:
    """Files of a glob in order; a pattern that matches nothing stands for itself."""
    return sorted(glob.glob(pattern, recursive=True)) or [pattern]


def resolve_hub(hub: Hub, repo: str, config: str | None, revision: str | None, token: str | None) -> dict[str, list[str]]:
    configs = hub.parquet_files(repo, config, revision, token)
    if configs:
        chosen = config if config in configs else "default" if "default" in configs else next(iter(configs))
        return {split: list(files) for split, files in configs[chosen].items()}
    out: dict[str, list[str]] = {}
    for url in sorted(filter(_is_parquet, hub.list_files(repo, revision, token))):
        out.setdefault(infer_split_name(url), []).append(url)
    if not out:
        raise DatasetNotFoundError(repo, "no Parquet files")
    return out


def resolve(
    path: object = None, name: str | None = None, split: str | None = None, data_files: object = None, data_dir: str | None = None,
    token: str | bool | None = None, revision: str | None = None, hub: Hub | None = None,
) -> dict[str, list[str]]:
    """All splits of a source; only ``split`` must be among them if it is given."""
    wanted = parse_split_slice(split)[0]
    if data_files is not None or isinstance(path, Mapping):
        given = data_files if data_files is not None else path
        if isinstance(given, str):
            given = {wanted or "train": [given]}
        elif not isinstance(given, Mapping):
            given = {wanted or "train": list(given)}
        root = path if isinstance(path, str) and os.path.isdir(path) else ""
        out = {s: [f for p in ([fs] if isinstance(fs, str) else fs) for f in _expand(os.path.join(root, p))] for s, fs in given.items()}
    elif isinstance(path, (list, tuple)):
        out = {}
        for file in path:
            out.setdefault(wanted or infer_split_name(str(file)), []).append(str(file))
    elif isinstance(path, (str, os.PathLike)):
        place = os.path.join(os.fspath(path), data_dir) if data_dir else os.fspath(path)
        if os.path.exists(place):
            out = resolve_local(place, wanted)
        elif "://" in place and _is_parquet(place):
            out = {wanted or infer_split_name(place): [place]}
        elif any(c in place for c in "*?[") and (files := glob.glob(place, recursive=True)):
            out = resolve(sorted(files), split=wanted)
        elif hub is not None:
            out = resolve_hub(hub, os.fspath(path), name, revision, resolve_token(token))
        else:
            raise DatasetNotFoundError(path)
    else:
        raise RowdexError(f"cannot resolve a source of type {type(path).__name__}")
    if not any(out.values()):
        raise DatasetNotFoundError(path, "no files")
    if wanted is not None and wanted not in out:
        raise SplitNotFoundError(wanted, list(out))
    return out
