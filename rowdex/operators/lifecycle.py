"""Which datasets are open, by id."""

from __future__ import annotations

import threading
from collections.abc import Iterator
from contextlib import contextmanager


class Registry:
    def __init__(self):
        self._open, self._lock, self._next = {}, threading.RLock(), 0

    def register(self, dataset, dataset_id: str | None = None) -> str:
        with self._lock:
            if dataset_id is None:
                self._next += 1
                dataset_id = f"dataset_{self._next}"
            name, k = dataset_id, 0
            while name in self._open and self._open[name] is not dataset:
                k += 1
                name = f"{dataset_id}_{k}"
            self._open[name] = dataset
            dataset.dataset_id = name
            return name

    def unregister(self, dataset_id: str):
        with self._lock:
            return self._open.pop(dataset_id, None)

    def get(self, dataset_id: str):
        return self._open.get(dataset_id)

    def list_datasets(self) -> dict:
        with self._lock:
            return {k: v.status for k, v in self._open.items()}

    def close(self, dataset_id: str) -> bool:
        dataset = self.unregister(dataset_id)
        if dataset is not None:
            dataset.close()
        return dataset is not None

    def close_all(self) -> int:
        return sum(self.close(k) for k in list(self._open))

    def stop_all_background_tasks(self) -> int:
        for dataset in list(self._open.values()):
            dataset.stop_background_download()
        return len(self._open)

    def __len__(self) -> int:
        return len(self._open)

    active_count = property(__len__)

    def __contains__(self, dataset_id: str) -> bool:
        return dataset_id in self._open

    def __repr__(self) -> str:
        return f"Registry({sorted(self._open)})"

    def __getstate__(self) -> dict:
        return {}

    def __setstate__(self, _: dict) -> None:
        self.__init__()


REGISTRY = Registry()


def list_active_datasets() -> dict:
    return REGISTRY.list_datasets()


def close_all_datasets() -> int:
    return REGISTRY.close_all()


def stop_all_background_tasks() -> int:
    return REGISTRY.stop_all_background_tasks()


@contextmanager
def managed_datasets() -> Iterator[Registry]:
    """Closes what was registered inside, and nothing else."""
    before = set(REGISTRY._open)
    try:
        yield REGISTRY
    finally:
        for k in set(REGISTRY._open) - before:
            REGISTRY.close(k)
