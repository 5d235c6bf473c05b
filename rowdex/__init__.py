"""Position-addressed access to multi-file Parquet datasets, as Spark plans.

Names are loaded when they are first used, so that an executor's worker which
needs one module does not import them all.
"""

from importlib import import_module

_HOMES = {
    "rowdex.api": "load_dataset load_from_disk resume_dataset",
    "rowdex.errors": "CorruptParquetError DatasetNotFoundError IndexOutOfBoundsError NetworkRangeError RateLimitError RowdexError SplitNotFoundError",
    "rowdex.functions.collate": "default_collate numpy_collate",
    "rowdex.operators.archive": "Archive",
    "rowdex.operators.batches": "BatchLoader BatchSampler BlockShuffledSampler DistributedSampler RandomSampler SequentialSampler benchmark_loader",
    "rowdex.operators.cache": "DiskCache FileCache TableCache",
    "rowdex.operators.lifecycle": "REGISTRY close_all_datasets list_active_datasets managed_datasets stop_all_background_tasks",
    "rowdex.plans.view": "SplitDict View",
    "rowdex.sources.index": "RowGroup SplitIndex build_index",
    "rowdex.sources.resolve": "infer_split_name parse_split_slice resolve",
}
_HOME_OF = {name: home for home, names in _HOMES.items() for name in names.split()}
__all__ = sorted(_HOME_OF)


def __getattr__(name: str):
    if name in _HOME_OF:
        return getattr(import_module(_HOME_OF[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
