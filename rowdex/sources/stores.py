"""Folders of Parquet files, and files of stores that only Spark reaches: these
are listed, and their footers read, through Hadoop's file systems on the driver."""

from __future__ import annotations

import os
import re

import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from rowdex.sources.transport import footer, is_remote


def in_store(path: str) -> bool:
    """Whether neither this process nor HTTP reaches a path."""
    return "://" in path and not is_remote(path)


def _hadoop(spark: SparkSession, path: str):
    held = spark._jvm.org.apache.hadoop.fs.Path(path)
    return held, held.getFileSystem(spark._jsc.hadoopConfiguration())


def _hidden(name: str) -> bool:
    """As Spark's readers have it."""
    return name.startswith(("_", "."))


def data_files(path: str, spark: SparkSession | None = None) -> list[str]:
    """A file itself; of a folder the files below it, by name, but for hidden ones."""
    path = re.sub("^file:/+", "/", path)
    if in_store(path) and spark is not None:
        place, store = _hadoop(spark, path)
        if not store.exists(place) or not store.getFileStatus(place).isDirectory():
            return [path]
        root, listing, found = store.makeQualified(place).toString().rstrip("/") + "/", store.listFiles(place, True), []
        while listing.hasNext():
            found.append(listing.next().getPath().toString())
        return sorted(f for f in found if not any(map(_hidden, f.removeprefix(root).split("/"))))
    if "://" in path or not os.path.isdir(path):
        return [path]
    found = []
    for folder, inner, names in os.walk(path):
        inner[:] = [d for d in inner if not _hidden(d)]
        found += [os.path.join(folder, f) for f in names if not _hidden(f)]
    return sorted(found)


def store_footer(spark: SparkSession, path: str) -> tuple[int, pq.FileMetaData]:
    """Size and footer of a file of a store."""
    place, store = _hadoop(spark, path)
    size = store.getFileStatus(place).getLen()

    def tail(count: int) -> tuple[bytes, int]:
        held = store.open(place)
        try:
            held.seek(max(0, size - count))
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(held, min(size, count))), size
        finally:
            held.close()

    return footer(path, tail)
