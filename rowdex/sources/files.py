"""Open Parquet files: the last few of each thread, local ones mapped to memory,
remote ones read by ranges."""

from __future__ import annotations

import os
import threading
from collections import OrderedDict
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.parquet as pq

from rowdex.errors import RateLimitError
from rowdex.sources.transport import RangeFile, is_remote

#: Files that a thread keeps open.
MOST_OPEN = 16


class Handles(threading.local):
    """Open files by name, time and size, so a file that was replaced is opened
    again. A thread has its own, and so has a process that was forked."""

    def __init__(self, most: int = MOST_OPEN):
        self.most, self.pid, self.held = most, os.getpid(), OrderedDict()

    def open(self, path: str, token: str | None = None, size: int | None = None) -> pq.ParquetFile:
        if self.pid != os.getpid():
            self.pid, self.held = os.getpid(), OrderedDict()
        remote = is_remote(path)
        key = (path, token) if remote else (path, (s := os.stat(path)).st_mtime_ns, s.st_size)
        if key not in self.held:
            # pre_buffer: the chunks of the wanted columns come as a few long ranges
            self.held[key] = pq.ParquetFile(RangeFile(path, token, size), pre_buffer=True) if remote else pq.ParquetFile(path, memory_map=True)
        self.held.move_to_end(key)
        while len(self.held) > self.most:
            self.held.popitem(last=False)[1].close(force=True)
        return self.held[key]

    def forget(self, path: str | None = None) -> None:
        """Closes the files of one name, or all."""
        for key in [k for k in self.held if path is None or k[0] == path]:
            self.held.pop(key).close(force=True)


HANDLES = Handles()


def read_group(path: str, group: int, columns: Sequence[str] | None = None, token: str | None = None) -> pa.Table:
    """One row group; what it needs of a remote file comes by range requests. A
    handle that fails is opened once more."""
    names = None if columns is None else list(columns)
    for last in (False, True):
        try:
            table = HANDLES.open(path, token).read_row_group(group, columns=names)
            return table if names is None else table.select(names)
        except RateLimitError:
            raise
        except (OSError, pa.ArrowInvalid, ValueError):
            HANDLES.forget(path)
            if last:
                raise
    raise AssertionError("unreachable")
