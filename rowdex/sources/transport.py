"""Remote files: range requests, footers and downloads over HTTP, with retry.

Functions here run on executors as well as on the driver and keep no state.
429 is answered at once; other failures of a server are tried again.
"""

from __future__ import annotations

import hashlib
import io
import os
import threading
import time
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow.parquet as pq

from rowdex.errors import CorruptParquetError, NetworkRangeError, RateLimitError

#: Statuses that are tried again, the first range for a footer, and Parquet's mark.
RETRIED = (500, 502, 503, 504)
FOOTER_GUESS, MAGIC = 64 * 1024, b"PAR1"
#: Bytes that a short read of a remote file asks for at once, and how many such blocks are kept.
BLOCK, KEPT_BLOCKS = 64 * 1024, 32


def is_remote(path: str) -> bool:
    return path.startswith(("http://", "https://"))


def with_retry(call: Callable, attempts: int = 5, pause: float = 0.5, most: float = 8.0, sleep: Callable[[float], None] = time.sleep):
    """Calls until it succeeds, doubling the pause; errors that say no at once pass through."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except RateLimitError:
            raise
        except (OSError, NetworkRangeError) as e:
            if attempt == attempts or isinstance(e, urllib.error.HTTPError) and e.code not in RETRIED:
                raise
            sleep(min(most, pause * 2 ** (attempt - 1)))


def request(url: str, token: str | None = None, start: int | None = None, end: int | None = None, method: str = "GET", timeout: float = 20.0):
    """One request for bytes [start, end), or the last -start bytes if start is negative."""
    asked = urllib.request.Request(url, method=method)
    if token:
        asked.add_header("Authorization", f"Bearer {token}")
    if start is not None:
        asked.add_header("Range", f"bytes={start}" if start < 0 else f"bytes={start}-{end - 1}")
    try:
        return urllib.request.urlopen(asked, timeout=timeout)
    except urllib.error.HTTPError as e:
        if e.code == 429:
            raise RateLimitError(url, e.headers.get("Retry-After")) from e
        raise


def footer(path: str, tail: Callable[[int], tuple[bytes, int]]) -> tuple[int, pq.FileMetaData]:
    """Size and footer of a file of which ``tail`` gives the last bytes, and the size."""
    body, size = tail(FOOTER_GUESS)
    if body[-4:] != MAGIC:
        raise NetworkRangeError(path, "the file does not end as Parquet does")
    need = int.from_bytes(body[-8:-4], "little") + 8
    if need > len(body):
        body, _ = tail(need)
    return size, pq.read_metadata(io.BytesIO(MAGIC + body))


def remote_footer(url: str, token: str | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[int, pq.FileMetaData]:
    """Size and footer of a remote file by one suffix range, or two for a long footer."""

    def tail(count: int) -> tuple[bytes, int]:
        with request(url, token, -count) as got:
            body = got.read()
            total = got.headers.get("Content-Range", "").rpartition("/")[2]
            return body, int(total) if total.isdigit() else len(body)

    return footer(url, lambda count: with_retry(lambda: tail(count), sleep=sleep))


class RangeFile(io.RawIOBase):
    """A remote file that is read by range requests, tried again where that may
    help. A long read asks for its bytes alone; short ones go through blocks, the
    last few of which are kept. ``fetched`` counts the bytes that came."""

    def __init__(self, url: str, token: str | None = None, size: int | None = None, sleep: Callable[[float], None] = time.sleep):
        super().__init__()
        self.url, self.token, self.sleep, self.fetched = url, token, sleep, 0
        self._at, self._blocks = 0, OrderedDict()
        if size is None:
            self._tail()
        else:
            self._size = size

    def _tail(self) -> None:
        """The last block, which holds the footer, and the size, by one request."""

        def call() -> None:
            with request(self.url, self.token, -FOOTER_GUESS) as got:
                body = got.read()
                total = got.headers.get("Content-Range", "").rpartition("/")[2]
                self._size = int(total) if total.isdigit() else len(body)
            self.fetched += len(body)
            self._end = body

        with_retry(call, sleep=self.sleep)

    _end = b""

    def _fetch(self, start: int, end: int) -> bytes:
        if start >= self._size - len(self._end):
            return self._end[start - self._size + len(self._end) :][: end - start]

        def call() -> bytes:
            with request(self.url, self.token, start, end) as got:
                body, whole = got.read(), got.status == 200
            self.fetched += len(body)
            body = body[start:end] if whole else body  # the server knows no ranges
            if len(body) != end - start:
                raise NetworkRangeError(self.url, f"{len(body)} of {end - start} bytes")
            return body

        return with_retry(call, sleep=self.sleep)

    def _block(self, number: int) -> bytes:
        if number not in self._blocks:
            start = number * BLOCK
            self._blocks[number] = self._fetch(start, min(self._size, start + BLOCK))
            while len(self._blocks) > KEPT_BLOCKS:
                self._blocks.popitem(last=False)
        self._blocks.move_to_end(number)
        return self._blocks[number]

    def read(self, count: int = -1) -> bytes:
        end = self._size if count is None or count < 0 else min(self._size, self._at + count)
        start, self._at = self._at, max(self._at, end)
        if start >= end:
            return b""
        if end - start >= BLOCK or start >= self._size - len(self._end):
            return self._fetch(start, end)
        parts = [self._block(k) for k in range(start // BLOCK, (end - 1) // BLOCK + 1)]
        first = start - start // BLOCK * BLOCK
        return b"".join(parts)[first : first + end - start]

    def readinto(self, buffer) -> int:
        got = self.read(len(buffer))
        buffer[: len(got)] = got
        return len(got)

    def seek(self, offset: int, whence: int = os.SEEK_SET) -> int:
        self._at = max(0, offset + {os.SEEK_SET: 0, os.SEEK_CUR: self._at, os.SEEK_END: self._size}[whence])
        return self._at

    def tell(self) -> int:
        return self._at

    def size(self) -> int:
        return self._size

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True


def cache_name(url: str) -> str:
    """File name of a URL in a cache: a hash, so equal base names do not collide."""
    plain = url.split("?")[0]
    return f"{hashlib.sha256(plain.encode()).hexdigest()[:12]}_{os.path.basename(plain) or 'data'}"


def whole_parquet(path: str, size: int | None = None) -> bool:
    try:
        found = os.path.getsize(path)
        if found < 12 or size is not None and found != size:
            return False
        with open(path, "rb") as f:
            head = f.read(4)
            f.seek(-4, os.SEEK_END)
            return head == f.read(4) == MAGIC
    except OSError:
        return False


def download(url: str, target: str, token: str | None = None, attempts: int = 5, chunk: int = 1 << 20, sleep: Callable[[float], None] = time.sleep) -> str:
    """Fetches a whole file; it takes its name only once it is complete."""
    os.makedirs(os.path.dirname(target) or ".", exist_ok=True)

    def length() -> int | None:
        with request(url, token, method="HEAD") as got:
            found = got.headers.get("Content-Length")
            return int(found) if found else None

    size = with_retry(length, attempts, sleep=sleep)
    if whole_parquet(target, size):
        return target
    with locked(f"{target}.lock"):  # processes that want the same file fetch it once
        return target if whole_parquet(target, size) else _download(url, target, size, token, attempts, chunk, sleep)


@contextmanager
def locked(path: str):
    """One process or thread at a time; the lock goes with its holder."""
    import fcntl

    with open(path, "w") as f:
        fcntl.flock(f, fcntl.LOCK_EX)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)
            if os.path.exists(path):
                os.remove(path)


def _download(url: str, target: str, size: int | None, token: str | None, attempts: int, chunk: int, sleep: Callable[[float], None]) -> str:
    part = f"{target}.part.{os.getpid()}_{threading.get_ident()}_{time.monotonic_ns()}"

    def fetch() -> None:
        with request(url, token) as got, open(part, "wb") as out:
            while block := got.read(chunk):
                out.write(block)
        if not whole_parquet(part, size):
            raise CorruptParquetError(url, "incomplete, or not Parquet")

    try:
        with_retry(fetch, attempts, sleep=sleep)
        os.replace(part, target)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return target


def download_all(urls: Iterable[str], folder: str, token: str | None = None, workers: int = 8, done: Callable[[int, int], None] | None = None) -> list[str]:
    """Fetches many files, in parallel; their paths in order. Local paths pass
    through. done: told after each file how many are there, of how many."""
    urls, count, lock = list(urls), [0], threading.Lock()

    def one(url: str) -> str:
        path = download(url, os.path.join(folder, cache_name(url)), token) if is_remote(url) else url
        with lock:
            count[0] += 1
            if done:
                done(count[0], len(urls))
        return path

    with ThreadPoolExecutor(max(1, min(workers, len(urls) or 1))) as pool:
        return list(pool.map(one, urls))
