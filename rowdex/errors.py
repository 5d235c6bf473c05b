"""Errors that this package raises."""

from __future__ import annotations


class RowdexError(Exception):
    """Base of all; ``details`` holds what a caller may want to inspect."""

    def __init__(self, message: str, details: dict | None = None):
        super().__init__(message)
        self.message, self.details = message, dict(details or {})

    def __str__(self) -> str:
        return f"{self.message} ({self.details})" if self.details else self.message


class DatasetNotFoundError(RowdexError):
    def __init__(self, path: object, reason: str = ""):
        super().__init__(f"no dataset at {path!r}" + (f": {reason}" if reason else ""))


class SplitNotFoundError(RowdexError):
    def __init__(self, split: str, available: list[str]):
        super().__init__(f"split {split!r} not found; there are {sorted(available)}")
        self.split, self.available = split, sorted(available)


class IndexOutOfBoundsError(RowdexError, IndexError):
    def __init__(self, index: int, length: int):
        super().__init__(f"index {index} is out of bounds for {length} rows")
        self.index, self.length = index, length


class CorruptParquetError(RowdexError):
    def __init__(self, path: str, reason: str):
        super().__init__(f"cannot read {path!r}: {reason}")


class NetworkRangeError(RowdexError):
    def __init__(self, url: str, reason: str):
        super().__init__(f"range request to {url!r} failed: {reason}")


class RateLimitError(NetworkRangeError):
    """HTTP 429. It is not tried again."""

    def __init__(self, url: str, retry_after: str | None = None):
        super().__init__(url, "rate limited" + (f", retry after {retry_after}" if retry_after else ""))
        self.retry_after = retry_after
