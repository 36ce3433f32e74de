"""Errors, and the codes that appear in error columns."""

from __future__ import annotations

import re

INVALID_JSON = "INVALID_JSON"
PATH_NOT_FOUND = "PATH_NOT_FOUND"
TYPE_MISMATCH = "TYPE_MISMATCH"
INVALID_PATH = "INVALID_PATH"
SIZE_LIMIT = "SIZE_LIMIT"
DEPTH_LIMIT = "DEPTH_LIMIT"
SECURITY_VIOLATION = "SECURITY_VIOLATION"
UNSUPPORTED = "UNSUPPORTED"
CONCURRENCY_LIMIT = "CONCURRENCY_LIMIT"
CLOSED = "CLOSED"


class JsonError(Exception):
    """An error with a code, the operation and the path it concerns."""

    def __init__(self, code: str, message: str, op: str = "", path: str = "") -> None:
        super().__init__(f"{op + ' ' if op else ''}{code}: {message}" + (f" (at {path!r})" if path else ""))
        self.code, self.message, self.op, self.path = code, message, op, path

    def safe(self) -> str:
        """The message without the path's names: only its shape is left."""
        return f"{self.code}: {self.message}" + (f" (at {redacted(self.path)})" if self.path else "")


class Missing(JsonError):
    """A property that isn't there."""

    def __init__(self, path: str = "") -> None:
        super().__init__(PATH_NOT_FOUND, "no such property", "get", path)


def redacted(path: str) -> str:
    """A path with its names hidden."""
    return re.sub(r"[^.\[\]{}/:,*+\-0-9]+", "*", path)
