"""Settings of the engine, as one immutable value."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any, ClassVar


@dataclass(frozen=True)
class EncodeConfig:
    """How values become text. precision rounds floats (or cuts them, with truncate); escapes maps characters to their text."""

    pretty: bool = False
    indent: str = "  "
    prefix: str = ""
    sort_keys: bool = True
    include_nulls: bool = True
    escape_html: bool = False
    escape_unicode: bool = False
    escape_slash: bool = False
    escape_newlines: bool = True
    escape_tabs: bool = True
    disable_escaping: bool = False
    escapes: tuple[tuple[str, str], ...] = ()
    precision: int = -1
    truncate: bool = False


@dataclass(frozen=True)
class Config:
    """Limits and switches. Numbers out of range are moved to the nearest bound by `checked`, which says so."""

    max_json_size: int = 100 * 1024 * 1024
    max_depth: int = 200
    max_path_length: int = 5_000
    max_path_segments: int = 100
    max_index: int = 1_000_000
    max_batch: int = 2_000
    max_line: int = 1024 * 1024
    chunk: int = 1_000
    most_running: int = 50
    most_kept: int = 16
    keep_seconds: int = 300
    create_paths: bool = True
    cleanup_nulls: bool = False
    compact_arrays: bool = False
    continue_on_error: bool = False
    skip_empty: bool = True
    skip_comments: bool = False
    skip_validation: bool = False
    preserve_numbers: bool = False
    patterns: tuple[str, ...] = ()
    encode: EncodeConfig = field(default_factory=EncodeConfig)
    hooks: tuple[Any, ...] = ()
    path_parser: Callable[[str], Any] | None = None  # gives a path's segments in place of the parser here
    validators: tuple[Callable, ...] = ()

    _BOUNDS: ClassVar[dict[str, tuple[int, int]]] = {
        "max_json_size": (1, 100 * 1024 * 1024),
        "max_depth": (1, 200),
        "max_path_length": (1, 5_000),
        "max_path_segments": (1, 100),
        "max_index": (1, 1_000_000),
        "max_batch": (1, 10_000),
        "max_line": (1, 100 * 1024 * 1024),
        "chunk": (1, 1_000_000),
        "most_running": (1, 1_000),
        "most_kept": (0, 1_000),
        "keep_seconds": (0, 86_400),
    }

    def checked(self) -> tuple[Config, list[str]]:
        """This configuration within its bounds, and a warning for each number that was moved."""
        moved, said = {}, []
        for name, (low, high) in self._BOUNDS.items():
            value = getattr(self, name)
            if not low <= value <= high:
                moved[name] = min(max(value, low), high)
                said.append(f"{name}: {value} became {moved[name]}")
        return replace(self, **moved), said

    def but(self, **changes: Any) -> Config:
        return replace(self, **changes)


DEFAULT = Config()
#: Small documents, shallow nesting.
SECURE = Config(max_json_size=10 * 1024 * 1024, max_depth=50, max_path_segments=50)
PRETTY = Config(encode=EncodeConfig(pretty=True))
