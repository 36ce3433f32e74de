"""The path language: text to segments, once, on the driver.

    path    := "" | "."                      the whole document
             | "/" pointer                   JSON Pointer
             | seg ("." seg)*
    seg     := name? ("[" index "]" | "{" fields "}")*
    index   := int | "*" | "+" | int? ":" int? (":" int)?
    fields  := name | "flat:" name | name "," name ...
    escapes := a backslash before . \\ [ ] { }
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

from docloom.config import DEFAULT, Config
from docloom.errors import INVALID_PATH, SECURITY_VIOLATION, JsonError

PROPERTY, INDEX, SLICE, WILDCARD, EXTRACT, FIELDS, APPEND = "property", "index", "slice", "wildcard", "extract", "fields", "append"

#: Characters without width that could hide in a path.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff"
#: Percent escapes of dots, slashes and NUL, once or twice encoded, and overlong UTF-8 of a slash.
BYPASS = re.compile(r"%2e|%2f|%5c|%00|%252e|%252f|%c0%af|%c1%9c", re.I)
SIMPLE = re.compile(r"[A-Za-z_]\w{0,63}\Z", re.A)
NUMBER = re.compile(r"-?\d+\Z", re.A)
FIELD = re.compile(r"[A-Za-z0-9_][A-Za-z0-9_-]*\Z")


@dataclass(frozen=True)
class Segment:
    kind: str
    key: str = ""
    index: int = 0
    start: int | None = None
    stop: int | None = None
    step: int = 1
    fields: tuple[str, ...] = ()
    flat: bool = False
    #: Written as a JSON Pointer: Set makes what is missing, whatever the configuration says.
    pointer: bool = False


def _bad(path: str, why: str, code: str = INVALID_PATH) -> JsonError:
    return JsonError(code, why, "path", path)


def validate(path: str, config: Config = DEFAULT) -> None:
    """Refuse paths that are too long or carry what no path needs."""
    if len(path) > config.max_path_length:
        raise _bad(path[:80], f"longer than {config.max_path_length}")
    if SIMPLE.match(path):
        return
    text = path if path.isascii() else unicodedata.normalize("NFC", path)
    for wrong, why in (
        ("\0" in text, "null byte"),
        (any(c in text for c in ZERO_WIDTH), "zero-width character"),
        (".." in text, "path traversal"),
        (BYPASS.search(text), "encoded path traversal"),
        (":::" in text or "[[[" in text or "}}}" in text, "too many special characters"),
    ):
        if wrong:
            raise _bad(path, why, SECURITY_VIOLATION)


def escape_pointer(name: str) -> str:
    return name.replace("~", "~0").replace("/", "~1")


def unescape_pointer(name: str) -> str:
    return name.replace("~1", "/").replace("~0", "~")


def is_pointer(path: str) -> bool:
    return path.startswith("/")


def is_dotted(path: str) -> bool:
    return "." in path and not is_pointer(path)


def is_complex(path: str) -> bool:
    return any(c in path for c in ".[]{}:/")


def is_extraction(path: str) -> bool:
    return "{" in path


def is_property_name(name: str) -> bool:
    return bool(name) and not any(c in name for c in ".[]{}()")


def is_array_index(text: str) -> bool:
    return bool(NUMBER.match(text))


def is_slice(text: str) -> bool:
    try:
        return _bracket(text, text, DEFAULT).kind == SLICE
    except JsonError:
        return False


def _int(text: str, path: str, config: Config) -> int:
    if not NUMBER.match(text):
        raise _bad(path, f"{text!r} is no index")
    if abs(n := int(text)) > config.max_index:
        raise _bad(path, f"index beyond {config.max_index}")
    return n


def _bracket(text: str, path: str, config: Config) -> Segment:
    if text == "*":
        return Segment(WILDCARD)
    if text == "+":
        return Segment(APPEND)
    if ":" not in text:
        return Segment(INDEX, index=_int(text, path, config))
    parts = text.split(":")
    if len(parts) > 3:
        raise _bad(path, f"{text!r} is no slice")
    start, stop, step = [_int(p, path, config) if p else None for p in (*parts, "", "")[:3]]
    if step == 0:
        raise _bad(path, "a slice's step can't be 0")
    return Segment(SLICE, start=start, stop=stop, step=step or 1)


def _braces(text: str, path: str) -> Segment:
    flat = text.startswith("flat:")
    names = [n.strip() for n in text.removeprefix("flat:").split(",")]
    if not all(names):
        raise _bad(path, "empty field in braces")
    if len(names) == 1:
        return Segment(EXTRACT, key=names[0], flat=flat)
    if not all(FIELD.match(n) for n in names):
        raise _bad(path, "a name that several fields can't have")
    return Segment(FIELDS, fields=tuple(names))


@lru_cache(4096)
def parse(path: str, config: Config = DEFAULT) -> tuple[Segment, ...]:
    """Segments of a path; the whole document has none."""
    validate(path, config)
    if config.path_parser is not None:
        return tuple(config.path_parser(path))
    if path in ("", ".", "/"):
        return ()
    if is_pointer(path):
        names = [unescape_pointer(n) for n in path[1:].split("/")]
        out = [Segment(INDEX, index=_int(n, path, config), key=n, pointer=True) if NUMBER.match(n) else Segment(PROPERTY, key=n, pointer=True) for n in names]
    elif NUMBER.match(path):
        out = [Segment(PROPERTY, key=path)]  # alone, digits are a name
    else:
        out = _dotted(path, config)
    if len(out) > config.max_path_segments:
        raise _bad(path, f"more than {config.max_path_segments} segments")
    return tuple(out)


def _dotted(path: str, config: Config) -> list[Segment]:
    out: list[Segment] = []
    name, escaped, i, n = "", False, 0, len(path)

    def end_name() -> None:
        nonlocal name, escaped
        if name:
            out.append(Segment(INDEX, index=_int(name, path, config), key=name) if NUMBER.match(name) and not escaped else Segment(PROPERTY, key=name))
        name, escaped = "", False

    while i < n:
        c = path[i]
        if c == "\\" and i + 1 < n and path[i + 1] in ".\\[]{}":
            name, escaped, i = name + path[i + 1], True, i + 2
        elif c == ".":
            end_name()
            i += 1
        elif c in "[{":
            end_name()
            close = path.find("]" if c == "[" else "}", i)
            if close < 0:
                raise _bad(path, f"{c} isn't closed")
            inner = path[i + 1 : close]
            out.append(_bracket(inner.strip(), path, config) if c == "[" else _braces(inner, path))
            i = close + 1
        elif c in "]}":
            raise _bad(path, f"{c} without its opening")
        else:
            name, i = name + c, i + 1
    end_name()
    return out


def native_key(name: str) -> str | None:
    """A name as a step of a VARIANT path, in the quotes that it doesn't hold; None if it holds both kinds or a backslash."""
    if "\\" in name or ("'" in name and '"' in name):
        return None
    return f'["{name}"]' if "'" in name else f"['{name}']"


def native_path(segments: tuple[Segment, ...]) -> str | None:
    """The segments as a VARIANT path, if they are names and indices from 0 only; names are always quoted."""
    out = "$"
    for s in segments:
        if s.kind == PROPERTY and (key := native_key(s.key)):
            out += key
        elif s.kind == INDEX and s.index >= 0:
            out += f"[{s.index}]"
        else:
            return None
    return out
