"""JSON values in Python: reading, writing, comparing, merging, converting."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

from docloom.config import DEFAULT, Config, EncodeConfig
from docloom.errors import DEPTH_LIMIT, INVALID_JSON, SIZE_LIMIT, TYPE_MISMATCH, JsonError

_BIG = 2**53


def _constant(name: str) -> Any:
    raise ValueError(f"{name} isn't JSON")


_decode = json.JSONDecoder(parse_constant=_constant).decode


def loads(text: str | None, config: Config = DEFAULT) -> Any:
    """A document's value: one JSON value and nothing after it; of equal keys the last counts. Integers stay whole numbers in
    Python, and compare and print as the doubles they stand for unless preserve_numbers is set."""
    if text is None:
        raise JsonError(INVALID_JSON, "null document", "parse")
    if len(text) > config.max_json_size:
        raise JsonError(SIZE_LIMIT, f"longer than {config.max_json_size}", "parse")
    try:
        value = _decode(text)
    except RecursionError:
        raise JsonError(DEPTH_LIMIT, "nested too deep", "parse") from None
    except ValueError as e:
        raise JsonError(INVALID_JSON, str(e), "parse") from None
    if "\\u" in text and _ESCAPED_SURROGATE.search(text):
        value = _paired(value)
    if text.count("[") + text.count("{") > config.max_depth and depth(value) > config.max_depth:
        raise JsonError(DEPTH_LIMIT, f"nested deeper than {config.max_depth}", "parse")
    return value


_ESCAPED_SURROGATE = re.compile(r"\\u[dD][89a-fA-F]")
_SURROGATE = re.compile("[\ud800-\udfff]")


def _paired(value: Any) -> Any:
    """A value whose halves of surrogate pairs that stand alone have become U+FFFD, as no text can hold them."""
    if isinstance(value, str):
        return _SURROGATE.sub("\ufffd", value)
    if isinstance(value, list):
        return [_paired(x) for x in value]
    return {_paired(k): _paired(x) for k, x in value.items()} if isinstance(value, dict) else value


def depth(value: Any) -> int:
    """Levels of containers."""
    deepest, level = 0, [value]
    while level := [x for v in level if isinstance(v, (list, dict)) for x in [v]]:
        deepest += 1
        level = [x for v in level for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


def kind(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    return "number" if isinstance(value, (int, float)) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"


_KINDS = {type(None): "null", bool: "boolean", int: "number", float: "number", str: "string", list: "array", dict: "object"}


def number_text(x: float, config: EncodeConfig | None = None) -> str:
    """Whole numbers without point or exponent, others in the shortest digits that read back the same; null for what isn't finite."""
    if isinstance(x, int) and abs(x) > _BIG and (config is None or config.precision < 0):
        return str(x)
    x = float(x)
    if not math.isfinite(x):
        return "null"
    if config is not None and config.precision >= 0:
        p = config.precision
        if config.truncate:
            whole, _, digits = f"{x:.20f}".partition(".")
            return f"{whole}.{digits[:p]}" if p else whole
        return f"{x:.{p}f}"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    text = repr(x)
    if "e" in text:
        mantissa, _, power = text.partition("e")
        digits = mantissa.replace(".", "").replace("-", "")
        point = (len(mantissa.lstrip("-").split(".")[0])) + int(power)
        body = "0." + "0" * -point + digits if point <= 0 else digits[:point].ljust(point, "0") + ("." + digits[point:] if digits[point:] else "")
        return ("-" if x < 0 else "") + body
    return text


#: What the standard encoder writes otherwise: exponents, whole floats, and numbers that aren't JSON.
_OTHER_NUMBER = re.compile(r"\de[-+]?\d|\d\.0(?![0-9])|NaN|Infinity")
_standard = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"), check_circular=False).encode


_string = json.encoder.encode_basestring


def _float_text(v: float) -> str:
    return str(int(v)) if v.is_integer() and -1e21 < v < 1e21 else number_text(v)


def _list_text(v: list) -> str:
    return "[" + ",".join([_PLAIN_TEXT[type(x)](x) for x in v]) + "]"


def _dict_text(v: dict) -> str:
    return "{" + ",".join([f"{_string(k)}:{_PLAIN_TEXT[type(x := v[k])](x)}" for k in sorted(v)]) + "}"


#: Plain text by type: one pass, which neither writes numbers twice nor searches the text for them.
_PLAIN_TEXT = {str: _string, int: int.__repr__, float: _float_text, bool: {True: "true", False: "false"}.__getitem__, type(None): lambda _: "null", list: _list_text, dict: _dict_text}


def dumps(value: Any, config: EncodeConfig | None = None) -> str:
    """Text of a value, keys sorted: equal values have equal texts. config sets everything else."""
    if config is None or config is _PLAIN or config == _PLAIN:
        try:
            return _PLAIN_TEXT[type(value)](value)
        except (KeyError, TypeError, RecursionError):  # other types, keys that aren't texts, very deep values
            text = _standard(value)
            if not _OTHER_NUMBER.search(text):
                return text
    config = config or _PLAIN
    custom = dict(config.escapes)

    def char(c: str) -> str:
        if c in custom:
            return custom[c]
        if c == '"' or c == "\\":
            return "\\" + c
        if c in "\b\f\r":
            return {"\b": "\\b", "\f": "\\f", "\r": "\\r"}[c]
        if c == "\n":
            return "\\n" if config.escape_newlines else c
        if c == "\t":
            return "\\t" if config.escape_tabs else c
        if c == "/":
            return "\\/" if config.escape_slash else c
        if c < " " or (config.escape_html and c in "<>&\u2028\u2029") or (config.escape_unicode and "\x7f" < c <= "\uffff"):
            return f"\\u{ord(c):04x}"
        return c

    plain = not (custom or config.disable_escaping or config.escape_html or config.escape_unicode or config.escape_slash) and config.escape_newlines and config.escape_tabs

    def string(s: str) -> str:
        if plain:
            return json.dumps(s, ensure_ascii=False)
        if config.disable_escaping:
            return '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return '"' + "".join(map(char, s)) + '"'

    def write(v: Any, level: int) -> str:
        if v is None or isinstance(v, bool):
            return "null" if v is None else "true" if v else "false"
        if isinstance(v, (int, float)):
            return number_text(v, config)
        if isinstance(v, str):
            return string(v)
        if isinstance(v, list):
            items, ends = [write(x, level + 1) for x in v], "[]"
        else:
            keys = sorted(v) if config.sort_keys else list(v)
            gap = ": " if config.pretty else ":"
            items, ends = [string(k) + gap + write(v[k], level + 1) for k in keys if config.include_nulls or v[k] is not None], "{}"
        if not config.pretty or not items:
            return ends[0] + ",".join(items) + ends[1]
        inner, outer = "\n" + config.prefix + config.indent * (level + 1), "\n" + config.prefix + config.indent * level
        return ends[0] + inner + ("," + inner).join(items) + outer + ends[1]

    return write(value, 0)


_PLAIN = EncodeConfig()


def identity(value: Any) -> str:
    """A key that two values share if they are equal: 1 is 1.0, order of keys doesn't matter."""
    return dumps(value)


def equal(a: Any, b: Any) -> bool:
    return identity(a) == identity(b)


# ---- conversion

TRUE = {"1", "t", "T", "TRUE", "true", "True"}
FALSE = {"0", "f", "F", "FALSE", "false", "False"}
_WHOLE = re.compile(r"[+-]?\d+\Z", re.A)
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z", re.A)


class Failed(Exception):
    """A conversion that has no result."""


def to_long(v: Any) -> int:
    """Whole numbers, texts of digits, booleans as 1 and 0; within 64 bits."""
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)) and math.isfinite(v) and v == int(v):
        n = int(v)
    elif isinstance(v, str) and _WHOLE.match(v):
        n = int(v)
    else:
        raise Failed
    if not -(2**63) <= n < 2**63:
        raise Failed
    return n


def to_unsigned(v: Any) -> int:
    """Whole numbers from 0 to 2**64 - 1, texts of digits, booleans as 1 and 0."""
    if isinstance(v, (bool, int)) or isinstance(v, float) and math.isfinite(v) and v == int(v):
        n = int(v)
    elif isinstance(v, str) and re.match(r"\+?\d+\Z", v, re.A):
        n = int(v)
    else:
        raise Failed
    if not 0 <= n < 2**64:
        raise Failed
    return n


def to_double(v: Any) -> float:
    if isinstance(v, (bool, int, float)):
        return float(v)
    if isinstance(v, str) and (_FLOAT.match(v) or v.lower().lstrip("+-") in ("inf", "infinity", "nan")):
        return float(v)
    raise Failed


def to_boolean(v: Any) -> bool:
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return v != 0
    if isinstance(v, str):
        if v in TRUE or v.lower() in ("yes", "on"):
            return True
        if v in FALSE or v.lower() in ("no", "off", ""):
            return False
    raise Failed


def to_string(v: Any) -> str:
    return v if isinstance(v, str) else dumps(v)


CONVERT = {"int": to_long, "long": to_long, "unsigned": to_unsigned, "double": to_double, "boolean": to_boolean, "string": to_string}


def convert(v: Any, to: str) -> Any:
    """A value as a scalar; lists of one element count as that element. None for null and for what can't be converted."""
    if isinstance(v, list) and len(v) == 1 and to != "string":
        v = v[0]
    if v is None:
        return None
    try:
        out = CONVERT[to](v)
    except Failed:
        return None
    return out if to != "int" or -(2**31) <= out < 2**31 else None


def to_array(v: Any) -> list | None:
    """An object whose keys are all whole numbers from 0 as a list with nulls in its gaps; None if most of it would be gaps."""
    if not isinstance(v, dict) or not v or not all(_WHOLE.match(k) and k[0] not in "+-" for k in v):
        return None
    at = {int(k): x for k, x in v.items()}
    return None if max(at) > 10 * len(at) else [at.get(i) for i in range(max(at) + 1)]


# ---- merging

UNION, INTERSECTION, DIFFERENCE = "union", "intersection", "difference"
MOST_DEPTH = 100


def _distinct(values: list) -> list:
    seen: dict[str, Any] = {}
    for v in values:
        seen.setdefault(identity(v), v)
    return list(seen.values())


def merge(a: Any, b: Any, mode: str = UNION) -> Any:
    """Two objects as one, key by key: union (b wins, objects merge, lists join without repeats), intersection, difference."""
    if mode not in (UNION, INTERSECTION, DIFFERENCE):
        raise JsonError(TYPE_MISMATCH, f"no merge is called {mode}", "merge")
    if not isinstance(a, dict) or not isinstance(b, dict):
        raise JsonError(TYPE_MISMATCH, "only objects merge", "merge")
    return {UNION: _union, INTERSECTION: _intersection, DIFFERENCE: _difference}[mode](a, b, 0)


def _union(a: Any, b: Any, level: int) -> Any:
    if level > MOST_DEPTH:
        return b
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: (_union(a[k], b[k], level + 1) if k in a and k in b else b[k] if k in b else a[k]) for k in {**a, **b}}
    if isinstance(a, list) and isinstance(b, list):
        return _distinct(a + b)
    return b


def _intersection(a: Any, b: Any, level: int) -> Any:
    if level > MOST_DEPTH:
        return b
    if isinstance(a, dict) and isinstance(b, dict):
        both = {k: _intersection(a[k], b[k], level + 1) for k in a if k in b}
        return {k: v for k, v in both.items() if v is not None}
    if isinstance(a, list) and isinstance(b, list):
        of_b = {identity(x) for x in b}
        return [x for x in _distinct(a) if identity(x) in of_b]
    return b


def _difference(a: dict, b: dict, level: int) -> dict:
    out = {}
    for k, v in a.items():
        if k not in b:
            out[k] = v
        elif isinstance(v, dict) and isinstance(b[k], dict) and level < MOST_DEPTH:
            if rest := _difference(v, b[k], level + 1):
                out[k] = rest
        elif isinstance(v, list) and isinstance(b[k], list):
            of_b = {identity(x) for x in b[k]}
            out[k] = [x for x in _distinct(v) if identity(x) not in of_b]
    return out


# ---- cleaning and walking


def is_empty(v: Any) -> bool:
    """Null, an empty text or an empty container."""
    return v is None or v == "" or v == [] or v == {}


def clean(v: Any, compact: bool = True) -> Any:
    """Without null or empty entries of objects, at any depth; compact takes such elements out of lists, too."""
    if isinstance(v, dict):
        cleaned = {k: clean(x, compact) for k, x in v.items()}
        return {k: x for k, x in cleaned.items() if not is_empty(x)}
    if isinstance(v, list):
        cleaned = [clean(x, compact) for x in v]
        return [x for x in cleaned if not is_empty(x)] if compact else cleaned
    return v


def walk(v: Any, path: str = "", level: int = 1, most: int = 200) -> Iterator[tuple[str, int, str, Any]]:
    """(path, depth, key, value) of every value below v, parents first."""
    if level > most:
        return
    items = sorted(v.items()) if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
    for k, x in items:
        at = f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}" if path else k
        yield at, level, str(k), x
        yield from walk(x, at, level + 1, most)


def walk_into(v: Any, most: int, at: list[str], depths: list[int], keys: list[str], kinds: list[str], texts: list[str | None]) -> None:
    """What walk gives, appended to lists: paths, depths, keys, kinds and texts (None for containers)."""

    def below(v: Any, path: str, level: int) -> None:
        if level > most:
            return
        if isinstance(v, dict):
            start = path + "." if path else ""
            items = [(start + k, k, v[k]) for k in sorted(v)]
        else:
            items = [(f"{path}[{i}]", str(i), x) for i, x in enumerate(v)]
        for p, k, x in items:
            at.append(p)
            depths.append(level)
            keys.append(k)
            t = type(x)
            kinds.append(_KINDS.get(t) or kind(x))
            if t is dict or t is list:
                texts.append(None)
                below(x, p, level + 1)
            else:
                texts.append(dumps(x) if t not in _PLAIN_TEXT else _PLAIN_TEXT[t](x))

    if isinstance(v, (dict, list)):
        below(v, "", 1)


_TOKEN = re.compile(r'\s*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|(-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false)|(null))')


def tokens(text: str) -> Iterator[tuple[int, str, str]]:
    """(offset, kind, text) of JSON tokens, also of several values one after the other."""
    at, end = 0, len(text.rstrip())
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise JsonError(INVALID_JSON, f"no token at {at}", "tokens")
        name = ("delimiter", "string", "number", "boolean", "null")[m.lastindex - 1]
        yield m.start(m.lastindex), name, _paired(json.loads(m[2])) if m.lastindex == 2 else m[m.lastindex]
        at = m.end()


def concatenated(text: str) -> Iterator[tuple[int, Any]]:
    """(offset, value) of JSON values that follow each other."""
    decoder, at = json.JSONDecoder(parse_constant=_constant), 0
    while True:
        while at < len(text) and text[at] in " \t\r\n":
            at += 1
        if at >= len(text):
            return
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError as e:
            raise JsonError(INVALID_JSON, str(e), "decode") from None
        yield at, _paired(value)
        at = end
