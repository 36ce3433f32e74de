"""Python objects as JSON values and back, on the driver: constants for changes, and single documents as objects."""

from __future__ import annotations

import base64
import types
import typing
from collections.abc import Mapping
from dataclasses import fields, is_dataclass
from datetime import UTC, date, datetime
from typing import Any

from docloom.errors import TYPE_MISMATCH, JsonError
from docloom.functions import values


def to_value(x: Any) -> Any:
    """An object as a JSON value. Its own marshal_json (JSON text) or marshal_text counts first. Fields of dataclasses go by
    metadata: json (a name, - for none) and omit_empty. Bytes become base 64, times RFC 3339 in UTC (without a zone they count as UTC)."""
    if callable(own := getattr(x, "marshal_json", None)):
        return values.loads(own())
    if callable(own := getattr(x, "marshal_text", None)):
        return own()
    if is_dataclass(x) and not isinstance(x, type):
        out = {}
        for f in fields(x):
            name, v = f.metadata.get("json", f.name), getattr(x, f.name)
            if name != "-" and (v or not f.metadata.get("omit_empty")):
                out[name] = to_value(v)
        return out
    if isinstance(x, (bytes, bytearray)):
        return base64.b64encode(x).decode()
    if isinstance(x, datetime):
        at = (x if x.tzinfo else x.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None).isoformat()
        return (at.rstrip("0") if "." in at else at) + "Z"
    if isinstance(x, date):
        return x.isoformat()
    if isinstance(x, Mapping):
        return {str(k): to_value(v) for k, v in x.items()}
    return [to_value(v) for v in x] if isinstance(x, (list, tuple)) else x


def _mismatch(v: Any, cls: Any) -> JsonError:
    return JsonError(TYPE_MISMATCH, f"{values.kind(v)} is no {getattr(cls, '__name__', cls)}", "decode")


def from_value(v: Any, cls: Any) -> Any:
    """A JSON value as an object of a type: one with unmarshal_json or unmarshal_text, a dataclass (missing fields take their
    defaults, unknown ones are left alone), list, dict, optional types, times, bytes or scalars. Raises JsonError otherwise."""
    if cls is Any:
        return v
    if callable(own := getattr(cls, "unmarshal_json", None)):
        return own(values.dumps(v))
    if isinstance(v, str) and callable(own := getattr(cls, "unmarshal_text", None)):
        return own(v)
    origin, inner = typing.get_origin(cls), typing.get_args(cls)
    if origin in (typing.Union, types.UnionType):
        if v is None and type(None) in inner:
            return None
        for one in inner:
            try:
                return from_value(v, one)
            except JsonError:
                continue
        raise _mismatch(v, cls)
    if is_dataclass(cls) and isinstance(v, dict):
        hints, found = typing.get_type_hints(cls), {}
        for f in fields(cls):
            name = f.metadata.get("json", f.name)
            if name in v and name != "-":
                found[f.name] = from_value(v[name], hints[f.name])
        try:
            return cls(**found)
        except TypeError as e:
            raise JsonError(TYPE_MISMATCH, str(e), "decode") from e
    if isinstance(v, list) and (origin or cls) is list:
        return [from_value(x, inner[0] if inner else Any) for x in v]
    if isinstance(v, dict) and (origin or cls) is dict:
        return {k: from_value(x, inner[1] if inner else Any) for k, x in v.items()}
    try:
        if isinstance(v, str) and cls in (bytes, datetime, date):
            return base64.b64decode(v, validate=True) if cls is bytes else cls.fromisoformat(v)
    except ValueError as e:
        raise _mismatch(v, cls) from e
    kind = {"number": (int, float), "string": (str,), "boolean": (bool,), "null": (type(None),)}.get(values.kind(v), ())
    if cls in kind and (cls is not int or v == int(v)):
        return v if cls is type(None) else cls(v)
    raise _mismatch(v, cls)
