"""Columns of any type as JSON text, by built-in functions: arrays, objects of named Columns, and records with optional fields.

Numbers and keys within values are as Spark writes them; json_encode over the result writes them as the engine does.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPTIONS = {"ignoreNullFields": "false"}
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
#: Texts of values that omit_empty leaves out.
EMPTY = ("null", "false", "0", "0.0", "-0.0", '""', "[]", "{}")


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _value(c: Column) -> Column:
    """A value's JSON text; null for NULL."""
    one = F.to_json(F.struct(c.alias("v")), OPTIONS)  # {"v":...}
    return F.substr(one, F.lit(6), F.char_length(one) - 6)


def _object(entries: list[Column]) -> Column:
    return F.concat(F.lit("{"), F.concat_ws(",", *entries), F.lit("}"))


def encode_stream(values: Column | str) -> Column:
    """An array Column as the text of a JSON array; null for NULL."""
    return F.coalesce(F.to_json(_column(values), OPTIONS), F.lit("null"))


def encode_batch(pairs: Mapping[str, Column | str]) -> Column:
    """Named Columns as the text of one JSON object, keys sorted, NULL as null; without pairs an empty object."""
    return _object([F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), _value(_column(pairs[k]))) for k in sorted(pairs)])


@dataclass(frozen=True)
class Field:
    """A field of a record: left out where it is null, false, 0 or empty (omit_empty), written as text (quoted), or taken as the
    JSON text that it is (raw)."""

    name: str
    column: Column | str
    omit_empty: bool = False
    quoted: bool = False
    raw: bool = False


def encode_record(*fields: Field) -> Column:
    """Fields as the text of one JSON object, in their order. Binary is written in base 64; times as rfc3339 gives them."""

    def entry(f: Field) -> Column:
        c = _column(f.column)
        text = F.coalesce(c, F.lit("null")) if f.raw else _value(c)
        shown = F.when(c.isNull(), text).otherwise(F.concat(F.lit('"'), text, F.lit('"'))) if f.quoted else text
        out = F.concat(F.lit(json.dumps(f.name, ensure_ascii=False) + ":"), shown)
        return F.when(~text.isin(*EMPTY), out) if f.omit_empty else out

    return _object([entry(f) for f in fields])


def rfc3339(time: Column | str) -> Column:
    """A time as text of RFC 3339 in UTC, without zeros at the end of its fraction; times without a zone count as UTC. NULL for NULL."""
    c = _column(time)
    text = F.to_json(F.struct(c.alias("t")), {"timeZone": "UTC", "timestampFormat": _TIME, "timestampNTZFormat": _TIME})
    return F.concat(F.regexp_replace(F.get_json_object(text, "$.t"), r"\.?0+\z", ""), F.lit("Z"))
