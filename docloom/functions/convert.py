"""Typed conversions of text and VARIANT Columns, by built-in functions only.

They follow one rule set: whole numbers only as integers (2.5 fails), texts of digits without spaces or exponents, booleans as 1
and 0, yes/no/on/off as booleans. What can't be converted gives NULL, or the default.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

WHOLE = r"\A[+-]?[0-9]+\z"
DECIMAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"


def text_to_long(c: Column) -> Column:
    return F.when(c.rlike(WHOLE), c.try_cast("bigint"))


def text_to_unsigned(c: Column) -> Column:
    """Whole numbers from 0 to 2**64 - 1 as decimal(20,0)."""
    n = F.when(c.rlike(r"\A[+]?[0-9]+\z"), c.try_cast("decimal(38,0)"))
    return F.when(n < F.lit(str(2**64)).cast("decimal(20,0)"), n).cast("decimal(20,0)")


def text_to_double(c: Column) -> Column:
    return F.when(c.rlike(DECIMAL) | F.lower(c).rlike(r"\A[+-]?(inf|infinity|nan)\z"), c.try_cast("double"))


def text_to_boolean(c: Column) -> Column:
    low = F.lower(c)
    return F.when(c.isin("1", "t", "T", "TRUE", "true", "True") | low.isin("yes", "on"), F.lit(True)).when(
        c.isin("0", "f", "F", "FALSE", "false", "False") | low.isin("no", "off", ""), F.lit(False)
    )


def double_to_long(c: Column) -> Column:
    return F.when((c == F.floor(c)) & (F.abs(c) < F.lit(9.2e18)), c.cast("bigint"))


def variant_kind(v: Column) -> Column:
    """object, array, string, number, boolean or null; NULL where there is no value."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .otherwise("number")
    )


def variant_to(v: Column, to: str) -> Column:
    """A scalar VARIANT as long, int, unsigned (decimal(20,0)), double, boolean or string."""
    kind = variant_kind(v)
    text, number, flag = (F.try_variant_get(v, "$", t) for t in ("string", "double", "boolean"))
    if to in ("int", "long"):
        exact = F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint")).otherwise(double_to_long(number))
        out = F.when(kind == "string", text_to_long(text)).when(kind == "boolean", flag.cast("bigint")).when(kind == "number", exact)
        return out if to == "long" else out.try_cast("int")
    if to == "unsigned":
        number = F.try_variant_get(v, "$", "decimal(38,18)")
        whole = F.coalesce(F.try_variant_get(v, "$", "decimal(38,0)"), number.cast("decimal(38,0)"))
        exact = F.when((number.isNull() | (number == F.floor(number))) & whole.between(F.lit(0), F.lit(str(2**64 - 1)).cast("decimal(20,0)")), whole.cast("decimal(20,0)"))
        return F.when(kind == "string", text_to_unsigned(text)).when(kind == "boolean", flag.cast("int").cast("decimal(20,0)")).when(kind == "number", exact)
    if to == "double":
        return F.when(kind == "string", text_to_double(text)).when(kind == "boolean", flag.cast("double")).when(kind == "number", number)
    if to == "boolean":
        return F.when(kind == "string", text_to_boolean(text)).when(kind == "boolean", flag).when(kind == "number", number != 0)
    return F.when(kind == "string", text).when(kind == "null", F.lit(None).cast("string")).otherwise(F.to_json(v))


def or_default(c: Column, default: Any = None) -> Column:
    return c if default is None else F.coalesce(c, F.lit(default))
