"""Merging documents within rows and over rows, and sets of JSON values."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.errors import JsonError
from docloom.functions import values
from docloom.functions.columns import json_merge


def merge_columns(docs: list[Column | str], mode: str = values.UNION) -> Column:
    """Several documents of a row, merged from left to right."""
    if len(docs) < 2:
        raise ValueError("at least two documents merge")
    out = docs[0]
    for d in docs[1:]:
        out = json_merge(out, d, mode)
    return out


def _change(v, level: int = 0) -> tuple:
    """What a document does to the union of those before it, key by key: "s" sets a value whatever was there, "d" merges into an
    object, "l" joins a list. Unlike documents, changes compose associatively, as they tell a replaced value from a merged one."""
    if level <= values.MOST_DEPTH:
        if isinstance(v, dict):
            return "d", {k: _change(x, level + 1) for k, x in v.items()}
        if isinstance(v, list):
            return "l", v
    return "s", v


def _value(change: tuple):
    """The value of a change that nothing comes before."""
    kind, x = change
    return {k: _value(tuple(y)) for k, y in x.items()} if kind == "d" else x


def _composed(a: tuple, b: tuple) -> tuple:
    """The change that is a, then b."""
    (ka, x), (kb, y) = a, b
    if kb == "s":
        return b
    if kb == "l":
        return (ka, values.merge({"_": x}, {"_": y})["_"]) if isinstance(x, list) and ka != "d" else ("s", y)
    if ka == "d":
        return "d", {k: _composed(tuple(x[k]), tuple(y[k])) if k in x and k in y else y[k] if k in y else x[k] for k in {**x, **y}}
    if ka == "s" and isinstance(x, dict):
        return "s", _value(_composed(_change(x), b))
    return "s", _value(b)


def merge_rows(df: DataFrame, by: list[str], order: str, doc: str) -> DataFrame:
    """(by, doc, bad): the union of each group's documents, later rows over earlier ones, and how many weren't JSON objects (null
    documents don't count). Ties in order go by the documents' text; doc is NULL where no document is good.

    Rows are ranged by order within the shuffle partitions and each task composes its share of a group to one change, so a hot
    group is never in one place whole. Changes compose associatively: batches and partitions don't matter.
    """

    def composed(pairs) -> tuple:
        total, bad = None, 0
        for change, n in pairs:
            bad += n
            if change is not None:
                total = change if total is None else _composed(total, change)
        return total, bad

    def read(d: str) -> tuple:
        try:
            v = values.loads(d)
        except JsonError:
            v = None
        return (_change(v), 0) if isinstance(v, dict) else (None, 1)

    def partial(batches):
        for pdf in batches:
            out = []
            for key, g in pdf.groupby(by, sort=False, dropna=False):
                total, bad = composed(map(read, g["_d"]))
                key = key if isinstance(key, tuple) else (key,)
                out.append((*key, g["_o"].iloc[0], g["_d"].iloc[0], None if total is None else values.dumps(list(total)), bad))
            yield pd.DataFrame(out, columns=[*by, "_o", "_d", "_c", "_bad"])

    rows = df.select(*by, F.col(order).alias("_o"), F.col(doc).alias("_d")).where(F.col("_d").isNotNull())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", _c string, _bad long"
    ranged = rows.repartitionByRange(*by, "_o", "_d").sortWithinPartitions(*by, "_o", "_d")
    once = ranged.mapInPandas(partial, schema)  # in order, as ranges don't overlap

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_o", "_d"], kind="stable")
        total, bad = composed((None if c is None else tuple(json.loads(c)), n) for c, n in zip(pdf["_c"], pdf["_bad"], strict=True))
        return pd.DataFrame([(*pdf.iloc[0][by], None if total is None else values.dumps(_value(total)), bad)], columns=[*by, doc, "bad"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)
    return once.groupBy(*by).applyInPandas(finish, f"{out}, `{doc}` string, bad long")


def array_union(a: Column, b: Column) -> Column:
    """Distinct elements of two arrays of canonical JSON texts (or any comparable type), in order of first appearance."""
    return F.array_union(a, b)


def array_intersection(a: Column, b: Column) -> Column:
    return F.array_intersect(a, b)


def array_difference(a: Column, b: Column) -> Column:
    return F.array_except(a, b)
