"""Iteration: rows from the elements of documents, and map, filter, fold and chunks over rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.config import DEFAULT, Config
from docloom.errors import INVALID_PATH, JsonError
from docloom.functions import columns, interp, values
from docloom.plans.path import parse


_ARROW = {"string": pa.string(), "int": pa.int32()}


def _each(df: DataFrame, doc: str, fields: dict[str, str], rows: Callable[[str | None, list[list]], None]) -> DataFrame:
    """df with a row and these fields (name to type) for each of the rows that `rows` appends to the lists of the fields for a text.
    Fields travel as columns, not as objects of rows; texts without rows have none."""

    def run(docs: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in fields]
        ends = [0]
        for d in docs.to_pylist():
            rows(d, columns)
            ends.append(len(columns[0]))
        structs = pa.StructArray.from_arrays([pa.array(c, _ARROW[t]) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)

    each = F.arrow_udf(run, returnType=f"array<struct<{', '.join(f'{n}: {t}' for n, t in fields.items())}>>")
    return df.withColumn("_e", F.explode(each(F.col(doc)))).select(*df.columns, "_e.*")


def explode(df: DataFrame, doc: str, path: str = "", outer: bool = False) -> DataFrame:
    """df with `pos`, `key` and `value` (VARIANT) for each element of the array or entry of the object at a path of names and
    indices. Scalars have no rows (one of nulls with outer). All in the JVM: the document is parsed and exploded as VARIANT."""
    v = columns.variant(doc)
    v = columns.native_get(v, path) if path else v
    kept = F.when(F.schema_of_variant(v).startswith("OBJECT") | F.schema_of_variant(v).startswith("ARRAY"), v)
    source = df.withColumn("_v", kept)
    tvf = df.sparkSession.tvf
    each = (tvf.variant_explode_outer if outer else tvf.variant_explode)(F.col("_v").outer())
    return source.lateralJoin(each).drop("_v")


def explode_path(df: DataFrame, doc: str, path: str, config: Config = DEFAULT) -> DataFrame:
    """As explode, for every path: `pos`, `key`, `at` (the element's path) and `value` (JSON text)."""
    segments = parse(path, config)

    def rows(d: str | None, columns: list[list]) -> None:
        pos, keys, at, texts = columns
        try:
            v = interp.get(values.loads(d, config), segments)
        except JsonError:
            return
        items = sorted(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) else []
        for i, (k, x) in enumerate(items):
            pos.append(i)
            keys.append(str(k))
            at.append(f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}" if path else str(k))
            texts.append(values.dumps(x))

    return _each(df, doc, {"pos": "int", "key": "string", "at": "string", "value": "string"}, rows)


def walk(df: DataFrame, doc: str, config: Config = DEFAULT, path: str = "") -> DataFrame:
    """df with `at`, `depth`, `key`, `type` and `value` (JSON text of scalars, NULL for containers) for every value in the
    document, parents first. Documents that aren't JSON have no rows. With a path of names the walk begins at what is there, whose
    places count from it; documents without it have no rows."""
    segments = parse(path, config)
    if any(s.kind != "property" for s in segments):
        raise JsonError(INVALID_PATH, "a walk begins at a path of names", "walk", path)

    def rows(d: str | None, columns: list[list]) -> None:
        try:
            v = interp.get(values.loads(d, config), segments)
        except JsonError:
            return
        values.walk_into(v, config.max_depth, *columns)

    return _each(df, doc, {"at": "string", "depth": "int", "key": "string", "type": "string", "value": "string"}, rows)


def tokens(df: DataFrame, doc: str) -> DataFrame:
    """df with `offset`, `kind` and `token` for each JSON token, also of several values in one text. Texts with no token at some
    place end before it with a row of kind error."""

    def rows(d: str | None, columns: list[list]) -> None:
        try:
            for row in values.tokens(d or ""):
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
        except JsonError as e:
            for column, x in zip(columns, (len(d), "error", e.code), strict=True):
                column.append(x)

    return _each(df, doc, {"offset": "int", "kind": "string", "token": "string"}, rows)


def decode_all(df: DataFrame, doc: str) -> DataFrame:
    """df with `offset` and `value` (JSON text) for each of the values that follow each other in a text."""

    def rows(d: str | None, columns: list[list]) -> None:
        offsets, texts = columns
        try:
            for at, v in values.concatenated(d or ""):
                text = values.dumps(v)
                offsets.append(at)
                texts.append(text)
        except JsonError:
            pass  # what comes before the fault counts

    return _each(df, doc, {"offset": "int", "value": "string"}, rows)


def take_while(df: DataFrame, keep: Column, order: list[str], by: list[str]) -> DataFrame:
    """Rows before the first that `keep` doesn't hold for, in each group: iteration with an early stop."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    stopped = F.max(F.when(keep, 0).otherwise(1)).over(w)
    return df.withColumn("_stop", stopped).where("_stop = 0").drop("_stop")


def chunks(df: DataFrame, size: int, order: str, value: str, by: list[str] = ()) -> DataFrame:
    """Lists of `size` consecutive values: `chunk` (from 0), `n` and `items`. The order column must number the rows from 1 in each
    group, as line numbers do; so a chunk's number needs no sort over all rows."""
    at = F.floor((F.col(order) - 1) / F.lit(size)).cast("long")
    lists = df.withColumn("chunk", at).groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("_i"))
    return lists.select(*by, "chunk", F.size("_i").alias("n"), F.col("_i." + value).alias("items"))


def first(df: DataFrame, keep: Column, order: str) -> DataFrame:
    """The first row that satisfies a predicate: a row or none."""
    return df.where(keep).orderBy(order).limit(1)


def fold(df: DataFrame, by: list[str], order: str, value: str, initial: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """(by, result): an ordered fold over each group's rows, as built-in functions. Groups are collected, so their size is bounded
    by a worker's memory; what sums and the like can do, they should."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*by).agg(F.aggregate(rows, initial, lambda acc, r: step(acc, r["v"])).alias("result"))


def map_batches(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A function of batches of rows, run in parallel; the order of rows in a partition is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return (f(b) for b in batches)

    return df.mapInPandas(run, schema)
