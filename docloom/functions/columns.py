"""Paths over JSON text Columns.

Two ways lead to a value. `native` turns a path into VARIANT functions, which stay in the JVM; it serves names and indices from 0
where the caller knows that names meet objects only. `exact` runs the interpreter in an Arrow-batched Python function and serves
every path. Each function takes all paths of a document at once, so a document is parsed once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import DEFAULT, Config
from docloom.errors import INVALID_PATH, PATH_NOT_FOUND, JsonError
from docloom.functions import convert, interp, record, values
from docloom.plans.path import native_key, native_path, parse

SPARK_TYPES = {"int": "int", "long": "bigint", "unsigned": "decimal(20,0)", "double": "double", "boolean": "boolean", "string": "string"}
ACCESS = "struct<value: string, exists: boolean, type: string, error: string>"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def variant(doc: Column | str) -> Column:
    """A document's VARIANT, NULL where no JSON value begins it. Parse once and take many paths from it.

    Of equal keys the last counts, as everywhere here; the session is told so. Text after the value is left alone (see json_valid).
    """
    last_key_counts()
    return F.try_parse_json(_column(doc))


def last_key_counts() -> None:
    """Let this session's VARIANT parser take the last of equal keys; without this, such documents are NULL."""
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get("spark.sql.variant.allowDuplicateKeys", "false") != "true":
        session.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def _native_step(name: str, at: str) -> str:
    key = native_key(name)
    if key is None:
        raise JsonError(INVALID_PATH, "names with both kinds of quotes or a backslash have no native form", at, name)
    return "$" + key


def native_get(v: Column | str, path: str) -> Column:
    """A path of names and indices from 0 as VARIANT, by built-in functions: NULL where something is missing."""
    native = native_path(parse(path))
    if native is None:
        raise JsonError(INVALID_PATH, "only names and indices from 0 have a native form", "native_get", path)
    return F.try_variant_get(_column(v), native, "variant")


def native_typed(v: Column | str, path: str, to: str, default: Any = None) -> Column:
    return convert.or_default(convert.variant_to(native_get(v, path), to), default)


def variant_array(v: Column) -> Column:
    """The elements of an array VARIANT; NULL for anything else."""
    return v.try_cast("array<variant>")


def native_slice(v: Column, start: int | None = None, stop: int | None = None, step: int = 1) -> Column:
    """Elements of an array VARIANT by Python's rules for slices."""
    a = variant_array(v)
    n = F.size(a)
    place = lambda x, low: F.greatest(F.least(F.lit(x) if x >= 0 else n + x, n - int(step < 0)), F.lit(low))
    if step > 0:
        first, last = place(start or 0, 0), (n if stop is None else place(stop, 0)) - 1
        some = first <= last
    else:
        first, last = n - 1 if start is None else place(start, -1), (F.lit(-1) if stop is None else place(stop, -1)) + 1
        some = first >= last
    at = F.sequence(first.cast("int"), F.when(some, last).otherwise(first).cast("int"), F.lit(step))
    return F.when(a.isNull(), None).when(some, F.transform(at, lambda i: F.get(a, i))).otherwise(F.array().cast("array<variant>"))


def native_extract(v: Column, name: str) -> Column:
    """What the objects of an array VARIANT have under a name, nulls kept."""
    path = _native_step(name, "native_extract")
    return F.filter(F.transform(variant_array(v), lambda x: F.try_variant_get(x, path, "variant")), lambda x: x.isNotNull())


def _entries(v: Column) -> Column:
    """The entries of an object VARIANT; NULL for anything else."""
    return v.try_cast("map<string,variant>")


def native_put(v: Column | str, path: str, value: Column) -> Column:
    """An object VARIANT with a value at a path of names, by built-in functions. Missing objects on the way are made; NULL where
    something on the way is neither an object nor null."""
    names = [s.key for s in parse(path) if s.kind == "property"]
    if not names or len(names) != len(parse(path)):
        raise JsonError(INVALID_PATH, "only names have a native form", "native_put", path)

    def put(at: Column, rest: list[str]) -> Column:
        own = F.coalesce(_entries(at), F.when(at.isNull() | F.is_variant_null(at), F.expr("cast(map() as map<string,variant>)")))
        new = value.cast("variant") if len(rest) == 1 else put(F.try_variant_get(at, _native_step(rest[0], "native_put"), "variant"), rest[1:])
        return F.to_variant_object(F.map_concat(F.map_filter(own, lambda k, _: k != rest[0]), F.when(new.isNotNull(), F.create_map(F.lit(rest[0]), new))))

    return put(_column(v), names)


def native_remove(v: Column | str, *names: str) -> Column:
    """An object VARIANT without some of its entries; what isn't there doesn't matter."""
    return F.to_variant_object(F.map_filter(_entries(_column(v)), lambda k, _: ~k.isin(*names)))


def native_pick(v: Column | str, *names: str) -> Column:
    """An object VARIANT with some of its entries only."""
    return F.to_variant_object(F.map_filter(_entries(_column(v)), lambda k, _: k.isin(*names)))


def native_merge(a: Column | str, b: Column | str, mode: str = values.UNION) -> Column:
    """Two object VARIANTs merged by their top-level keys, by built-in functions: for documents that hold no nested objects or
    arrays under common keys this is json_merge."""
    x, y = _entries(_column(a)), _entries(_column(b))
    if mode == values.UNION:
        out = F.map_zip_with(x, y, lambda _, p, q: F.coalesce(q, p))
    elif mode == values.INTERSECTION:
        out = F.map_filter(y, lambda k, q: F.map_contains_key(x, k) & ~F.is_variant_null(q))
    else:
        out = F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k))
    return F.to_variant_object(out)


def once(**columns: Column) -> Column:
    """A struct of Columns that is worked out once for a row: filters and fields that use them don't copy their functions, as they
    aren't moved through an explode. A select may have one."""
    return F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


def _texts(f: Callable[[Any], Any], config: Config, kind: str = "string") -> Callable[[Column | str], Column]:
    """A function of the parsed document as a Column; NULL where it raises a JsonError."""

    def run(docs: pd.Series) -> pd.Series:
        out = []
        for d in docs:
            try:
                out.append(None if d is None else f(values.loads(d, config)))
            except JsonError:
                out.append(None)
        return pd.Series(out, dtype=object)

    udf = F.pandas_udf(run, returnType=kind)
    return lambda c: udf(_column(c))


def json_get(doc: Column | str, path: str, config: Config = DEFAULT) -> Column:
    """The value at a path as JSON text. NULL where the document isn't JSON, something is missing or a step fails; a JSON null
    is the text null."""
    segments = parse(path, config)
    return _texts(lambda v: values.dumps(interp.get(v, segments)), config)(doc)


def json_get_all(doc: Column | str, paths: Mapping[str, tuple[str, str]], config: Config = DEFAULT, error: str | None = None) -> Column:
    """A struct with a field for each name: paths maps names to (path, type). One parse serves them all; what fails is NULL. With
    error, a last field of that name has the code of the first failure in the order of paths, NULL if there is none."""
    plan = {name: (parse(path, config), to) for name, (path, to) in paths.items()}
    kind = T._parse_datatype_string(", ".join([*(f"`{n}` {SPARK_TYPES[to]}" for n, (_, to) in plan.items()), *([f"`{error}` string"] if error else [])]))

    def run(docs: pd.Series) -> pd.DataFrame:
        out: dict[str, list] = {n: [] for n in plan}
        failed: list[str | None] = []
        for d in docs:
            first = None
            try:
                v, known = values.loads(d, config), True
            except JsonError as e:
                v, known, first = None, False, e.code
            for n, (segments, to) in plan.items():
                try:
                    out[n].append(values.convert(interp.get(v, segments), to) if known else None)
                except JsonError as e:
                    out[n].append(None)
                    first = first or e.code
            failed.append(first)
        types = {"int": "Int32", "long": "Int64", "double": "Float64", "boolean": "boolean", "string": object}
        decimals = {n for n, (_, to) in plan.items() if to == "unsigned"}
        out |= {n: [None if x is None else Decimal(x) for x in out[n]] for n in decimals}
        found = {n: pd.array(x, dtype=types[plan[n][1]]) if plan[n][1] in types and plan[n][1] != "string" else pd.Series(x, dtype=object) for n, x in out.items()}
        return pd.DataFrame(found | ({error: pd.Series(failed, dtype=object)} if error else {}))

    return F.pandas_udf(run, returnType=kind)(_column(doc))


def json_get_typed(doc: Column | str, path: str, to: str, default: Any = None, config: Config = DEFAULT) -> Column:
    """The value at a path as int, long, double, boolean or string; the default where it is missing, null or can't be converted."""
    return convert.or_default(json_get_all(doc, {"v": (path, to)}, config)["v"], default)


def safe_get(doc: Column | str, path: str, config: Config = DEFAULT, strict: bool = False) -> Column:
    """struct<value, exists, type, error>: the value as JSON text, or the code of what went wrong. The empty path doesn't exist."""
    segments = parse(path, config)
    find = interp.get_strict if strict else interp.get

    def run(docs: pd.Series) -> pd.DataFrame:
        rows = []
        for d in docs:
            try:
                v = values.loads(d, config)
                if not path:
                    raise JsonError(PATH_NOT_FOUND, "empty path", "get")
                got = find(v, segments)
                rows.append((values.dumps(got), True, values.kind(got), None))
            except JsonError as e:
                rows.append((None, False, None, e.code))
        return pd.DataFrame(rows, columns=["value", "exists", "type", "error"], dtype=object)

    return F.pandas_udf(run, returnType=ACCESS)(_column(doc))


def json_set(doc: Column | str, path: str, value: Column | str | int | float | bool | None, config: Config = DEFAULT, raw: bool = False) -> Column:
    """The document with a value at a path. Columns of text are taken as texts, or as JSON with raw. Where it fails the original
    text comes back, as do NULL and what isn't JSON."""
    segments = parse(path, config)

    def changed(d: str | None, new: Any) -> str | None:
        try:
            return values.dumps(interp.set_value(values.loads(d, config), segments, new, config, owned=True), config.encode)
        except JsonError:
            return d

    if not isinstance(value, Column):
        try:
            given = values.loads(value) if raw and value is not None else record.to_value(value)
        except JsonError:
            return _column(doc)

        def run_one(docs: pd.Series) -> pd.Series:
            return pd.Series([changed(d, interp.copied(given)) for d in docs], dtype=object)

        return F.pandas_udf(run_one, returnType="string")(_column(doc))

    def run(docs: pd.Series, news: pd.Series) -> pd.Series:
        out = []
        for d, n in zip(docs, news, strict=True):
            try:
                given = (values.loads(n) if n is not None else None) if raw else values.loads(n).get("v")
            except JsonError:
                out.append(d)
                continue
            out.append(changed(d, given))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, returnType="string")(_column(doc), value.cast("string") if raw else F.to_json(F.struct(value.alias("v"))))


def json_set_many(doc: Column | str, changes: Mapping[str, Any], config: Config = DEFAULT) -> Column:
    """The document with constants at several paths, set in the paths' order, all or (with continue_on_error) those that can be."""
    plan = [(parse(p, config), record.to_value(v)) for p, v in sorted(changes.items())]

    def run(docs: pd.Series) -> pd.Series:
        out = []
        for d in docs:
            try:
                out.append(values.dumps(interp.set_many(values.loads(d, config), plan, config), config.encode))
            except JsonError:
                out.append(d)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, returnType="string")(_column(doc))


def json_apply(doc: Column | str, changes: Sequence[tuple], config: Config = DEFAULT) -> Column:
    """Several changes in one parse, one after the other: ("set", path, value) and ("delete", path). The original text where one
    of them fails; with continue_on_error those that fail are left out."""
    plan = [(c[0], parse(c[1], config), record.to_value(c[2]) if len(c) > 2 else None) for c in changes]

    def run(docs: pd.Series) -> pd.Series:
        out = []
        for d in docs:
            try:
                v = values.loads(d, config)
                for op, segments, new in plan:
                    try:
                        owned = not config.continue_on_error
                        v = interp.set_value(v, segments, interp.copied(new), config, owned) if op == "set" else interp.delete(v, segments, config, owned)
                    except JsonError:
                        if not config.continue_on_error:
                            raise
                out.append(values.dumps(v, config.encode))
            except JsonError:
                out.append(d)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, returnType="string")(_column(doc))


def json_delete(doc: Column | str, path: str, config: Config = DEFAULT) -> Column:
    """The document without what is at a path; the original text where that isn't there. The configuration may ask to clean up
    nulls and compact arrays of the whole document after it."""
    segments = parse(path, config)

    def run(docs: pd.Series) -> pd.Series:
        out = []
        for d in docs:
            try:
                v = interp.delete(values.loads(d, config), segments, config, owned=True)
                out.append(values.dumps(values.clean(v, config.compact_arrays) if config.cleanup_nulls else v, config.encode))
            except JsonError:
                out.append(d)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, returnType="string")(_column(doc))


def json_delete_clean(doc: Column | str, path: str, config: Config = DEFAULT) -> Column:
    return json_delete(doc, path, config.but(cleanup_nulls=True, compact_arrays=True))


def json_valid(doc: Column | str, config: Config = DEFAULT) -> Column:
    """Whether a text is one JSON value and nothing else, within the limits of size and depth; by built-in functions. NULL isn't.

    The parser stops after a value. So it is given the document and a hash of it as the two elements of an array: only if
    the document is a whole value are there two elements and the hash the last of them.
    """
    c, h = _column(doc), F.xxhash64(_column(doc))
    last_key_counts()
    pair = F.try_parse_json(F.concat(F.lit("["), c, F.lit(","), h.cast("string"), F.lit("]"))).try_cast("array<variant>")
    whole = (F.size(pair) == 2) & F.try_variant_get(F.get(pair, F.lit(1)), "$", "bigint").eqNullSafe(h)
    deep = F.when(F.char_length(F.regexp_replace(c, r"[^\[{]", "")) > config.max_depth, native_nesting(c) > config.max_depth).otherwise(F.lit(False))
    return F.when(c.isNull() | (F.char_length(c) > config.max_json_size), F.lit(False)).otherwise(F.coalesce(whole, F.lit(False)) & ~deep)


def native_nesting(text: Column | str) -> Column:
    """The deepest level of brackets outside of strings, by built-in functions. Possessive quantifiers keep long strings off the stack."""
    bare = F.regexp_extract_all(F.regexp_replace(_column(text), r'"(?:[^"\\]++|\\.)*+"?', ""), F.lit(r"([\[\]{}])"), 1)
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        level = acc["level"] + F.when(x.isin("[", "{"), 1).otherwise(-1)
        return F.struct(level.alias("level"), F.greatest(acc["most"], level).alias("most"))

    return F.aggregate(bare, start, step, lambda acc: acc["most"])


def json_exists(doc: Column | str, path: str, config: Config = DEFAULT) -> Column:
    return safe_get(doc, path, config)["exists"]


def json_is_null(doc: Column | str, path: str, config: Config = DEFAULT) -> Column:
    """Null or missing."""
    got = json_get(doc, path, config)
    return got.isNull() | (got == "null")


def json_is_empty(doc: Column | str, path: str, config: Config = DEFAULT) -> Column:
    """Missing, null, an empty text, zero, false or an empty container."""
    got = json_get(doc, path, config)
    return got.isNull() | got.isin("null", '""', "0", "false", "[]", "{}")


def json_encode(doc: Column | str, config: Config = DEFAULT) -> Column:
    return _texts(lambda v: values.dumps(v, config.encode), config)(doc)


def json_compact(doc: Column | str) -> Column:
    return _texts(values.dumps, DEFAULT)(doc)


def json_pretty(doc: Column | str, indent: str = "  ", prefix: str = "") -> Column:
    from docloom.config import EncodeConfig

    return json_encode(doc, DEFAULT.but(encode=EncodeConfig(pretty=True, indent=indent, prefix=prefix)))


def json_fields(doc: Column | str, names: Sequence[str]) -> Column:
    """An object with some of its fields; missing ones are left out, and what isn't an object is NULL."""

    def pick(v: Any) -> str | None:
        return values.dumps({k: v[k] for k in names if k in v}) if isinstance(v, dict) else None

    return _texts(pick, DEFAULT)(doc)


def html_escape(text: Column | str) -> Column:
    """<, >, & and the two line separators as \\u escapes, by built-in functions."""
    c = _column(text)
    for char, code in (("<", "003c"), (">", "003e"), ("&", "0026"), ("\u2028", "2028"), ("\u2029", "2029")):
        c = F.replace(c, F.lit(char), F.lit("\\u" + code))
    return c


def json_merge(a: Column | str, b: Column | str, mode: str = values.UNION) -> Column:
    """Two objects merged (union, intersection, difference); NULL where one of them isn't an object."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([interp.attempt(lambda x=x, y=y: values.dumps(values.merge(values.loads(x), values.loads(y), mode)))[0] for x, y in zip(left, right, strict=True)], dtype=object)

    return F.pandas_udf(run, returnType="string")(_column(a), _column(b))


def json_equal(a: Column | str, b: Column | str) -> Column:
    """Whether two documents are equal as values; NULL where one isn't JSON."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([interp.attempt(lambda x=x, y=y: values.equal(values.loads(x), values.loads(y)))[0] for x, y in zip(left, right, strict=True)], dtype=object)

    return F.pandas_udf(run, returnType="boolean")(_column(a), _column(b))


def json_depth(doc: Column | str) -> Column:
    return _texts(values.depth, DEFAULT.but(max_depth=10**6), "int")(doc)


def json_clean(doc: Column | str, compact: bool = True) -> Column:
    return _texts(lambda v: values.dumps(values.clean(v, compact)), DEFAULT)(doc)


def json_to_array(doc: Column | str) -> Column:
    """An object whose keys are whole numbers as an array; other documents as they are."""
    return _texts(lambda v: values.dumps(v if (a := values.to_array(v)) is None else a), DEFAULT)(doc)
