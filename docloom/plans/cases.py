"""Queries over odd documents: nulls, arrays, repeated keys, texts that aren't JSON, files, streams, and stated cases."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULT, EncodeConfig
from docloom.engine import Engine
from docloom.errors import JsonError
from docloom.functions import columns as C
from docloom.functions import convert
from docloom.functions.encode import Field, encode_batch, encode_record, encode_stream, rfc3339
from docloom.operators import combine, iterate, security, validate
from docloom.operators.validate import Schema
from docloom.plans import path as P
from docloom.plans.catalogue import query, table
from docloom.sources import jsonl
from docloom.streaming import jsonl as streams

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_M = "event_id % 7"


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, m, doc): seven kinds of documents by event_id, each with a number of the event."""
    k = F.get_json_object("props", "$.k")
    kinds = [
        F.concat(F.lit('{"t":"x<y>","k":'), k, F.lit("}")),
        F.concat(F.lit('{"k":null,"a":[1,2,'), k, F.lit("]}")),
        F.concat(F.lit('{"a":{"b":'), k, F.lit("}}")),
        F.concat(F.lit('{"k":1,"k":'), k, F.lit("}")),
        F.concat(F.lit("["), k, F.lit(",2]")),
        F.concat(F.lit('{"k":'), k, F.lit("} x")),
    ]
    m = F.pmod("event_id", F.lit(7))
    doc = F.lit(None).cast("string")
    for i, d in enumerate(kinds):
        doc = F.when(m == i, d).otherwise(doc)
    return table(spark, sf_dir, "events").select("event_id", m.alias("m"), doc.alias("doc"))


@query(
    "json_varied_get",
    f"""SELECT event_id, CASE WHEN {_M} IN (0, 3) THEN {_K} END AS k, {_M} < 5 AS valid, {_M} IN (0, 1, 3, 4) AS has_k, {_M} NOT IN (0, 3) AS k_null,
    {_M} NOT IN (0, 3) OR {_K} = 0 AS k_empty, CASE WHEN {_M} IN (0, 1, 2, 3) THEN 'object' WHEN {_M} = 4 THEN 'array' END AS kind,
    CASE WHEN {_M} IN (0, 3) THEN {_K} END AS native_k, CASE WHEN {_M} = 2 THEN {_K} END AS deep, CASE WHEN {_M} = 1 THEN {_K} END AS last,
    CASE WHEN {_M} >= 5 THEN 'INVALID_JSON' WHEN {_M} = 4 THEN 'NOT_AN_OBJECT' END AS error FROM events""",
)
def json_varied_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of all kinds; of repeated keys the last counts in both tiers; a name over
    an array without objects gives null, so it exists."""
    d = jsonl.with_values(varied(spark, sf_dir).withColumnRenamed("doc", "value"), objects_only=True)
    v = C.variant("value")
    valid = F.col("valid")
    got = C.json_get_all("value", {"k": ("k", "long"), "deep": ("a.b", "long"), "last": ("a[-1]", "long")})
    d = d.select("event_id", "m", "value", C.json_valid("value").alias("valid"), got.alias("g"), "error", v.alias("whole"))
    return d.select(
        "event_id", "g.k", "valid", C.json_exists("value", "k").alias("has_k"), C.json_is_null("value", "k").alias("k_null"), C.json_is_empty("value", "k").alias("k_empty"),
        F.when(valid, convert.variant_kind(F.col("whole"))).alias("kind"), F.when(valid, C.native_typed("whole", "k", "long")).alias("native_k"),
        F.when(F.col("m") == 2, F.col("g.deep")).alias("deep"), F.when(F.col("m") == 1, F.col("g.last")).alias("last"), "error",
    )


_KINDS = {0: '{"k":%s,"t":"x<y>"}', 1: '{"a":[1,2,%s],"k":null}', 2: '{"a":{"b":%s}}', 3: '{"k":%s}', 4: "[%s,2]", 5: '{"k":%s} x'}


def _text(kinds: dict[int, str]) -> str:
    """SQL for the text of each kind, with the number in it."""
    whens = " ".join(f"WHEN {_M} = {m} THEN replace('{t}', '%s', CAST({_K} AS VARCHAR))" for m, t in kinds.items())
    return f"CASE {whens} END"


@query(
    "json_varied_change",
    "SELECT event_id, "
    + _text({0: '{"k":5,"t":"x<y>"}', 1: '{"a":[1,2,%s],"k":5}', 2: '{"a":{"b":%s},"k":5}', 3: '{"k":5}', 4: "[%s,2]", 5: '{"k":%s} x'})
    + " AS put, "
    + _text({0: '{"t":"x<y>"}', 1: '{"a":[1,2,%s]}', 2: '{"a":{"b":%s}}', 3: "{}", 4: "[%s,2]", 5: '{"k":%s} x'})
    + " AS cut, "
    + _text({k: v for k, v in _KINDS.items() if k < 5} | {0: '{"k":%s,"t":"x\\u003cy\\u003e"}'})
    + " AS html, "
    + _text({0: '{"k":%s,"t":"x<y>"}', 1: '{"a":[1,2,%s]}', 2: '{"a":{"b":%s}}', 3: '{"k":%s}', 4: "[%s,2]"})
    + " AS clean FROM events",
)
def json_varied_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can't be changed stays as it is."""
    d = varied(spark, sf_dir)
    changed = C.json_delete("doc", "k")
    original = F.when(changed == F.col("doc"), F.coalesce(C.json_compact("doc"), "doc")).otherwise(changed)
    return d.select(
        "event_id", Engine().set_create("doc", "k", 5).alias("put"), original.alias("cut"),
        F.when(F.col("m") < 5, C.json_encode("doc", DEFAULT.but(encode=EncodeConfig(escape_html=True)))).alias("html"), C.json_clean("doc").alias("clean"),
    )


def _error(f: Callable) -> str:
    try:
        f()
    except JsonError as e:
        return e.code
    return "fine"


def _stated() -> dict[str, Column]:
    """Cases by a name that begins with the inventory's id: what is worked out."""
    doc = F.lit('{"a":{"b":[1,2,3]},"l":[{"x":1},{"x":2},5],"n":null,"s":"7"}')
    put = lambda path, v, **c: C.json_set(doc, path, v, DEFAULT.but(**c))
    got = lambda changed, path: C.json_get(changed, path)
    typed = lambda text, to: C.json_get_typed(F.lit(text), "v", to).cast("string")
    native = lambda text, to: C.native_typed(C.variant(F.lit(text)), "v", to).cast("string")
    encode = lambda text, **e: C.json_encode(F.lit(text), DEFAULT.but(encode=EncodeConfig(**e)))
    bad = lambda text, **s: F.size(validate.json_validate(F.lit(text), Schema(**s))).cast("string")
    said = lambda f: F.lit(_error(f))
    return {
        "B2 a path that is missing": got(doc, "a.c"),
        "B7 strict text": typed('{"v":"x"}', "string"),
        "C6 an element by a predicate": F.to_json(F.filter(C.variant_array(C.native_get(C.variant(doc), "l")), lambda x: F.try_variant_get(x, "$.x", "int") == 2)),
        "D3 several paths": C.json_set_many(F.lit("{}"), {"a": 1, "b.c": "x"}),
        "D4 several paths, failures left out": C.json_set_many(F.lit('{"k":1}'), {"a": 2, "k[+]": 3}, DEFAULT.but(continue_on_error=True)),
        "D6 an index from the end": got(put("a.b[-1]", 9), "a.b"),
        "D8 a slice": got(put("a.b[0:2]", 0), "a.b"),
        "D10 a pointer": got(put("/a/b/1", 8), "a.b"),
        "D12 an index beyond the end": got(put("a.b[5]", 9), "a.b"),
        "D13 no paths made": put("q.r", 1, create_paths=False),
        "D17 half a surrogate pair": got(F.lit('{"v":"a\\ud800b"}'), "v"),
        "E3 an index": got(C.json_delete(doc, "a.b[0]"), "a.b"),
        "E4 a slice": got(C.json_delete(doc, "a.b[0:2]"), "a.b"),
        "E6 a pointer": got(C.json_delete(doc, "/a/b/0"), "a.b"),
        "E7 every element": got(C.json_delete(doc, "a.b[*]"), "a.b"),
        "E9 an index that isn't there": got(C.json_delete(doc, "a.b[7]"), "a.b"),
        "K7 equal numbers": F.to_json(F.array(C.json_equal(F.lit("[1]"), F.lit("[1.0]")), C.json_equal(F.lit('{"a":1,"b":2}'), F.lit('{"b":2,"a":1}')))),
        "K9 objects only": C.json_merge(F.lit('{"a":1}'), F.lit("[1]")),
        "K1 lists join": C.json_merge(F.lit('{"a":[1,2]}'), F.lit('{"a":[2,3]}')),
        "L1 a line feed is no digit": F.to_json(F.array(typed('{"v":"12\\n"}', "long").isNull(), native('{"v":"12\\n"}', "long").isNull())),
        "L1 whole numbers": typed('{"v":2.0}', "long"),
        "L2 unsigned": typed('{"v":"18446744073709551615"}', "unsigned"),
        "L2 unsigned, native": native('{"v":18446744073709551615}', "unsigned"),
        "L2 unsigned, too large or below 0": F.to_json(F.array(typed('{"v":18446744073709551616}', "unsigned").isNull(), native('{"v":-1}', "unsigned").isNull(), typed('{"v":2.5}', "unsigned").isNull())),
        "L3 exponents": typed('{"v":"1e3"}', "double"),
        "L4 words for booleans": typed('{"v":"on"}', "boolean"),
        "L5 texts of values": typed('{"v":[1,{"a":null}]}', "string"),
        "L7 a list of one": typed('{"v":["12"]}', "long"),
        "L9 keys that are numbers": C.json_to_array(F.lit('{"0":"a","2":"c"}')),
        "L15 indented": encode('{"b":[1],"a":{}}', pretty=True, indent="\t", prefix=">"),
        "L17 escapes": encode('{"v":"é/<"}', escape_unicode=True, escape_slash=True, escape_html=True),
        "L17 own escapes": encode('{"v":"x"}', escapes=(("x", "\\u0078"),)),
        "L18 rounded and cut": F.concat(encode("[1.2367]", precision=2), encode("[1.2367]", precision=2, truncate=True)),
        "L19 nulls left out": encode('{"a":null,"b":1}', include_nulls=False),
        "L21 large and small numbers": C.json_compact(F.lit("[1e21,1e-7,100.0,12345678901234567890]")),
        "M2 no finite number": bad("1e999", type="integer"),
        "M3 a required name": bad('{"a":1}', type="object", required=("a", "b")),
        "M5 items": bad('["a",1]', type="array", items=Schema(type="string")),
        "M6 length and pattern": bad('"abcdef"', type="string", max_length=3, pattern="^x"),
        "M7 bounds": bad("10", type="number", maximum=10, exclusive_maximum=True, multiple_of=3),
        "M8 unique items": bad("[1,1.0,2]", type="array", unique_items=True),
        "M11 no other names": bad('{"a":1,"z":2}', type="object", properties={"a": Schema()}, additional_properties=False),
        "M12 formats": F.concat(bad('"2023-02-29"', type="string", format="date"), bad('"1.2.3.4"', type="string", format="ipv4")),
        "N2 scripts": security.is_dangerous(F.lit('{"a":"<script>"}')).cast("string"),
        "N3 within words": F.to_json(F.array(security.is_dangerous(F.lit("my__proto__")), security.is_dangerous(F.lit("my__proto__" + " " * 4096)))),
        "N5 long strings": security.native_nesting(F.concat(F.lit('{"a":["'), F.repeat(F.lit("[x"), 500_000), F.lit('"]}'))).cast("string"),
        "N7 names of secrets": security.is_sensitive(F.lit('{"Api_Key":1}')).cast("string"),
        "N8 bad paths": said(lambda: P.parse("a[2000000]")),
        "N10 a byte order mark": security.json_input_error(F.lit("\ufeff{}")),
        "P1 a quote in a name": F.to_json(F.array(C.native_get(C.variant(F.lit('{"it\'s":5,"its":6}')), "it's"))),
        "P1 a quote in a name of elements": F.to_json(C.native_extract(C.variant(F.lit('[{"it\'s":5,"its":6}]')), "it's")),
        "D5 a quote in a name that is set": F.to_json(C.native_put(C.variant(F.lit("{}")), "it's", F.lit(1))),
        "Q9 codes of errors": C.safe_get(F.lit('{"a":1}'), "a[0]")["error"],
    }


def _quoted(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


#: What the cases must give, as text.
_RESULTS: dict[str, str | None] = {
    "B2 a path that is missing": None,
    "B7 strict text": "x",
    "C6 an element by a predicate": '[{"x":2}]',
    "D3 several paths": '{"a":1,"b":{"c":"x"}}',
    "D4 several paths, failures left out": '{"a":2,"k":1}',
    "D6 an index from the end": "[1,2,9]",
    "D8 a slice": "[0,0,3]",
    "D10 a pointer": "[1,8,3]",
    "D12 an index beyond the end": "[1,2,3,null,null,9]",
    "D13 no paths made": '{"a":{"b":[1,2,3]},"l":[{"x":1},{"x":2},5],"n":null,"s":"7"}',
    "D17 half a surrogate pair": '"a\ufffdb"',
    "E3 an index": "[2,3]",
    "E4 a slice": "[3]",
    "E6 a pointer": "[2,3]",
    "E7 every element": "[]",
    "E9 an index that isn't there": "[1,2,3]",
    "K7 equal numbers": "[true,true]",
    "K9 objects only": None,
    "K1 lists join": '{"a":[1,2,3]}',
    "L1 a line feed is no digit": "[true,true]",
    "L1 whole numbers": "2",
    "L2 unsigned": "18446744073709551615",
    "L2 unsigned, native": "18446744073709551615",
    "L2 unsigned, too large or below 0": "[true,true,true]",
    "L3 exponents": "1000.0",
    "L4 words for booleans": "true",
    "L5 texts of values": '[1,{"a":null}]',
    "L7 a list of one": "12",
    "L9 keys that are numbers": '["a",null,"c"]',
    "L15 indented": '{\n>\t"a": {},\n>\t"b": [\n>\t\t1\n>\t]\n>}',
    "L17 escapes": '{"v":"\\u00e9\\/\\u003c"}',
    "L17 own escapes": '{"v":"\\u0078"}',
    "L18 rounded and cut": "[1.24][1.23]",
    "L19 nulls left out": '{"b":1}',
    "L21 large and small numbers": "[1000000000000000000000,0.0000001,100,12345678901234567890]",
    "M2 no finite number": "1",
    "M3 a required name": "1",
    "M5 items": "1",
    "M6 length and pattern": "2",
    "M7 bounds": "2",
    "M8 unique items": "1",
    "M11 no other names": "1",
    "M12 formats": "10",
    "N2 scripts": "true",
    "N3 within words": "[false,true]",
    "N5 long strings": "2",
    "N7 names of secrets": "true",
    "N8 bad paths": "INVALID_PATH",
    "N10 a byte order mark": "INVALID_JSON",
    "P1 a quote in a name": "[5]",
    "P1 a quote in a name of elements": "[5]",
    "D5 a quote in a name that is set": '{"it\'s":1}',
    "Q9 codes of errors": "TYPE_MISMATCH",
}


@query("json_stated_cases", "SELECT name, CAST(result AS VARCHAR) AS result FROM (VALUES " + ", ".join(f"({_quoted(n)}, {_quoted(r)})" for n, r in _RESULTS.items()) + ") AS t(name, result)")
def json_stated_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a table of uniform documents can't show, each as one row."""
    cases = F.array(*[F.struct(F.lit(n).alias("name"), c.cast("string").alias("result")) for n, c in _stated().items()])
    return spark.range(1).select(F.explode(cases).alias("c")).select("c.*")


@query(
    "json_merge_rows_types",
    """WITH e AS (SELECT user_id, event_id, event_id % 4 AS m FROM events),
    z AS (SELECT user_id, max(CASE WHEN m = 2 THEN event_id END) AS gone, max(CASE WHEN m > 0 THEN event_id END) AS last FROM e GROUP BY user_id)
    SELECT e.user_id, coalesce(max(z.last) = max(z.gone), false) AS k_null, coalesce(bool_or(m = 1 AND (gone IS NULL OR event_id > gone)), false) AS p,
    coalesce(bool_or(m = 3 AND (gone IS NULL OR event_id > gone)), false) AS q, CAST(count(*) AS BIGINT) AS bad FROM e JOIN z USING (user_id) GROUP BY e.user_id""",
)
def json_merge_rows_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: a value that changes its type on the way replaces what was before; texts that aren't JSON are counted."""
    m = F.pmod("event_id", F.lit(4))
    doc = F.when(m == 0, "{}").when(m == 1, '{"k":{"p":1}}').when(m == 2, '{"k":null}').otherwise('{"k":{"q":2}}')
    e = table(spark, sf_dir, "events").select("user_id", "event_id", doc.alias("doc"))
    e = e.unionAll(e.select("user_id", "event_id", F.lit("{bad").alias("doc")))
    r = combine.merge_rows(e, ["user_id"], "event_id", "doc")
    k = F.get_json_object("doc", "$.k")
    return r.select("user_id", F.coalesce(C.json_get("doc", "k") == "null", F.lit(False)).alias("k_null"), F.coalesce(F.get_json_object(k, "$.p").isNotNull(), F.lit(False)).alias("p"), F.coalesce(F.get_json_object(k, "$.q").isNotNull(), F.lit(False)).alias("q"), "bad")


def _folder(spark: SparkSession) -> str:
    """A new folder beside the session's tables, which driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/docloom-{uuid.uuid4().hex}"


@query(
    "jsonl_files",
    f"""SELECT CAST(count(*) AS BIGINT) AS lines, sum(length(props) + 1)::BIGINT AS bytes, CAST(count(*) AS BIGINT) AS good, sum({_K})::BIGINT AS s, CAST(count(*) AS BIGINT) AS typed,
    CAST(count(*) AS BIGINT) AS numbered, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS over FROM events""",
)
def jsonl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of lines and read again, as lines, values, typed rows and whole files."""
    at = _folder(spark)
    docs = table(spark, sf_dir, "events").select("props")
    jsonl.write_jsonl(docs, at, "props")
    read = jsonl.read_jsonl(spark, at, objects_only=True)
    stats = jsonl.jsonl_stats(docs, "props")
    good = jsonl.strict(read).agg(F.count(F.lit(1)).alias("good"), F.sum(C.native_typed("v", "k", "long")).alias("s"))
    typed = jsonl.read_into(spark, at, "k long").agg(F.count("k").alias("typed"))
    numbered = read.groupBy("file").agg(F.max("line_num").alias("n")).agg(F.sum("n").cast("long").alias("numbered"))
    errors = read.agg(F.count("error").alias("errors"))
    over = jsonl.load_file(spark, at).agg(F.count("error").alias("over"))
    one = stats
    for x in (good, typed, numbered, errors, over):
        one = one.join(x)  # single rows
    return one


@query("jsonl_stream", f"SELECT {_K} % 5 AS rest, CAST(count(*) AS BIGINT) AS n, sum({_K})::BIGINT AS s FROM events GROUP BY 1")
def jsonl_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O: the same lines as a stream of files, several micro-batches, into a sink; lines that aren't JSON are left out."""
    at = _folder(spark)
    bad = spark.range(3).select(F.lit("{bad").alias("props"))
    table(spark, sf_dir, "events").select("props").unionAll(bad).write.text(f"{at}/in")
    lines = jsonl.good(streams.read_stream(spark, f"{at}/in", files_per_trigger=4))
    streams.write_stream(lines, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    k = C.native_typed(C.variant("value"), "k", "long")
    out = jsonl.read_lines(spark, f"{at}/out").select(k.alias("k"))
    return out.groupBy((F.col("k") % 5).alias("rest")).agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("s"))


@query("json_engine", f"SELECT event_id, {_K} AS k, {_K} + 0 AS same, 'k' AS first_key FROM events")
def json_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine with a hook and a validator, and a function over batches."""
    seen: list[str] = []

    class Log:
        def before(self, op: str, path: str) -> None:
            seen.append(op)

        def after(self, op: str, path: str, error: Exception | None, seconds: float) -> None:
            seen.append(f"{op} done")

    e = Engine(DEFAULT.but(validators=(lambda c: c.startswith("{"),)), hooks=[Log()])
    d = table(spark, sf_dir, "events").select("event_id", e.get_typed("props", "k", "long").alias("k"), e.get("props", "k").cast("long").alias("same"), "props")
    assert seen == ["get", "get done"] * 2
    keys = iterate.explode(d, "props")
    return keys.select("event_id", "k", "same", F.col("key").alias("first_key"))



@query(
    "json_encode_columns",
    f"""SELECT event_id, '[' || event_id || ',' || {_K} || ',null]' AS stream,
    '{{"half":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE (event_id % 2)::VARCHAR END || ',"id":' || event_id || ',"type":"' || event_type || '"}}' AS batch,
    '{{"id":"' || event_id || '"' || CASE WHEN {_K} % 3 = 0 THEN '' ELSE ',"rest":' || ({_K} % 3) END || ',"at":"'
    || regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z","type":"' || to_base64(encode(event_type)) || '","props":' || props || '}}' AS record FROM events""",
)
def json_encode_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns as arrays, objects and records; fields left out if empty, quoted, in base 64, times, and JSON as it is."""
    k = F.get_json_object("props", "$.k").cast("long")
    fields = [Field("id", "event_id", quoted=True), Field("rest", k % 3, omit_empty=True), Field("at", rfc3339("ts")), Field("type", F.col("event_type").cast("binary")), Field("props", "props", raw=True)]
    return table(spark, sf_dir, "events").select(
        "event_id", encode_stream(F.array("event_id", k, F.lit(None).cast("long"))).alias("stream"),
        encode_batch({"type": "event_type", "id": "event_id", "half": F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2)}).alias("batch"), encode_record(*fields).alias("record"),
    )


@query(
    "json_walk_below",
    f"""SELECT event_id, 'b' AS at, 1 AS depth, {_K} AS value FROM events WHERE {_M} = 2
    UNION ALL SELECT event_id, '[' || i || ']', 1, CASE i WHEN 2 THEN {_K} ELSE i + 1 END FROM events, range(3) r(i) WHERE {_M} = 1""",
)
def json_walk_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: what is below a name; other documents have no rows."""
    return iterate.walk(varied(spark, sf_dir), "doc", path="a").select("event_id", "at", "depth", F.col("value").cast("long").alias("value"))


@query(
    "json_first_error",
    f"""SELECT event_id, CASE WHEN {_M} IN (0, 3) THEN {_K} END AS k, CASE WHEN {_M} = 2 THEN {_K} END AS deep,
    CASE WHEN {_M} IN (0, 2, 3) THEN 'PATH_NOT_FOUND' WHEN {_M} >= 5 THEN 'INVALID_JSON' END AS error FROM events""",
)
def json_first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several paths and the first error beside them."""
    got = C.json_get_all("doc", {"k": ("k", "long"), "deep": ("a.b", "long")}, error="error")
    return varied(spark, sf_dir).select("event_id", got.alias("g")).select("event_id", "g.k", "g.deep", "g.error")


@query("json_kept", f"SELECT event_id, {_K} AS k, {_K} AS again FROM events")
def json_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path parser of one's own, a frame that is kept and found again, an action in a slot, figures."""
    e = Engine(DEFAULT.but(path_parser=lambda p: P.parse(p.lower()), most_running=1))
    read = lambda: table(spark, sf_dir, "events").select("event_id", "props")
    kept = e.parsed(read(), "props")
    out = e.run(lambda: kept.select("event_id", e.get_typed("props", "K", "long").alias("k"), C.native_typed("v", "k", "long").alias("again")))
    assert e.parsed(read(), "props") is kept and e.metrics()["kept"]["hits"] == 1 and e.metrics()["get"]["runs"] == 1
    assert e.close()
    return out
