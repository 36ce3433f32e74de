"""The engine on DataFrames: columns, operators, sources, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from docloom.config import DEFAULT, PRETTY, EncodeConfig
from docloom.engine import Engine, delete_text, get_value, merge_texts, set_text
from docloom.functions import columns as C
from docloom.functions import values
from docloom.operators import combine, iterate, security, validate
from docloom.operators.validate import Schema
from docloom.plans import path as P
from docloom.sources import jsonl
from docloom.streaming import jsonl as streams

DOCS = ['{"a":{"b":1},"l":[1,2,3]}', '{"a":null}', "not json", None, '{"a":{"b":"7"},"l":[]}', "[]"]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id long, doc string")


def one(df, *cols):
    return [tuple(r) for r in df.orderBy("id").select(*cols).collect()]


def test_get_columns(docs):
    got = one(docs, C.json_get("doc", "a.b"), C.json_get_typed("doc", "a.b", "long", -1), C.safe_get("doc", "l[0]")["error"])
    assert got == [("1", 1, None), ("null", -1, "PATH_NOT_FOUND"), (None, -1, "INVALID_JSON"), (None, -1, "INVALID_JSON"), ('"7"', 7, None), ("null", -1, None)]


def test_native_columns_agree_with_the_interpreter(spark):
    rows = [(i, json.dumps({"a": {"b": v}, "l": l})) for i, (v, l) in enumerate([(1, [1, 2, 3, 4]), ("2", []), (2.5, [5]), (True, [1, 2]), (None, list(range(9))), ("yes", [[1]])])]
    df = spark.createDataFrame(rows, "id long, doc string").withColumn("v", C.variant("doc"))
    for to in ("long", "int", "double", "boolean", "string"):
        assert one(df, C.native_typed("v", "a.b", to)) == one(df, C.json_get_typed("doc", "a.b", to))
    for s in ("[1:3]", "[-2:]", "[::2]", "[::-1]", "[5:1:-2]", "[:-1]", "[7:]", "[-100:100]"):
        x = P.parse("l" + s)[1]
        native = F.to_json(C.native_slice(C.native_get("v", "l"), x.start, x.stop, x.step))
        assert [json.loads(r[0]) for r in one(df, native)] == [json.loads(r[0]) for r in one(df, C.json_get("doc", "l" + s))], s


def test_native_changes(spark):
    rows = [(i, d) for i, d in enumerate(['{"a":1,"b":{"c":2}}', "{}", '{"b":null}', '{"b":{"d":[1]}}'])]
    df = spark.createDataFrame(rows, "id long, doc string").withColumn("v", C.variant("doc"))
    for path in ("a", "b.c", "x.y.z"):
        assert [json.loads(r[0]) for r in one(df, F.to_json(C.native_put("v", path, F.lit(7))))] == [json.loads(r[0]) for r in one(df, C.json_set("doc", path, 7))], path
    assert [r[0] for r in one(df, F.to_json(C.native_remove("v", "b")))] == ['{"a":1}', "{}", "{}", "{}"]
    assert [r[0] for r in one(df, F.to_json(C.native_pick("v", "a")))] == ['{"a":1}', "{}", "{}", "{}"]
    other = '{"a":2,"z":3}'
    for mode in (values.UNION, values.INTERSECTION, values.DIFFERENCE):
        native = F.to_json(C.native_merge("v", C.variant(F.lit(other)), mode))
        assert [json.loads(r[0]) for r in one(df, native)] == [json.loads(r[0]) for r in one(df, C.json_merge("doc", F.lit(other), mode))], mode


def test_change_columns(docs):
    got = one(docs, C.json_set("doc", "x.y", "v"), C.json_delete("doc", "a"))
    assert got[0] == ('{"a":{"b":1},"l":[1,2,3],"x":{"y":"v"}}', '{"l":[1,2,3]}')
    assert got[2] == ("not json", "not json") and got[3] == (None, None) and got[5] == ("[]", "[]")
    assert one(docs, C.json_set("doc", "l[+]", F.lit('{"z":1}'), raw=True))[0][0] == '{"a":{"b":1},"l":[1,2,3,{"z":1}]}'
    assert one(docs, C.json_set("doc", "a.b", F.col("id")))[0][0] == '{"a":{"b":0},"l":[1,2,3]}'


def test_changes_in_one_parse(docs):
    changes = [("set", "x", {"y": 1}), ("delete", "a"), ("set", "l[+]", 9)]
    assert one(docs, C.json_apply("doc", changes))[0][0] == '{"l":[1,2,3,9],"x":{"y":1}}'
    assert [r[0] for r in one(docs, C.json_apply("doc", changes))][1:4] == DOCS[1:4]
    assert one(docs, C.json_apply("doc", changes, DEFAULT.but(continue_on_error=True)))[1][0] == '{"x":{"y":1}}'


def test_encoding(docs):
    e = EncodeConfig(escape_html=True, escape_slash=True, escape_unicode=True)
    text = values.dumps({"k": "</a>\u00e9\n"}, e)
    assert text == '{"k":"\\u003c\\/a\\u003e\\u00e9\\n"}' and json.loads(text) == {"k": "</a>\u00e9\n"}
    assert values.dumps({"b": 1, "a": None}, EncodeConfig(include_nulls=False)) == '{"b":1}'
    assert values.dumps({"b": [1, {}]}, PRETTY.encode) == '{\n  "b": [\n    1,\n    {}\n  ]\n}'
    assert values.dumps("x", EncodeConfig(escapes=(("x", "\\u0078"),))) == '"\\u0078"'
    assert one(docs, C.json_to_array(F.lit('{"0":1,"1":2}')))[0][0] == "[1,2]"
    assert one(docs, C.html_escape(F.lit("<&>")))[0][0] == "\\u003c\\u0026\\u003e"


def test_explode_and_walk(docs):
    rows = iterate.explode(docs, "doc", "l").orderBy("id", "pos").select("id", "pos", F.to_json("value")).collect()
    assert [tuple(r) for r in rows] == [(0, 0, "1"), (0, 1, "2"), (0, 2, "3")]
    walked = iterate.walk(docs, "doc").where("id = 0").select("at", "depth", "type", "value").collect()
    assert [tuple(r) for r in walked] == [("a", 1, "object", None), ("a.b", 2, "number", "1"), ("l", 1, "array", None), ("l[0]", 2, "number", "1"), ("l[1]", 2, "number", "2"), ("l[2]", 2, "number", "3")]
    assert iterate.tokens(docs, "doc").where("kind = 'error'").count() == 1


def test_merge_rows_is_ordered(spark):
    rows = [(g, i, json.dumps({"last": i, f"k{i % 7}": i})) for g in ("x", "y") for i in range(100)] + [("x", 100, None)]
    got = {r.g: json.loads(r.doc) for r in combine.merge_rows(spark.createDataFrame(rows, "g string, i long, doc string").repartition(5), ["g"], "i", "doc").collect()}
    assert got["x"]["last"] == 99 and got["x"]["k0"] == 98 and len(got["y"]) == 8
    out = spark.range(1).select(combine.merge_columns([F.lit('{"a":1}'), F.lit('{"b":2}'), F.lit('{"a":3}')])).first()[0]
    assert out == '{"a":3,"b":2}'


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_merge_rows_is_a_left_fold(spark, parts):
    r = random.Random(parts)
    pool = ["{}", '{"k":{"p":1}}', '{"k":null}', '{"k":{"q":2}}', '{"k":[1,2]}', '{"k":[2,3]}', '{"k":{"p":{"x":1}}}', '{"k":7,"l":[1,1]}', "[1]", "bad"]
    rows = [(g, i, r.choice(pool)) for g in range(6) for i in range(r.randrange(1, 30))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        df = spark.createDataFrame(rows, "g long, i long, doc string").repartition(parts)
        got = {x.g: (x.doc and json.loads(x.doc), x.bad) for x in combine.merge_rows(df, ["g"], "i", "doc").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for g in range(6):
        total, bad = None, 0
        for _, _, d in sorted(x for x in rows if x[0] == g):
            v = None if d == "bad" else json.loads(d)
            if isinstance(v, dict):
                total = v if total is None else values.merge(total, v)
            else:
                bad += 1
        assert got[g] == (total, bad)


def test_odd_documents(spark):
    texts = ['{"a":1,"a":2}', '"\\ud800"', "1e999", '{"k":1} x', "1],[2", "1,2", '{"a":[' + "1," * 9 + "1]}", "[" * 250 + "]" * 250, "", " 1 ", '"' + "x" * 1_000_000 + '"', None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, doc string")
    assert [r[0] for r in one(df, C.json_valid("doc"))] == [True, True, True, False, False, False, True, False, False, True, True, False]
    assert [r[0] for r in one(df, C.native_nesting("doc"))][:1] + [r[0] for r in one(df, C.native_nesting("doc"))][7:11] == [1, 250, 0, 0, 0]
    assert one(df, C.native_typed(C.variant("doc"), "a", "long"), C.json_get_typed("doc", "a", "long"))[0] == (2, 2)
    assert one(df, C.json_compact("doc"))[1][0] == '"\ufffd"'
    assert [r.n for r in df.select("id", F.size(validate.json_validate("doc", Schema(type="integer"))).alias("n")).where("id = 2").collect()] == [1]


def test_large_files_have_an_error(spark, tmp_path):
    (tmp_path / "a.json").write_text("[1]")
    (tmp_path / "b.json").write_text("[" + "1," * 50 + "1]")
    got = {r.file[-6:]: (r.value, r.error) for r in jsonl.load_file(spark, str(tmp_path), DEFAULT.but(max_json_size=20)).collect()}
    assert got == {"a.json": ("[1]", None), "b.json": (None, "SIZE_LIMIT")}


def test_schema():
    s = Schema(
        type="object",
        required=("name",),
        additional_properties=False,
        properties={
            "name": Schema(type="string", min_length=2, max_length=4, pattern="^[a-z]+$"),
            "tags": Schema(type="array", min_items=1, max_items=2, unique_items=True, items=Schema(type="string")),
            "n": Schema(type="integer", minimum=0, maximum=10, exclusive_maximum=True, multiple_of=5),
            "kind": Schema(enum=("a", 1)),
            "one": Schema(const={"x": 1}, has_const=True),
        },
    )
    assert validate.violations({"name": "abc", "tags": ["x"], "n": 5, "kind": 1.0, "one": {"x": 1.0}}, s) == []
    found = validate.violations({"tags": ["x", "x", 3], "n": 10, "kind": "b", "one": 2, "more": 1}, s)
    assert {p for p, _ in found} == {"name", "tags", "tags[1]", "tags[2]", "n", "kind", "one", "more"}
    assert validate.violations(2.5, Schema(type="integer")) and not validate.violations(-10, Schema(multiple_of=5))


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("email", "a.b@example.org", "a@b"),
        ("email", "x@y.co", ".x@y.co"),
        ("date", "2024-02-29", "2023-02-29"),
        ("date-time", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00"),
        ("time", "23:59:59", "24:00:00"),
        ("uri", "a://b", "a:b"),
        ("uuid", "123e4567-e89b-12d3-a456-426614174000", "123e4567"),
        ("ipv4", "1.2.3.4", "1.2.3.256"),
        ("ipv6", "fe80::1", "::ffff:1.2.3.4"),
        ("unknown", "anything", None),
    ],
)
def test_formats(kind, good, bad):
    s = Schema(type="string", format=kind)
    assert validate.violations(good, s) == []
    assert bad is None or validate.violations(bad, s)


def test_security(spark):
    texts = ["<script>x", "safe text", "my__proto__", "x.prototype.y", "evaluate(", "eval(1)", "ONCLICK=", "fonclick", "constructor[0]", None, "prototypes"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    assert [r[0] for r in one(df, security.is_dangerous("t"))] == [True, False, False, True, False, True, True, False, True, None, False]
    security.register("zzz(")
    try:
        assert one(df, security.is_dangerous(F.lit("a zzz(b")))[0][0] and "zzz(" in security.registered()
    finally:
        security.unregister("zzz(")
    assert [r[0] for r in one(df, security.is_sensitive(F.lit('{"Api_Key":1}')))][0]
    assert security.nesting('{"a":["[[[",{"b":1}]}') == 3
    assert one(df, security.native_nesting(F.lit('{"a":["[[[",{"b":1}]}')))[0][0] == 3


def test_jsonl_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [json.dumps({"i": i, "pad": "x" * 50}) for i in range(5000)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.jsonl").write_text('\n# comment\n// also\n/not/one\n{"k":1}\n[2]\n{bad\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = jsonl.read_lines(spark, str(tmp_path / "a.jsonl"))
        assert got.select("line_num", F.get_json_object("value", "$.i").cast("long").alias("i")).where("line_num <> i + 1").count() == 0 and got.count() == 5000
        assert spark.read.text(str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    b = jsonl.read_jsonl(spark, str(tmp_path / "b.jsonl"), DEFAULT.but(skip_comments=True), objects_only=True)
    assert {(r.line_num, r.error) for r in b.collect()} == {(4, "INVALID_JSON"), (5, None), (6, "NOT_AN_OBJECT"), (7, "INVALID_JSON")}
    assert [r.line_num for r in jsonl.good(b).collect()] == [5]
    with pytest.raises(Exception, match="line"):
        jsonl.strict(b).collect()
    assert jsonl.read_into(spark, str(tmp_path / "a.jsonl"), "i long", True).count() == 5000


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([('{"a":1}',), ('{"b":[1,2]}',)], "doc string")
    jsonl.write_jsonl(df.coalesce(1), str(tmp_path / "out"), "doc")
    assert sorted(r.value for r in jsonl.read_lines(spark, str(tmp_path / "out")).collect()) == ['{"a":1}', '{"b":[1,2]}']
    assert tuple(jsonl.jsonl_stats(df, "doc").first()) == (2, 20)
    (tmp_path / "one.json").write_text('[{"a":1},{"a":2}]')
    assert jsonl.load_typed(spark, str(tmp_path / "one.json"), "a long").count() == 2
    assert get_value(jsonl.load_file(spark, str(tmp_path / "one.json")).first().value, "{a}[1]") == 2
    assert jsonl.load_text(spark, "[1]").count() == 1
    assert jsonl.allowed_path("/data/x.json", ["/data"]) and not jsonl.allowed_path("/data/../etc/x", ["/data"]) and not jsonl.allowed_path("/data/%2e%2e/x", ["/data"])


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.jsonl").write_text('{"t":"2024-01-01T00:00:10","k":1}\n{"t":"2024-01-01T00:00:50","k":2}\n\nbad\n{"t":"2024-01-01T00:01:10","k":5}\n')
    stream = streams.read_stream(spark, str(tmp_path / "in"))
    time = F.to_timestamp(C.native_typed("v", "t", "string"))
    agg = streams.windowed(stream, time, "0 seconds", "1 minute", [], [F.sum(C.native_typed("v", "k", "long")).alias("k")])
    seen = []
    streams.for_each_batch(agg, lambda df, _: seen.extend((str(r.window.start), r.k) for r in df.collect()), str(tmp_path / "c1")).awaitTermination()
    assert dict(seen)["2024-01-01 00:00:00"] == 3
    streams.write_stream(jsonl.good(streams.read_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.text(str(tmp_path / "out")).count() == 3


def test_engine_hooks_and_validators(docs):
    seen = []

    class Log:
        def before(self, op, path):
            seen.append(("before", op, path))
            if path == "secret":
                raise PermissionError(path)

        def after(self, op, path, error, seconds):
            seen.append(("after", op, type(error).__name__))

    e = Engine(DEFAULT.but(validators=(lambda c: c.startswith("{"),)), hooks=[Log()])
    assert one(docs, e.get("doc", "a.b"))[0][0] == "1" and one(docs, e.get("doc", ""))[5][0] is None
    with pytest.raises(PermissionError):
        e.get("doc", "secret")
    assert seen[:2] == [("before", "get", "a.b"), ("after", "get", "NoneType")] and e.counts == {"get": 2}
    df, observed = e.observed(docs, "doc")
    df.count()
    assert observed.get["rows"] == 6


def test_driver_side_texts():
    assert set_text('{"a":1}', "b.c", 2) == '{"a":1,"b":{"c":2}}' and delete_text('{"a":1,"b":2}', "a") == '{"b":2}'
    assert merge_texts(['{"a":1}', '{"a":2}', '{"b":3}']) == '{"a":2,"b":3}'
