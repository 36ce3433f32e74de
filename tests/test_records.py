"""Records, arrays and objects as JSON text, Python objects as values, and what an engine keeps and counts."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field
from datetime import datetime

import pytest

from docloom import DEFAULT, Engine, Field, JsonError, encode_batch, encode_record, encode_stream, from_value, json_get_all, json_set, rfc3339, to_value
from docloom.functions import columns as C
from docloom.operators import iterate
from docloom.plans import path as P
from pyspark.sql import functions as F


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_columns_as_text(spark):
    nothing = F.lit(None).cast("string")
    got = one(
        spark, encode_stream(F.array()), encode_stream(F.lit(None).cast("array<int>")), encode_stream(F.array(F.lit('q"'), nothing)), encode_batch({}),
        encode_batch({'n"': nothing, "b": F.struct(F.lit(None).cast("int").alias("x"))}),
    )
    assert list(got) == ["[]", "null", '["q\\"",null]', "{}", '{"b":{"x":null},"n\\"":null}']


def test_fields_of_records(spark):
    empty = [F.lit(None).cast("int"), F.lit(0), F.lit(0.0), F.lit(""), F.lit(False), F.array(), F.create_map().cast("map<string,int>")]
    got = one(
        spark, encode_record(*(Field(f"f{i}", c, omit_empty=True) for i, c in enumerate(empty))), encode_record(*(Field(f"f{i}", c) for i, c in enumerate(empty))),
        encode_record(Field("z", F.lit(7), quoted=True), Field("y", F.lit(None).cast("int"), quoted=True), Field("raw", F.lit('{"k": [1]}'), raw=True), Field("none", F.lit(None).cast("string"), raw=True), Field("b", F.lit(b"\x00\xff"))),
        encode_record(),
    )
    assert list(got) == ["{}", '{"f0":null,"f1":0,"f2":0.0,"f3":"","f4":false,"f5":[],"f6":{}}', '{"z":"7","y":null,"raw":{"k": [1]},"none":null,"b":"AP8="}', "{}"]


def test_times(spark):
    at = ["2024-03-01T10:00:00Z", "2024-03-01T12:00:00.5+02:00", "1969-12-31T23:59:59.999999Z"]
    got = [one(spark, rfc3339(F.lit(t).cast("timestamp")))[0] for t in at]
    assert got == ["2024-03-01T10:00:00Z", "2024-03-01T10:00:00.5Z", "1969-12-31T23:59:59.999999Z"]
    assert list(one(spark, rfc3339(F.lit("2024-03-01 10:20:30").cast("timestamp_ntz")), rfc3339(F.lit(None).cast("timestamp")))) == ["2024-03-01T10:20:30Z", None]


@dataclass
class Point:
    x: int
    y: float | None = None
    tags: list[str] = field(default_factory=list, metadata={"json": "t", "omit_empty": True})
    hidden: str = field(default="", metadata={"json": "-"})


class Own:
    def __init__(self, n):
        self.n = n

    def marshal_json(self):
        return f'{{"own":{self.n}}}'

    @classmethod
    def unmarshal_json(cls, text):
        return cls(text)


def test_objects_as_values(spark):
    assert to_value([Point(1), Own(2), b"\x00\xff", datetime(2024, 3, 1, 10, 0, 0, 500_000), (1, {"k": Point(0, 2.0, ["a"], "h")})]) == [
        {"x": 1, "y": None}, {"own": 2}, "AP8=", "2024-03-01T10:00:00.5Z", [1, {"k": {"x": 0, "y": 2.0, "t": ["a"]}}],
    ]
    assert one(spark, json_set(F.lit("{}"), "p", Point(1, tags=["b"])))[0] == '{"p":{"t":["b"],"x":1,"y":null}}'


def test_values_as_objects():
    assert from_value({"x": 3, "t": ["a"], "other": 1}, Point) == Point(3, None, ["a"])
    assert from_value([{"x": 1, "y": 2}], list[Point]) == [Point(1, 2.0)]
    assert from_value({"a": None}, dict[str, int | None]) == {"a": None} and from_value({"own": 1}, Own).n == '{"own":1}'
    assert from_value("AP8=", bytes) == b"\x00\xff" and from_value("2024-03-01T10:00:00Z", datetime).year == 2024
    for v, cls in ((1.5, int), (True, int), (1, bool), ("1", int), ({}, Point), ([1], dict), ("?", bytes), ("x", datetime), (None, str), ({"x": "a"}, Point)):
        with pytest.raises(JsonError):
            from_value(v, cls)


def test_first_error_and_walk_below(spark):
    docs = spark.createDataFrame([(1, '{"a":{"b":1}}'), (2, "{}"), (3, "no"), (4, None)], "id int, doc string")
    got = docs.select("id", json_get_all("doc", {"b": ("a.b", "long")}, error="e").alias("g")).orderBy("id").select("g.*").collect()
    assert [tuple(r) for r in got] == [(1, None), (None, "PATH_NOT_FOUND"), (None, "INVALID_JSON"), (None, "INVALID_JSON")]
    assert [tuple(r) for r in iterate.walk(docs, "doc", path="a").select("id", "at", "value").collect()] == [(1, "b", "1")]
    with pytest.raises(JsonError):
        iterate.walk(docs, "doc", path="a[0]")


def test_kept_frames(spark):
    docs = lambda n: spark.range(n).select(F.format_string('{"k":%d}', "id").alias("doc"))
    e = Engine(DEFAULT.but(most_kept=2))
    first = e.parsed(docs(3), "doc")
    assert e.parsed(docs(3), "doc") is first and first.storageLevel.useMemory
    assert first.select(C.native_typed("v", "k", "long").alias("k")).agg(F.sum("k")).first()[0] == 3
    e.parsed(docs(4), "doc"), e.parsed(docs(5), "doc")
    assert not first.storageLevel.useMemory and e.metrics()["kept"] == {"hits": 1, "misses": 3, "ratio": 0.25, "frames": 2}
    e.clear_cache()
    assert e.metrics()["kept"]["frames"] == 0
    assert not Engine(DEFAULT.but(most_kept=0)).parsed(docs(6), "doc").storageLevel.useMemory
    old = Engine(DEFAULT.but(keep_seconds=-1))
    assert old.parsed(docs(7), "doc") is not old.parsed(docs(7), "doc")
    old.clear_cache()


def test_slots():
    e, inside, go = Engine(DEFAULT.but(most_running=1)), threading.Event(), threading.Event()
    t = threading.Thread(target=lambda: e.run(lambda: (inside.set(), go.wait(10))))
    t.start()
    assert inside.wait(10)
    with pytest.raises(JsonError, match="CONCURRENCY_LIMIT"):
        e.run(lambda: 1)
    assert not e.close(0.05)
    go.set()
    t.join()
    assert e.close() and e.metrics()["run"]["runs"] == 1
    with pytest.raises(JsonError, match="CLOSED"):
        e.run(lambda: 1)


def test_own_path_parser(spark):
    e = Engine(DEFAULT.but(path_parser=lambda p: P.parse(p.lower())))
    assert one(spark, e.get_typed(F.lit('{"k":4}'), "K", "long"))[0] == 4
