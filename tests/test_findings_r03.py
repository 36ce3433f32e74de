"""What the findings of round 3 were about: costs of a row, and the same results by other ways."""

import json
import os
import re
import time

import pytest

from docloom.config import DEFAULT
from docloom.functions import values
from docloom.operators import iterate, security
from docloom.plans import catalogue

DEEP = "[" * 300 + "]" * 300


def best(f):
    took = []
    for _ in range(5):
        began = time.perf_counter()
        f()
        took.append(time.perf_counter() - began)
    return min(took)


@pytest.mark.parametrize("text", ["", "x", DEEP, "<ſcript", "<SCRıPT>", "JAVASCRİPT:", "upload", " onload ", "my__proto__", "ɐ__proto__", "setTimeout(", "xsettimeout(", "toKen", "é<svg\n"])
def test_scanner_finds_what_the_expression_finds(text):
    config = DEFAULT.but(patterns=("toKen", "é<"))
    assert security._scanner(config)(text) == bool(re.search(security.dangerous_regex(config), text))


def test_harmless_text_is_not_tried_with_every_pattern():
    expression, scan = re.compile(security.dangerous_regex(DEFAULT)), security._scanner(DEFAULT)
    assert best(lambda: scan(DEEP)) < best(lambda: expression.search(DEEP)) / 4


def test_input_error_of_odd_texts(spark):
    texts = {None: "INVALID_JSON", "": "INVALID_JSON", "﻿{}": "INVALID_JSON", DEEP: "DEPTH_LIMIT", '{"a":"' + "[" * 300 + '"}': None, '["a\\\n"]': "INVALID_JSON", "[" * 201: "DEPTH_LIMIT", "[" * 200: "INVALID_JSON", '{"__PROTO__":1}': "SECURITY_VIOLATION"}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])], "i int, d string").coalesce(1)
    got = [r[0] for r in rows.select("i", security.json_input_error("d").alias("e")).orderBy("i").select("e").collect()]
    assert got == [*texts.values(), *texts.values()]


def test_input_error_looks_at_equal_texts_once(spark):
    same = spark.range(0, 20000, 1, 1).selectExpr("id", f"concat('{DEEP}', id % 2) as d").select(security.json_input_error("d").alias("e"))
    began = time.perf_counter()
    assert same.distinct().collect() == [("DEPTH_LIMIT",)]
    assert time.perf_counter() - began < 10  # 16 s and more where each is looked at


ODD = [{"b": [1, 17.0, {"": None, "x": "1e5"}], "a": -0.0, "é\n": True}, [[], {}, [1e22, 1e-7, 2**60]], {}, [], "x", None, 1.5]


@pytest.mark.parametrize("most", [1, 2, 200])
@pytest.mark.parametrize("value", ODD)
def test_walk_into_lists_gives_what_walk_gives(value, most):
    lists = [[], [], [], [], []]
    values.walk_into(value, most, *lists)
    assert list(zip(*lists)) == [(p, n, k, values.kind(x), None if isinstance(x, (list, dict)) else values.dumps(x)) for p, n, k, x in values.walk(value, most=most)]


def test_rows_of_documents_without_any(spark):
    docs = spark.createDataFrame([(0, "[]"), (1, None), (2, "{bad"), (3, "7"), (4, '{"a":[1.0]}')], "id int, doc string").coalesce(1)
    assert [tuple(r) for r in iterate.walk(docs, "doc").drop("doc").collect()] == [(4, "a", 1, "a", "array", None), (4, "a[0]", 2, "0", "number", "1")]
    assert [tuple(r) for r in iterate.explode_path(docs, "doc", "a").drop("doc").collect()] == [(4, 0, "0", "a[0]", "1")]
    assert [tuple(r) for r in iterate.decode_all(docs, "doc").drop("doc").collect()] == [(0, 0, "[]"), (3, 0, "7"), (4, 0, '{"a":[1]}')]
    assert [tuple(r)[0] for r in iterate.tokens(docs, "doc").where("kind = 'error'").collect()] == [2]


@pytest.mark.parametrize("value", [*ODD, {1: 2}, "[" * 5, {"a": float("nan")}, [float("inf"), -1e21, 9.99e20, 2**53 + 1]])
def test_plain_text_is_that_of_the_general_writer(value):
    plain = DEFAULT.encode.__class__(prefix="unused")  # equal to no settings, but for what only pretty texts show
    assert values.dumps(value) == (values._standard(value) if value == {1: 2} else values.dumps(json.loads(json.dumps(value)), plain))


def test_whole_floats_are_written_at_once():
    lines = {"lines": [{"n": i, "part": 1000 + i, "qty": 7.0 * i, "flag": "N"} for i in range(8)]}
    assert best(lambda: values.dumps(lines)) < 5 * best(lambda: values._standard(lines))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize(("name", "most"), [("json_delete_slice", 2), ("json_delete", 3), ("json_distribute", 1)])
def test_filters_do_not_copy_python_functions(spark, name, most):
    plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    calls = [re.findall(r"\brun\w*\(", line) for line in plan.splitlines() if "ArrowEvalPython" in line]
    assert sum(map(len, calls)) == most
