"""Queries over the test tables: documents are made of rows, and typed values are read back from them, with the SQL that gives the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.config import DEFAULT, EncodeConfig
from docloom.functions import columns as C
from docloom.functions import convert
from docloom.operators import batch, combine, iterate, security, validate
from docloom.operators.validate import Schema

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, doc): each order with its lines by number, as JSON text. One shuffle, on the order's key, serves grouping and join."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag")
    items = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_returnflag").alias("flag")))).alias("lines"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    joined = orders.join(items, orders["o_orderkey"] == items["l_orderkey"])
    doc = F.struct(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).alias("order"), F.col("lines"))
    return joined.select("o_orderkey", F.to_json(doc).alias("doc"))


_LINES = "lines AS (SELECT l_orderkey AS k, list({'n': l_linenumber, 'part': l_partkey, 'qty': l_quantity, 'flag': l_returnflag} ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS l FROM lineitem GROUP BY l_orderkey), o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, l FROM orders JOIN lines ON k = o_orderkey)"


def customer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, doc): customers with their nation and region. Both of these tables have a fixed, small number of rows."""
    n = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    doc = F.struct("c_name", "c_mktsegment", F.col("c_acctbal").alias("balance"), F.struct(F.col("n_name").alias("name"), F.struct(F.col("r_name").alias("name")).alias("region")).alias("nation"))
    return c.select("c_custkey", F.to_json(doc).alias("doc"))


_CUSTOMERS = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


# ---- get


@query(
    "json_typed_agg",
    "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS sum_k, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM events GROUP BY event_type",
)
def json_typed_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B4 and catalogue's first: a property of documents, in the JVM, into an aggregate with partial sums."""
    e = table(spark, sf_dir, "events").select("event_type", C.native_typed(C.variant("props"), "k", "long").alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("sum_k"), F.max("k").alias("max_k"))


@query("json_get_exact", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing, -1 AS other FROM events")
def json_get_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several paths of a document in one parse, missing ones and defaults."""
    got = C.json_get_all("props", {"k": ("k", "long"), "missing": ("nothing.here", "string"), "other": ("nothing", "int")})
    e = table(spark, sf_dir, "events").select("event_id", got.alias("g"))
    return e.select("event_id", "g.k", "g.missing", F.coalesce("g.other", F.lit(-1)).alias("other"))


@query("json_nested_native", f"SELECT c_custkey, n_name AS nation, r_name AS region, c_acctbal AS balance FROM {_CUSTOMERS}")
def json_nested_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parse once, then nested properties by native expressions."""
    v = customer_docs(spark, sf_dir).select("c_custkey", C.variant("doc").alias("v"))
    return v.select("c_custkey", C.native_typed("v", "nation.name", "string").alias("nation"), C.native_typed("v", "nation.region.name", "string").alias("region"), C.native_typed("v", "balance", "double").alias("balance"))


@query("json_pointer", f"SELECT c_custkey, r_name AS region FROM {_CUSTOMERS}")
def json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return customer_docs(spark, sf_dir).select("c_custkey", C.json_get_typed("doc", "/nation/region/name", "string").alias("region"))


@query("json_index", f"WITH {_LINES} SELECT o_orderkey, l[1].part AS first_part, l[-1].qty AS last_qty, coalesce(l[6].part, -1) AS sixth_part FROM o")
def json_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule of indices: from the front, from the end, out of range."""
    got = C.json_get_all("doc", {"a": ("lines[0].part", "long"), "b": ("lines[-1].qty", "double"), "c": ("lines[5].part", "long")})
    return order_docs(spark, sf_dir).select("o_orderkey", got.alias("g")).select("o_orderkey", F.col("g.a").alias("first_part"), F.col("g.b").alias("last_qty"), F.coalesce("g.c", F.lit(-1)).alias("sixth_part"))


@query(
    "json_slice",
    f"WITH {_LINES} SELECT o_orderkey, len(l[2:3]) AS mid, len(list_filter(l, lambda x, i: i % 2 = 1)) AS odd, l[-1].part AS reversed_first FROM o",
)
def json_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule of slices, by native expressions over array<variant>."""
    v = order_docs(spark, sf_dir).select("o_orderkey", C.native_get(C.variant("doc"), "lines").alias("v"))
    return v.select(
        "o_orderkey",
        F.size(C.native_slice(F.col("v"), 1, 3)).cast("long").alias("mid"),
        F.size(C.native_slice(F.col("v"), None, None, 2)).cast("long").alias("odd"),
        F.try_variant_get(F.get(C.native_slice(F.col("v"), None, None, -1), F.lit(0)), "$.part", "bigint").alias("reversed_first"),
    )


@query("json_extract_field", f"WITH {_LINES} SELECT o_orderkey, list_sum(list_transform(l, lambda x: x.part))::BIGINT AS part_sum, len(l) AS n FROM o")
def json_extract_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{field} over an array, by native expressions."""
    v = order_docs(spark, sf_dir).select("o_orderkey", C.native_extract(C.native_get(C.variant("doc"), "lines"), "part").alias("p"))
    add = lambda a, x: a + F.coalesce(F.try_variant_get(x, "$", "bigint"), F.lit(0))
    return v.select("o_orderkey", F.aggregate("p", F.lit(0).cast("bigint"), add).alias("part_sum"), F.size("p").cast("long").alias("n"))


@query(
    "json_extract_exact",
    f"WITH {_LINES} SELECT o_orderkey, l[1].part AS first_of_field, len(l[1:2]) AS sliced, len(l) AS flat, len(l) AS every, len(l) AS picked FROM o",
)
def json_extract_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """{f}[n], {f}[a:b], {flat:f}, [*].f and several fields."""
    d = order_docs(spark, sf_dir)
    size = lambda p: F.size(F.from_json(C.json_get("doc", p), "array<string>")).cast("long")
    return d.select(
        "o_orderkey",
        C.json_get_typed("doc", "lines{part}[0]", "long").alias("first_of_field"),
        size("lines{part}[0:2]").alias("sliced"),
        size("lines{flat:part}").alias("flat"),
        size("lines[*].part").alias("every"),
        size("lines{part,qty}").alias("picked"),
    )


@query("json_distribute", f"WITH {_LINES} SELECT o_orderkey, len(l) AS n FROM o WHERE len(l) > 1")
def json_distribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name over an array goes to its elements; a single result stands alone, so it isn't an array."""
    got = order_docs(spark, sf_dir).select("o_orderkey", C.once(g=C.safe_get("doc", "lines.part")).alias("x")).where("x.g.type = 'array'")
    return got.select("o_orderkey", F.size(F.from_json("x.g.value", "array<bigint>")).cast("long").alias("n"))


@query("json_safe_get", "SELECT event_id, true AS found, 'number' AS type, 'PATH_NOT_FOUND' AS missing, 'TYPE_MISMATCH' AS wrong FROM events")
def json_safe_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", C.safe_get("props", "k").alias("a"), C.safe_get("props", "nothing").alias("b"), C.safe_get("props", "k[0]").alias("c"))
    return e.select("event_id", F.col("a.exists").alias("found"), "a.type", F.col("b.error").alias("missing"), F.col("c.error").alias("wrong"))


@query("json_strict_get", f"WITH {_LINES} SELECT o_orderkey, len(l) >= 3 AS third, 'TYPE_MISMATCH' AS spread FROM o")
def json_strict_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compiled paths are strict: out of range is missing, and names aren't spread over arrays."""
    d = order_docs(spark, sf_dir)
    return d.select("o_orderkey", C.safe_get("doc", "lines[2].part", strict=True)["exists"].alias("third"), C.safe_get("doc", "lines.part", strict=True)["error"].alias("spread"))


@query(
    "json_conversions",
    "SELECT event_id, CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS as_long, value AS as_double, value <> 0 AS as_boolean, CAST(regexp_extract(event_type, '^[+-]?[0-9]+$') = '' AS BOOLEAN) AS not_a_number FROM events WHERE value IS NOT NULL",
)
def json_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 to L4: whole numbers only as integers, texts by strict rules."""
    e = table(spark, sf_dir, "events").where("value is not null").select("event_id", F.try_parse_json(F.to_json(F.struct("value", "event_type"))).alias("v"))
    n = C.native_get("v", "value")
    return e.select("event_id", convert.variant_to(n, "long").alias("as_long"), convert.variant_to(n, "double").alias("as_double"), convert.variant_to(n, "boolean").alias("as_boolean"), C.native_typed("v", "event_type", "long").isNull().alias("not_a_number"))


# ---- predicates


@query("json_valid", "SELECT event_id, json_valid(props) AS ok, false AS trailing, false AS cut FROM events")
def json_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", C.json_valid("props").alias("ok"), C.json_valid(F.concat("props", F.lit(" x"))).alias("trailing"), C.json_valid(F.expr("substr(props, 1, length(props) - 1)")).alias("cut"))


@query("json_filter", "SELECT count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) % 10 = 3")
def json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a predicate on a document."""
    e = table(spark, sf_dir, "events").where(C.native_typed(C.variant("props"), "k", "long") % 10 == 3)
    return e.agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("json_null_tests", "SELECT event_id, false AS is_null, true AS missing_null, CAST(json_extract(props, '$.k') AS BIGINT) = 0 AS is_empty FROM events")
def json_null_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", C.json_is_null("props", "k").alias("is_null"), C.json_is_null("props", "x").alias("missing_null"), C.json_is_empty("props", "k").alias("is_empty"))


@query("json_equal", "SELECT event_id, true AS same, false AS other FROM events")
def json_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 is 1.0, and spaces don't matter."""
    e = table(spark, sf_dir, "events")
    wide = F.replace(F.replace("props", F.lit(":"), F.lit(" : ")), F.lit("}"), F.lit(".0 }"))
    return e.select("event_id", C.json_equal("props", wide).alias("same"), C.json_equal("props", F.lit("{}")).alias("other"))


@query("json_first", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50 ORDER BY event_id LIMIT 1")
def json_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", C.native_typed(C.variant("props"), "k", "long").alias("k"))
    return iterate.first(e, F.col("k") > 50, "event_id")


# ---- set and delete, read back


@query("json_set", f"WITH {_LINES} SELECT o_orderkey, 'done' AS status, 99 AS first_qty, len(l) + 1 AS grown, 7 AS made, 0 AS every FROM o")
def json_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property, index, append, created path, wildcard."""
    changes = [("set", "order.status", "done"), ("set", "lines[0].qty", 99), ("set", "lines[+]", {"part": 1}), ("set", "new.path.x", 7), ("set", "lines[*].part", 0)]
    d = order_docs(spark, sf_dir).select("o_orderkey", C.json_apply("doc", changes).alias("doc"))
    paths = {"status": ("order.status", "string"), "first_qty": ("lines[0].qty", "int"), "lines": ("lines", "string"), "made": ("new.path.x", "int"), "every": ("lines[-1].part", "int")}
    d = d.select("o_orderkey", C.json_get_all("doc", paths).alias("g"))
    grown = F.size(F.from_json("g.lines", "array<string>")).cast("long").alias("grown")
    return d.select("o_orderkey", "g.status", "g.first_qty", grown, "g.made", "g.every")


@query("json_set_slice", f"WITH {_LINES} SELECT o_orderkey, CAST(list_sum(list_transform(l, lambda x, i: CASE WHEN i IN (1, 2) THEN 0 ELSE x.part END)) AS BIGINT) AS part_sum, greatest(len(l), 2) AS n FROM o WHERE len(l) >= 2")
def json_set_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of a slice."""
    parts = F.from_json("doc", "struct<lines: array<struct<part: bigint>>>")["lines"]["part"]
    d = order_docs(spark, sf_dir).select("o_orderkey", F.to_json(F.struct(parts.alias("p"))).alias("doc"), F.size(parts).alias("n_lines")).where("n_lines >= 2")
    p = F.from_json(F.get_json_object(C.json_set("doc", "p[0:2]", 0), "$.p"), "array<bigint>")
    d = d.select("o_orderkey", F.explode(F.array(p)).alias("p"))  # worked out once
    return d.select("o_orderkey", F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("part_sum"), F.size("p").cast("long").alias("n"))


@query("json_set_many", "SELECT event_id, 1 AS a, 'x' AS b, true AS kept FROM events")
def json_set_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3, and its rule that a failure leaves the original text."""
    e = table(spark, sf_dir, "events").select("event_id", "props", C.json_set_many("props", {"a": 1, "b.c": "x"}).alias("doc"), C.json_set_many("props", {"a": 1, "k[+]": 2}).alias("same"))
    return e.select("event_id", C.json_get_typed("doc", "a", "int").alias("a"), C.json_get_typed("doc", "b.c", "string").alias("b"), (F.col("same") == F.col("props")).alias("kept"))


@query(
    "json_delete",
    f"WITH {_LINES} SELECT o_orderkey, len(l) - 1 AS rest, coalesce(l[2].part, -1) AS now_first, 0 AS flags, true AS kept FROM o WHERE len(l) >= 2",
)
def json_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index, extracted field, a missing property that leaves the text."""
    cut = C.json_apply("doc", [("delete", "lines[0]"), ("delete", "lines{flag}")])
    d = order_docs(spark, sf_dir).select("o_orderkey", cut.alias("cut"), (C.json_delete("doc", "order.nothing") == F.col("doc")).alias("kept"))
    got = C.json_get_all("cut", {"lines": ("lines", "string"), "first": ("lines[0].part", "long"), "flags": ("lines{flag}", "string")})
    n = lambda c: F.size(F.from_json(c, "array<string>"))
    d = d.select("o_orderkey", C.once(g=got, kept=F.col("kept")).alias("x")).select("o_orderkey", n("x.g.lines").cast("long").alias("rest"), F.coalesce("x.g.first", F.lit(-1)).alias("now_first"), n("x.g.flags").alias("flags"), "x.kept")
    return d.where("rest >= 1")


@query("json_delete_slice", f"WITH {_LINES} SELECT o_orderkey, len(l) - 2 AS rest, coalesce(l[3].part, -1) AS now_first FROM o WHERE len(l) >= 2")
def json_delete_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice that must be within bounds."""
    d = order_docs(spark, sf_dir).select("o_orderkey", C.once(doc=F.col("doc"), cut=C.json_delete("doc", "lines[0:2]")).alias("x")).where("x.cut <> x.doc")
    got = C.json_get_all("x.cut", {"lines": ("lines", "string"), "first": ("lines[0].part", "long")})
    d = d.select("o_orderkey", got.alias("g"))
    return d.select("o_orderkey", F.size(F.from_json("g.lines", "array<string>")).cast("long").alias("rest"), F.coalesce("g.first", F.lit(-1)).alias("now_first"))


@query("json_delete_clean", "SELECT event_id, 1 AS entries FROM events")
def json_delete_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls and empty containers go after the deletion."""
    doc = F.concat(F.lit('{"gone":1,"n":null,"e":{"x":[]},"l":[null,""],"p":'), "props", F.lit("}"))
    e = table(spark, sf_dir, "events").select("event_id", C.json_delete_clean(doc, "gone").alias("d"))
    return e.select("event_id", F.size(F.from_json("d", "map<string,string>")).alias("entries"))


@query("json_native_change", f"SELECT c_custkey, 'new' AS segment, 5 AS made, n_name AS nation, false AS has_name, CAST(4 AS BIGINT) AS n FROM {_CUSTOMERS}")
def json_native_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D5, E1 on parsed documents, all in the JVM."""
    v = customer_docs(spark, sf_dir).select("c_custkey", C.variant("doc").alias("v"))
    v = v.select("c_custkey", C.native_put("v", "c_mktsegment", F.lit("new")).alias("v"))
    v = v.select("c_custkey", C.native_remove(C.native_put("v", "extra.deep", F.lit(5)), "c_name").alias("v"))
    return v.select(
        "c_custkey",
        C.native_typed("v", "c_mktsegment", "string").alias("segment"),
        C.native_typed("v", "extra.deep", "int").alias("made"),
        C.native_typed("v", "nation.name", "string").alias("nation"),
        C.native_get("v", "c_name").isNotNull().alias("has_name"),
        F.size(F.col("v").cast("map<string,variant>")).cast("long").alias("n"),
    )


@query("json_native_merge", f"SELECT c_custkey, 'b' AS segment, c_name AS name, 1 AS added, CAST(5 AS BIGINT) AS n_union, CAST(1 AS BIGINT) AS n_both, CAST(3 AS BIGINT) AS n_only FROM {_CUSTOMERS}")
def json_native_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 to K3 on parsed flat documents, all in the JVM."""
    d = customer_docs(spark, sf_dir).select("c_custkey", C.variant("doc").alias("a"), C.variant(F.lit('{"c_mktsegment":"b","x":1}')).alias("b"))
    d = d.select("c_custkey", *[C.native_merge("a", "b", m).alias(m) for m in ("union", "intersection", "difference")])
    n = lambda c: F.size(F.col(c).cast("map<string,variant>")).cast("long")
    return d.select(
        "c_custkey",
        C.native_typed("union", "c_mktsegment", "string").alias("segment"),
        C.native_typed("union", "c_name", "string").alias("name"),
        C.native_typed("union", "x", "int").alias("added"),
        n("union").alias("n_union"),
        n("intersection").alias("n_both"),
        n("difference").alias("n_only"),
    )


# ---- iteration


@query("json_explode", f"WITH {_LINES} SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS pos, l[i].part AS part, l[i].qty AS qty FROM o, LATERAL unnest(range(1, len(l) + 1)) AS u(i)")
def json_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1, F2 in the JVM: rows from the elements of an array."""
    e = iterate.explode(order_docs(spark, sf_dir), "doc", "lines")
    return e.select("o_orderkey", "pos", F.try_variant_get("value", "$.part", "bigint").alias("part"), F.try_variant_get("value", "$.qty", "double").alias("qty"))


@query("json_explode_object", "SELECT event_id, 'k' AS key, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_explode_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of objects."""
    e = iterate.explode(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    return e.select("event_id", "key", F.try_variant_get("value", "$", "bigint").alias("k"))


@query("json_explode_path", f"WITH {_LINES} SELECT o_orderkey, CAST(i - 1 AS INTEGER) AS pos, 'lines{{part}}[' || (i - 1) || ']' AS at, CAST(l[i].part AS VARCHAR) AS value FROM o, LATERAL unnest(range(1, len(l) + 1)) AS u(i)")
def json_explode_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """with the path of each element."""
    return iterate.explode_path(order_docs(spark, sf_dir), "doc", "lines{part}").select("o_orderkey", "pos", "at", "value")


@query("json_walk", f"WITH {_LINES} SELECT o_orderkey, 5 + 5 * len(l) AS n, CAST(3 AS INTEGER) AS deepest, 2 + len(l) AS containers FROM o")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every value below the root."""
    w = iterate.walk(order_docs(spark, sf_dir), "doc")
    return w.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("deepest"), F.count_if(F.col("type").isin("array", "object")).alias("containers"))


@query("json_tokens", "SELECT event_id, 5 AS tokens, 1 AS numbers FROM events")
def json_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token reader."""
    t = iterate.tokens(table(spark, sf_dir, "events").select("event_id", "props"), "props")
    return t.groupBy("event_id").agg(F.count(F.lit(1)).cast("int").alias("tokens"), F.count_if(F.col("kind") == "number").cast("int").alias("numbers"))


@query("json_decode_all", "SELECT event_id, CAST(2 AS BIGINT) AS n FROM events")
def json_decode_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that follow each other in a text."""
    d = iterate.decode_all(table(spark, sf_dir, "events").select("event_id", F.concat("props", F.lit("\n"), "props").alias("d")), "d")
    return d.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "jsonl_chunks",
    "SELECT (event_id - (SELECT min(event_id) FROM events)) // 1000 AS chunk, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS s FROM events GROUP BY 1",
)
def jsonl_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunks of consecutive lines."""
    e = table(spark, sf_dir, "events")
    low = e.agg(F.min("event_id").alias("low"))
    lines = e.join(F.broadcast(low)).select((F.col("event_id") - F.col("low") + 1).alias("line_num"), "props")  # one row
    c = iterate.chunks(lines, 1000, "line_num", "props")
    total = F.aggregate("items", F.lit(0).cast("bigint"), lambda a, x: a + C.native_typed(C.variant(x), "k", "long"))
    return c.select("chunk", F.col("n").cast("long").alias("n"), total.alias("s"))


@query(
    "jsonl_fold",
    "SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS result FROM events GROUP BY event_type",
)
def jsonl_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: an ordered fold; this one is a sum, so it can be held against SQL."""
    e = table(spark, sf_dir, "events").select("event_type", "event_id", C.native_typed(C.variant("props"), "k", "long").alias("k"))
    return iterate.fold(e, ["event_type"], "event_id", "k", F.lit(0).cast("bigint"), lambda acc, x: acc + x)


@query(
    "json_take_while",
    "WITH e AS (SELECT user_id, event_id, max(CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) < 80 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) SELECT user_id, count(*) AS n FROM e WHERE s = 0 GROUP BY user_id",
)
def json_take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iteration that breaks off."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", C.native_typed(C.variant("props"), "k", "long").alias("k"))
    return iterate.take_while(e, F.col("k") < 80, ["event_id"], ["user_id"]).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("jsonl_parse", "SELECT o_orderkey, count(*) AS n, sum(l_partkey)::BIGINT AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def jsonl_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to JSON Lines in a text, with an empty line and a comment, and back."""
    from docloom.sources import jsonl

    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_json(F.struct("l_partkey")).alias("j"))
    texts = jsonl.to_jsonl(lines, ["o_orderkey"], "l_linenumber", "j").withColumn("jsonl", F.concat(F.lit("# head\n\n"), "jsonl"))
    rows = jsonl.parse_jsonl(texts, "jsonl", DEFAULT.but(skip_comments=True))
    return rows.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum(C.native_typed(C.variant("value"), "l_partkey", "long")).alias("parts"))


# ---- merge


@query("json_merge", f"SELECT c_custkey, c_name AS from_a, 'b' AS from_b, r_name AS deep, 1 AS added, CAST(2 AS BIGINT) AS common, CAST(2 AS BIGINT) AS only_a FROM {_CUSTOMERS}")
def json_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1 to K3: union, intersection and difference of objects, into depth."""
    other = F.lit('{"c_mktsegment":"b","nation":{"x":1}}')
    d = customer_docs(spark, sf_dir).select("c_custkey", *[C.json_merge("doc", other, m).alias(m) for m in ("union", "intersection", "difference")])
    got = C.json_get_all("union", {"from_a": ("c_name", "string"), "from_b": ("c_mktsegment", "string"), "deep": ("nation.region.name", "string"), "added": ("nation.x", "int")})
    keys = lambda c: F.size(F.from_json(c, "map<string,string>")).cast("long")
    d = d.select("c_custkey", got.alias("g"), keys("intersection").alias("common"), (keys("difference") - 1).alias("only_a"))
    return d.select("c_custkey", "g.*", "common", "only_a")


@query(
    "json_merge_rows",
    "SELECT user_id, CAST(count(DISTINCT event_type) AS BIGINT) AS kinds, CAST(json_extract(arg_max(props, event_id), '$.k') AS BIGINT) AS last_k FROM events GROUP BY user_id",
)
def json_merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8 over rows: later documents over earlier ones."""
    doc = F.concat(F.lit('{"t_'), "event_type", F.lit('":1,"last":'), "props", F.lit("}"))
    m = combine.merge_rows(table(spark, sf_dir, "events").select("user_id", "event_id", doc.alias("doc")), ["user_id"], "event_id", "doc")
    return m.select("user_id", (F.size(F.from_json("doc", "map<string,string>")) - 1).cast("long").alias("kinds"), C.json_get_typed("doc", "last.k", "long").alias("last_k"))


@query(
    "json_array_sets",
    "WITH p AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS f, list(DISTINCT l_linestatus) AS s FROM lineitem GROUP BY l_orderkey) SELECT k AS o_orderkey, len(list_distinct(list_concat(f, s))) AS u, len(list_intersect(f, s)) AS i, len(list_filter(f, lambda x: NOT list_contains(s, x))) AS d FROM p",
)
def json_array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4 to K6, native."""
    p = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("s"))
    f, s = F.col("f"), F.col("s")
    n = lambda c: F.size(c).cast("long")
    return p.select("o_orderkey", n(combine.array_union(f, s)).alias("u"), n(combine.array_intersection(f, s)).alias("i"), n(combine.array_difference(f, s)).alias("d"))


# ---- encoding


@query("json_encode", "SELECT doc_id, length(replace(replace(replace(replace(replace(text, '&', '\\u0026'), '<', '\\u003c'), '>', '\\u003e'), chr(8232), '\\u2028'), chr(8233), '\\u2029')) AS escaped FROM documents")
def json_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L16, native."""
    return table(spark, sf_dir, "documents").select("doc_id", F.char_length(C.html_escape("text")).cast("long").alias("escaped"))


@query("json_format", "SELECT event_id, CAST(length(props) AS INTEGER) - 1 AS compact, CAST(length(props) AS INTEGER) + 4 AS pretty, 1 AS fields, '1.23' AS cut, '1.24' AS rounded, '1500' AS plain FROM events")
def json_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact and pretty forms, float options, a field subset."""
    e = table(spark, sf_dir, "events")
    two = lambda t: C.json_get(C.json_encode(F.lit('{"x":1.2367}'), DEFAULT.but(encode=EncodeConfig(precision=2, truncate=t))), "x")
    return e.select(
        "event_id",
        F.length(C.json_compact("props")).alias("compact"),
        F.length(C.json_pretty("props")).alias("pretty"),
        F.size(F.from_json(C.json_fields("props", ["k", "x"]), "map<string,string>")).alias("fields"),
        two(True).alias("cut"),
        two(False).alias("rounded"),
        C.json_compact(F.lit("1.5e3")).alias("plain"),
    )


# ---- validation and safety

USER = Schema(
    type="object",
    required=("name", "balance"),
    additional_properties=False,
    properties={
        "name": Schema(type="string", min_length=1, max_length=40, pattern="^Customer"),
        "segment": Schema(type="string", enum=("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")),
        "balance": Schema(type="number", minimum=0),
        "nation": Schema(type="integer", maximum=20),
    },
)


@query(
    "json_validate",
    "SELECT c_custkey, CAST(CASE WHEN regexp_matches(c_name, '^Customer') THEN 0 ELSE 1 END + CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') THEN 0 ELSE 1 END + CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END + CASE WHEN c_nationkey > 20 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM customer",
)
def json_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's violations."""
    c = table(spark, sf_dir, "customer")
    doc = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation")))
    return c.select("c_custkey", F.size(validate.json_validate(doc, USER)).cast("long").alias("violations"))


@query(
    "json_validate_formats",
    "SELECT event_id, CAST(0 AS BIGINT) AS good, CAST(5 AS BIGINT) AS bad FROM events",
)
def json_validate_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats, on dates and addresses made from rows."""
    s = Schema(type="object", properties={"d": Schema(format="date"), "t": Schema(format="date-time"), "m": Schema(format="email"), "i": Schema(format="ipv4"), "u": Schema(format="uri")})
    e = table(spark, sf_dir, "events")
    good = F.to_json(
        F.struct(
            F.date_format("ts", "yyyy-MM-dd").alias("d"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"),
            F.concat(F.lit("user"), F.col("user_id"), F.lit("@example.org")).alias("m"),
            F.concat(F.lit("10.0.0."), F.col("event_id") % 256).alias("i"),
            F.lit("https://example.org").alias("u"),
        )
    )
    bad = F.lit('{"d":"2024-13-01","t":"2024-01-01","m":"a..b@example.org","i":"1.2.3","u":"example.org"}')
    n = lambda d: F.size(validate.json_validate(d, s)).cast("long")
    return e.select("event_id", n(good).alias("good"), n(bad).alias("bad"))


@query(
    "json_dangerous",
    "SELECT page_id, regexp_matches(html, '(?i)<script|<iframe|<object|<embed|<svg|__proto__|(^|[^A-Za-z0-9_])(constructor\\[|prototype\\.|javascript:|vbscript:|eval\\(|settimeout\\(|setinterval\\(|require\\(|new function\\(|fromcharcode\\(|atob\\(|expression\\()|(^|[^A-Za-z0-9_])(document\\.cookie|window\\.location|innerhtml|onerror|onload|onclick|onmouseover|onfocus|__definegetter__|__definesetter__)([^A-Za-z0-9_]|$)') AS dangerous FROM pages",
)
def json_dangerous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One regular expression over whole pages."""
    return table(spark, sf_dir, "pages").select("page_id", security.is_dangerous("html").alias("dangerous"))


@query(
    "json_sensitive",
    "SELECT doc_id, " + " OR ".join(f"contains(lower(text), '{w}')" for w in security.SENSITIVE) + " AS sensitive FROM documents",
)
def json_sensitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that point to secrets."""
    return table(spark, sf_dir, "documents").select("doc_id", security.is_sensitive("text").alias("sensitive"))


@query("json_input_error", "SELECT event_id, CAST(NULL AS VARCHAR) AS fine, 'INVALID_JSON' AS cut, 'SECURITY_VIOLATION' AS dangerous, 'DEPTH_LIMIT' AS deep, 1 AS depth FROM events")
def json_input_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a document out."""
    e = table(spark, sf_dir, "events")
    deep = F.concat(F.repeat(F.lit("["), 300), F.repeat(F.lit("]"), 300))
    return e.select(
        "event_id",
        security.json_input_error("props").alias("fine"),
        security.json_input_error(F.concat("props", F.lit("]"))).alias("cut"),
        security.json_input_error(F.concat(F.lit('{"__proto__":'), "props", F.lit("}"))).alias("dangerous"),
        security.json_input_error(deep).alias("deep"),
        security.native_nesting("props").alias("depth"),
    )


@query(
    "json_batch",
    "SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(json_extract(props, '$.k') AS VARCHAR) WHEN 1 THEN '{\"k\":1}' WHEN 2 THEN '{}' END AS result, CASE WHEN event_id % 4 = 3 THEN 'UNKNOWN_OPERATION' END AS error FROM events",
)
def json_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: operations as rows."""
    op = F.element_at(F.array(*map(F.lit, ("get", "set", "delete", "other"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", op.alias("op"), F.col("props").alias("doc"), F.lit("k").alias("path"), F.lit("1").alias("value"))
    return batch.process_batch(rows).select("event_id", "result", "error")


@query("json_warmup", "SELECT 'k' AS path, count(*) AS n, count(*) AS found, CAST(0 AS BIGINT) AS failed FROM events UNION ALL SELECT 'x', count(*), 0, count(*) FROM events")
def json_warmup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2."""
    return batch.warmup(table(spark, sf_dir, "events"), "props", ["k", "x"])


# ---- what Spark adds


@query(
    "json_window_agg",
    "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY 1, 2",
)
def json_window_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows over a property of documents; the same function runs on streams."""
    e = table(spark, sf_dir, "events").select("ts", "event_type", C.native_typed(C.variant("props"), "k", "long").alias("k"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k"))
    return w.select(F.col("w.start").alias("hour"), "event_type", "n", "k")


@query(
    "json_join",
    "SELECT c_mktsegment AS segment, count(*) AS n, sum(o_orderkey)::BIGINT AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
def json_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on a value inside documents; the planner chooses how."""
    c = table(spark, sf_dir, "customer").select(F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))).alias("doc")).select(C.variant("doc").alias("v"))
    c = c.select(C.native_typed("v", "id", "long").alias("id"), C.native_typed("v", "segment", "string").alias("segment"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(c, o["o_custkey"] == c["id"]).groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("orders"))


from docloom.plans import cases  # noqa: E402, F401  (registers its queries by the functions above)
