"""Exact top-k by inner product: vectors in buckets of like length, pruned by each query's local cosine threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut, n_parts

#: Vectors of a bucket and queries of a block, about.
BUCKET, BLOCK = 4_096, 512
#: Coordinates are looked at where the local cosine threshold reaches this, else lengths.
COORDINATE_FROM = 0.5
#: Coordinates looked at for a query: those in which it is largest.
FOCUS = 3
#: Bounds are loosened by this, as lengths and cosines are rounded; products of whole numbers aren't.
SLACK = 1e-9


def whole_vectors(df: DataFrame, scale: float = 256.0, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) of each component as 64-bit floats, which hold whole numbers up to 2**53.

    Left out: null keys, null vectors, and vectors with a null or non-finite component. Repeated rows stay, each a vector.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, vs, norms = [], [], []
            for i, x in zip(pdf["vec_id"], pdf["e"], strict=True):
                x = np.asarray(x, np.float64)  # null components become NaN
                if np.isfinite(x).all():
                    v = np.floor(scale * x)
                    ids.append(i), vs.append(v.astype("<f8").tobytes()), norms.append(float(np.sqrt((v * v).sum())))
            yield pd.DataFrame({"vec_id": pd.array(ids, "Int64"), "v": vs, "norm": np.array(norms, np.float64)})

    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("e")).where("vec_id is not null and e is not null")
    return rows.mapInPandas(run, "vec_id long, v binary, norm double")


def _matrix(vs: list[bytes], width: int) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled up with zeros, which change no product."""
    if all(len(v) == 8 * width for v in vs):
        return np.frombuffer(b"".join(vs), "<f8").reshape(-1, width)
    out = np.zeros((len(vs), width))
    for row, v in zip(out, vs, strict=True):
        row[: len(v) // 8] = np.frombuffer(v, "<f8")
    return out


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whole-number inner products q x p. Beyond 2**53 they are worked out as Python integers and held to the range of a long."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(1, q.shape[1]) < 2**53:
        return (q @ p.T).astype(np.int64)
    big = np.array([[int(x) for x in r] for r in q], object) @ np.array([[int(x) for x in r] for r in p], object).T
    return np.clip(big, -(2**63), 2**63 - 1).astype(np.int64)


def search_bucket(q_rows, q, q_norm, floor, p_rows, p_ids, p, p_norm, k: int) -> list[tuple[int, int, int]]:
    """(place of the query in q, place of the vector in p, score) of each query's k best in a bucket that reach its floor, the
    k-th best score known so far; a query never finds its own row.

    p stands by falling length. floor is -inf where fewer than k are known, and then the whole bucket is looked at.
    """
    found, longest = [], p_norm[0] if len(p_norm) else 0.0

    def best(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        ok = (p_rows[at] != q_rows[i]) & (scores >= floor[i])
        at, scores = at[ok], scores[ok]
        order = np.lexsort((p_ids[at], -scores))[:k] if len(at) <= 4 * k else None
        if order is None:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            ok = scores >= least
            at, scores = at[ok], scores[ok]
            order = np.lexsort((p_ids[at], -scores))[:k]
        found.extend((int(i), int(at[j]), int(scores[j])) for j in order)

    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(floor > 0, floor / (q_norm * longest), -1.0) * (1 - SLACK)  # the local cosine threshold
    live = ~(need > 1)
    by_coordinate = live & (need >= COORDINATE_FROM)
    for i in np.flatnonzero(by_coordinate):
        unit, turn = q[i] / q_norm[i], np.arccos(min(1.0, need[i]))
        at = np.arange(int(np.searchsorted(-p_norm, -floor[i] / q_norm[i] * (1 - SLACK), side="right")))
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            angle = np.arccos(np.clip(unit[f], -1, 1))  # a unit vector within `turn` of the query has its f-th coordinate between these
            low, high = np.cos(min(np.pi, angle + turn)) - SLACK, np.cos(max(0.0, angle - turn)) + SLACK
            c = p[at, f] / p_norm[at]
            at = at[(c >= low) & (c <= high)]
        if len(at):
            best(i, at, _products(q[i : i + 1], p[at])[0])
    rest = np.flatnonzero(live & ~by_coordinate)
    if len(rest) and len(p):
        with np.errstate(divide="ignore", invalid="ignore"):
            least = np.where(floor[rest] > 0, floor[rest] / q_norm[rest] * (1 - SLACK), -1.0)
        upto = np.searchsorted(-p_norm, -least, side="right")  # lengths that can reach the floor
        for at in range(0, len(rest), 128):
            some = rest[at : at + 128]
            n = upto[at : at + 128]
            scores = _products(q[some], p[: n.max()])
            for r, i in enumerate(some):
                best(i, np.arange(n[r]), scores[r, : n[r]])
    return found


_PACKED = "ids binary, rows binary, mat binary, norms binary, floors binary"


def _packed(rows: DataFrame, by: str) -> DataFrame:
    """One row for each value of `by`: ids, row numbers, vectors, lengths and floors of its rows, by falling length."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["norm", "vec_id", "row"], ascending=[False, True, True])
        width = max(map(len, pdf["v"])) // 8
        floors = pdf["floor"].astype("float64").fillna(-np.inf)
        return pd.DataFrame(
            [[pdf[by].iloc[0], *(pdf[c].to_numpy("<i8").tobytes() for c in ("vec_id", "row")), _matrix(list(pdf["v"]), width).tobytes(), pdf["norm"].to_numpy("<f8").tobytes(), floors.to_numpy("<f8").tobytes()]],
            columns=[by, *(c.split()[0] for c in _PACKED.split(", "))],
        )

    return rows.select(by, "vec_id", "row", "v", "norm", "floor").groupBy(by).applyInPandas(pack, f"{by} long, {_PACKED}")


class _Vectors:
    """What _packed wrote for one group."""

    def __init__(self, ids: bytes, rows: bytes, mat: bytes, norms: bytes, floors: bytes) -> None:
        self.ids, self.rows = np.frombuffer(ids, "<i8"), np.frombuffer(rows, "<i8")
        self.norm, self.floor = np.frombuffer(norms, "<f8"), np.frombuffer(floors, "<f8")
        self.mat = np.frombuffer(mat, "<f8").reshape(len(self.ids), -1)

    def search(self, bucket: _Vectors, k: int) -> pd.DataFrame:
        d = max(self.mat.shape[1], bucket.mat.shape[1])
        q, p = (np.pad(x, ((0, 0), (0, d - x.shape[1]))) if x.shape[1] < d else x for x in (self.mat, bucket.mat))
        found = np.array(search_bucket(self.rows, q, self.norm, self.floor, bucket.rows, bucket.ids, p, bucket.norm, k), np.int64).reshape(-1, 3)
        return pd.DataFrame({"row": self.rows[found[:, 0]], "query_id": self.ids[found[:, 0]], "vec_id": bucket.ids[found[:, 1]], "of": bucket.rows[found[:, 1]], "score": found[:, 2]})


_FOUND = "row long, query_id long, vec_id long, of long, score long"


def _ranges(df: DataFrame, column: str, size: int) -> DataFrame:
    """df with `_group`: rows of falling value of a column in groups of about `size`, where very frequent values are split by a hash
    of the row's number. The driver sees one number for each group."""
    n = df.count()
    n_groups = max(1, -(-n // size))
    ends = np.array(sorted(set(df.approxQuantile(column, [i / n_groups for i in range(1, n_groups)], 0.1 / n_groups))) if n_groups > 1 else [], np.float64)
    nth = F.pandas_udf(lambda x: pd.Series(np.searchsorted(-ends[::-1], -x.to_numpy(np.float64), side="left")), "long")  # 0: the highest values
    placed = df.withColumn("_nth", nth(column))
    pieces = np.ones(len(ends) + 1, np.int64)
    for r in placed.groupBy("_nth").count().collect():  # a row for each group
        pieces[r["_nth"]] = max(1, -(-r["count"] // (2 * size)))
    first = np.append(0, np.cumsum(pieces))[:-1]
    group = F.pandas_udf(lambda i, h: pd.Series(first[i] + h.to_numpy(np.int64) % pieces[i]), "long")
    return placed.withColumn("_group", group("_nth", F.shiftrightunsigned(F.xxhash64("row"), 1))).drop("_nth")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query row with all rows but its own, ties to the
    smaller vec_id; all if there are fewer. vectors: what whole_vectors returns. Repeated rows are queries and candidates each.

    Vectors are grouped by length into buckets of about `bucket` rows; very frequent lengths are split. The longest bucket, which
    every task holds (2*bucket vectors, about), gives each query a first floor, its k-th best score. Queries in blocks of like
    need (floor over own length) then go to the buckets that hold a vector of that length: each bucket stays in one place and
    is sent once. There, whole buckets fall where the longest vector would need a cosine over 1, else vectors too short or
    with a coordinate too far off. What is left is verified by whole-number products, so the result is exact.
    """
    spark = vectors.sparkSession
    parts = n_parts(spark)
    vectors = cut(vectors.withColumn("row", F.monotonically_increasing_id()).withColumn("floor", F.lit(None).cast("double")), "vectors")
    placed = _ranges(vectors, "norm", bucket).withColumnRenamed("_group", "bucket")
    buckets = cut(_packed(placed, "bucket"), "buckets")
    lengths = placed.groupBy("bucket").agg(F.max("norm").alias("longest")).orderBy(F.col("longest").desc(), "bucket").collect()  # a row for each bucket
    names, longest = np.array([r["bucket"] for r in lengths], np.int64), np.array([r["longest"] for r in lengths])
    queries = vectors.where(is_query)
    if not len(names):
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    top = tuple(map(bytes, buckets.where(F.col("bucket") == int(names[0])).select(*(c.split()[0] for c in _PACKED.split(", "))).first()))  # 2*bucket vectors, about

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = _Vectors(*top)
        for pdf in batches:
            for at in range(0, len(pdf), block):
                some = pdf.iloc[at : at + block]
                mat = _matrix(list(some["v"]), max(map(len, some["v"])) // 8)
                asked = _Vectors(some["vec_id"].to_numpy("<i8").tobytes(), some["row"].to_numpy("<i8").tobytes(), mat.tobytes(), some["norm"].to_numpy("<f8").tobytes(), np.full(len(some), -np.inf).tobytes())
                yield asked.search(held, k)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                floor, norm = np.frombuffer(r.floors, "<f8"), np.frombuffer(r.norms, "<f8")
                with np.errstate(divide="ignore", invalid="ignore"):
                    need = np.where(floor > 0, floor / norm, -1.0).min() * (1 - SLACK)
                for b in names[1 : int(np.searchsorted(-longest, -need, side="right"))].tolist():
                    yield pd.DataFrame([(b, 1, r.ids, r.rows, r.mat, r.norms, r.floors)], columns=["bucket", "kind", *(c.split()[0] for c in _PACKED.split(", "))])

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                one = _Vectors(r.ids, r.rows, r.mat, r.norms, r.floors)
                if r.kind == 0:
                    held = one
                else:
                    yield one.search(held, k)

    asked = queries.select("vec_id", "row", "v", "norm")
    seeded = cut(asked.repartition(parts).mapInPandas(seed, _FOUND), "seeds")
    floors = seeded.groupBy("row").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).cast("double").alias("floor"))
    floored = cut(asked.join(floors, "row", "left").withColumn("need", F.when((F.col("floor") > 0) & (F.col("norm") > 0), F.col("floor") / F.col("norm")).otherwise(F.lit(-1.0))), "floors")
    blocks = _packed(_ranges(floored, "need", block).withColumnRenamed("_group", "block"), "block")
    columns = ", ".join(c for c in _PACKED.split(", "))
    met = buckets.withColumn("kind", F.lit(0)).select("bucket", "kind", *(c.split()[0] for c in columns.split(", "))).unionAll(blocks.mapInPandas(deal, f"bucket long, kind int, {columns}"))
    rest = met.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInPandas(meet, _FOUND)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id", "of")
    return seeded.unionAll(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    return top_k(whole_vectors(embeddings), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(p.e AS DOUBLE[])) AS BIGINT) AS score,
  q.r, p.r AS of FROM v q JOIN v p ON q.r <> p.r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, of) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 5
"""
