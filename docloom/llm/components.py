"""Connected components of a graph in DataFrames: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import cut


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v").groupBy("u", "v").agg(F.count(F.lit(1)).alias("_n")).select("u", "v")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _distinct(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    pulled = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _distinct(pulled.unionAll(low.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of edges (u, v; long) but the smallest of its component, that smallest node.

    Each round is a few shuffles of the edges, written to the shared folder; their number is logarithmic. Nodes without
    edges, loops and null ends give no row; repeated edges count once.
    """
    edges = cut(_distinct(edges.where("u is not null and v is not null").select("u", "v")), "edges")
    state = None
    for _ in range(most_rounds):
        edges = cut(_small(cut(_large(edges), "large")), "small")
        r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).first()
        if state == (state := (r["n"], r["h"], r["s"])):
            break
    else:
        raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
