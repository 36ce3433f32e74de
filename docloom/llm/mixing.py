"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks, by DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import WORD, cut

#: Words in a block.
BLOCK = 64
#: A shard has about so many documents, however large its source.
SHARD_DOCS = 4_096
#: No source gets more than so many times its size, and no document.
MOST = 3
#: A multiplicative order of documents, modulo a prime, that SQL engines share. Products stay under 2^63.
MODULUS, FACTOR = 2_147_483_647, 48_271


def size_of(text: str = "text") -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(column: Column, seed: int) -> Column:
    """A number below MODULUS for an integer, the same on every run; null counts as -1."""
    x = F.pmod(F.coalesce(column.cast("long"), F.lit(-1).cast("long")), F.lit(MODULUS).cast("long"))
    once = F.pmod(x * FACTOR + F.lit(seed * 7_919 + 1), F.lit(MODULUS).cast("long"))
    return F.pmod(once * 69_621 + F.shiftrightunsigned(once, 11), F.lit(MODULUS).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = MOST) -> DataFrame:
    """(source, source_size, docs) with `target`: sources by code point, null last, weigh `weights` in turn and share the sum
    of all sizes. A target stops at `most` times the source's size; the excess goes to the others by weight, until none is above.

    A source is full where the level (words for each unit of weight) reaches most*size/weight. Sources sorted by that ratio
    fill up in this order, so sums before and after each give the level at once. The table has a row for each source.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    one = Window.orderBy(F.col("source").asc_nulls_last())
    t = sizes.withColumn("nth", F.row_number().over(one)).withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by = Window.orderBy("ratio", "nth")
    t = t.withColumn("ratio", F.col("cap") / F.col("weight"))
    t = t.withColumn("cap_before", F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("weight_from", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    t = t.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_from"))
    t = t.withColumn("place", F.row_number().over(by))
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("place", "level"))).over(Window.partitionBy())["level"]
    return t.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).select("source", "source_size", "docs", "target")


def _quotient_rank(t: DataFrame, group: list[str], share: str, seats: str, tie: list[str]) -> DataFrame:
    """t with `quota`: `seats` (the same in all rows of a group) dealt by the highest quotients share/(2q+1).

    With n rows, rounding share/d misses the number of seats by n/2 at most. So what a divisor n/2 seats too large gives out
    is certain, and the seats still open are fought for by at most a few quotients of each row, which are ranked.
    """
    g = Window.partitionBy(*group)
    t = t.withColumn("_sum", F.sum(share).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
    scaled = lambda m: F.when(F.col("_sum") > 0, F.col(share) * m / F.col("_sum")).otherwise(F.lit(0.0))
    low = F.greatest(F.floor(scaled(F.greatest(F.col(seats) - F.col("_n") / 2 - 1, F.lit(0.0))) + 0.5), F.lit(0))
    high = F.floor(scaled(F.col(seats) + F.col("_n") / 2 + 1) + 0.5)
    t = t.withColumn("_low", low.cast("long")).withColumn("_high", F.greatest(high, low).cast("long"))
    t = t.withColumn("_open", F.col(seats) - F.sum("_low").over(g))
    fought = t.where("_high > _low").withColumn("_q", F.explode(F.sequence(F.col("_low"), F.col("_high") - 1)))
    fought = fought.withColumn("_quot", F.col(share) / (2 * F.col("_q") + 1))
    ranked = fought.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("_quot").desc(), *tie, "_q")))
    keys = [*group, *tie]
    won = ranked.where("_rank <= _open").groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    same = None
    won = won.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_won")
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        same = c if same is None else same & c
    out = t.join(won, same, "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0)))
    return out.drop("_sum", "_n", "_low", "_high", "_open", "_won", *[f"_k_{k}" for k in keys])


def mix(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    block: int = BLOCK,
    seed: int = 1,
    shard_docs: int = SHARD_DOCS,
    text: str = "text",
    whole: bool = False,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, source_quota, shard, taken) for every row of docs.

    Sources get whole blocks of `block` words by Sainte-Laguë from their targets, and shards of a source (documents by a
    seeded hash of doc_id, about shard_docs each) by Sainte-Laguë from their words. A shard's documents stand one after the
    other in a seeded order, in a ring. Its quota is so many rounds and then a run of blocks from a seeded place on; `taken`
    is the document's words in them. A document gives MOST times its size at the most, as a shard's quota stops there.

    Null texts have size 0, and null sources are a source. Rows with a null doc_id and rows of equal doc_id share a shard and
    stand in the order of their size. A hot source has the more shards, so no window holds more than about shard_docs rows.
    Reruns agree. An empty table gives an empty table. whole: each row's own
    columns come along as the struct `row`.
    """
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    base = cut(docs.select("doc_id", "source", *row, size_of(text).alias("size")), "sizes")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    t = targets(sizes, weights).withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    t = t.withColumn("_all", F.lit(0))
    quotas = _quotient_rank(t, ["_all"], "target", "blocks", ["source"]).withColumnRenamed("quota", "source_quota")
    quotas = cut(quotas.withColumn("shards", F.ceil(F.col("docs") / shard_docs).cast("long")).select("source", "source_size", "target", "source_quota", "shards"), "quotas")

    q = quotas.withColumnRenamed("source", "_source")
    rows = base.join(F.broadcast(q) if _small(quotas) else q, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("shard", F.pmod(seeded(F.col("doc_id"), seed), F.col("shards")))
    shards = rows.groupBy("source", "shard", "source_quota").agg(F.sum("size").alias("shard_size"))
    shards = _quotient_rank(shards, ["source"], "shard_size", "source_quota", ["shard"])
    shards = shards.withColumn("words", F.least(F.col("quota") * block, F.col("shard_size") * MOST)).select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "words")

    shards = cut(shards, "shards")
    rows = rows.join(F.broadcast(shards) if _small(shards) else shards, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard"))).drop("_source", "_shard")
    order = Window.partitionBy("source", "shard").orderBy(seeded(F.col("doc_id"), seed + 1), F.col("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    z = F.col("shard_size")
    rows = rows.withColumn("_to", F.sum("size").over(order)).withColumn("_from", F.col("_to") - F.col("size"))
    rest = F.when(z > 0, F.col("words") - F.col("_rounds") * z).otherwise(F.lit(0))
    rows = rows.withColumn("_rounds", F.when(z > 0, F.floor(F.col("words") / z)).otherwise(F.lit(0)).cast("long"))
    n_blocks = F.greatest(F.floor((z + (block - 1)) / block), F.lit(1))
    rows = rows.withColumn("_start", F.least(F.pmod(seeded(F.col("shard") + F.col("source_size"), seed + 2), n_blocks) * block, z)).withColumn("_end", F.col("_start") + rest)
    overlap = lambda a, b: F.greatest(F.least(F.col("_to"), b) - F.greatest(F.col("_from"), a), F.lit(0))
    first, wrapped = overlap(F.col("_start"), F.least(F.col("_end"), z)), overlap(F.lit(0), F.col("_end") - z)
    taken = F.col("_rounds") * F.col("size") + first + wrapped
    return rows.select("doc_id", "source", *["row"] * whole, "size", "source_size", "target", "source_quota", "shard", taken.cast("long").alias("taken"))


def _small(df: DataFrame, most: int = 20_000) -> bool:
    """Whether a table of a few numbers a row has so few rows that it may be broadcast."""
    return df.limit(most + 1).count() <= most


def op5_mix(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same by definition: every quotient of every source and shard is listed and ranked.
ORACLE = """
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sizes AS (
  SELECT source, sum(size)::DOUBLE AS source_size, count(*) AS docs,
         3 * sum(size)::DOUBLE AS cap, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM base GROUP BY source),
filled AS (
  SELECT *, row_number() OVER o AS place,
         ((SELECT sum(source_size) FROM sizes) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sizes WINDOW o AS (ORDER BY cap / weight, nth)),
goal AS (
  SELECT source, nth, source_size, docs,
         least(cap, weight * (SELECT arg_min(level, place) FROM filled WHERE level <= cap / weight)) AS target FROM filled),
seats AS (SELECT CAST(round(sum(target) / 64) AS BIGINT) AS n FROM goal),
dealt AS (
  SELECT nth, row_number() OVER (ORDER BY target / (2 * q + 1) DESC, nth, q) AS r
  FROM goal, seats, generate_series(0, seats.n) AS g(q) WHERE target > 0),
quota AS (SELECT nth, count(*) AS source_quota FROM dealt, seats WHERE r <= seats.n GROUP BY nth),
rows_ AS (
  SELECT b.doc_id, b.size, g.nth, g.source_size, g.target, coalesce(k.source_quota, 0) AS source_quota,
         ((x.p * 48271 + 7920) % 2147483647) AS u1, ((x.p * 48271 + 15839) % 2147483647) AS u2,
         CAST(ceil(g.docs / 4096) AS BIGINT) AS shards
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source LEFT JOIN quota k ON k.nth = g.nth,
       LATERAL (SELECT ((coalesce(b.doc_id, -1) % 2147483647) + 2147483647) % 2147483647 AS p) x),
placed AS (
  SELECT *, ((u1 * 69621 + (u1 >> 11)) % 2147483647) % shards AS shard, (u2 * 69621 + (u2 >> 11)) % 2147483647 AS turn FROM rows_),
shards AS (SELECT nth, shard, any_value(source_quota) AS source_quota, any_value(source_size) AS source_size, CAST(sum(size) AS BIGINT) AS z FROM placed GROUP BY nth, shard),
shard_dealt AS (
  SELECT nth, shard, source_quota, row_number() OVER (PARTITION BY nth ORDER BY z / (2 * q + 1) DESC, shard, q) AS r
  FROM shards, generate_series(0, (SELECT max(source_quota) FROM shards)) AS g(q) WHERE z > 0),
shard_quota AS (SELECT nth, shard, count(*) AS quota FROM shard_dealt WHERE r <= source_quota GROUP BY nth, shard),
ring AS (
  SELECT s.nth, s.shard, s.z, least(coalesce(k.quota, 0) * 64, 3 * z) AS words,
         (((s.shard + CAST(s.source_size AS BIGINT)) % 2147483647) * 48271 + 23758) % 2147483647 AS u3,
         greatest((s.z + 63) // 64, 1) AS blocks
  FROM shards s LEFT JOIN shard_quota k ON k.nth = s.nth AND k.shard = s.shard),
ring2 AS (
  SELECT *, CASE WHEN z > 0 THEN words // z ELSE 0 END AS rounds, CASE WHEN z > 0 THEN words % z ELSE 0 END AS rest,
         least((((u3 * 69621 + (u3 >> 11)) % 2147483647) % blocks) * 64, z) AS start FROM ring),
stood AS (
  SELECT p.*, r.z, r.rounds, r.rest, r.start,
         CAST(sum(p.size) OVER (PARTITION BY p.nth, p.shard ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto
  FROM placed p JOIN ring2 r ON r.nth = p.nth AND r.shard = p.shard)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(rounds * size + greatest(least(upto, least(start + rest, z)) - greatest(upto - size, start), 0)
         + greatest(least(upto, start + rest - z) - greatest(upto - size, 0), 0) AS BIGINT) AS taken
FROM stood
"""
