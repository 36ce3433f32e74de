"""Chat formatting of logged conversations: snapshots that longer ones extend collapse, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.common import cut

#: How a turn is written.
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def snapshots(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with `pos` (from 1), `h1` and `h2`: two 64-bit hashes of the prefix up to this turn.

    A prefix's hash is the exclusive or of its turns' hashes, each salted with its place. Turns stand by turn number, null
    first; equal numbers by role, then text. Null roles and texts differ from empty ones.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select("conv_id", "turn", "role", "text").withColumn("pos", F.row_number().over(order))
    one = [F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", F.bit_xor(F.xxhash64(F.lit(k), *one)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): the conversations that no longer one begins with, the smallest conv_id of equal ones.

    Equal conversations become one row in an aggregate before any join, and so do equal prefixes: the anti-join has a row
    for each distinct key on both sides. Turns with a null conv_id belong to no conversation and are left out.
    """
    rows = snapshots(turns.where("conv_id is not null"))
    longest = Window.partitionBy("conv_id")
    rows = cut(rows.withColumn("n_turns", F.max("pos").over(longest)).select("conv_id", "pos", "n_turns", "h1", "h2"), "prefixes")
    full = rows.where("pos = n_turns").groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    begun = rows.where("pos < n_turns").groupBy("h1", "h2", "pos").agg(F.count(F.lit(1)).alias("_n")).select("h1", "h2", F.col("pos").alias("n_turns"))
    return full.join(begun, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns", "n_copies")


def render(turns: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(conv_id, n_turns, n_copies, chat): each maximal conversation in one text, turn by turn, between markers.

    Null roles and texts are written as empty. Repeated turns stay. Columns of turns beyond the four are not read.
    """
    kept = maximal(turns) if kept is None else kept
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = turns.select("conv_id", "turn", "role", "text").join(kept, "conv_id").withColumn("pos", F.row_number().over(order))
    said = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit(MIDDLE), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    chats = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("pos", said.alias("said")))).alias("_t"))
    return chats.select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.col("_t.said")).alias("chat"))


def op4_chat(spark: SparkSession, turns: DataFrame) -> DataFrame:
    return render(turns).select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_copies", F.octet_length("chat").cast("long").alias("n_bytes"), F.sha2(F.col("chat").cast("binary"), 256).alias("chat_sha256"))


ORACLE = """
WITH t AS (
  SELECT conv_id, row_number() OVER w AS pos,
         coalesce('r' || length(role) || ':' || role, 'n') || coalesce('t' || length(text) || ':' || text, 'n') AS turn_key,
         '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS said
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)),
p AS (
  SELECT conv_id, pos, max(pos) OVER (PARTITION BY conv_id) AS n_turns,
         string_agg(turn_key, '|') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM t),
f AS (SELECT prefix, n_turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n_turns GROUP BY prefix, n_turns),
m AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n_turns AND p.pos = f.n_turns AND p.prefix = f.prefix)),
c AS (SELECT conv_id, string_agg(said, '' ORDER BY pos) AS chat FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, n_copies, CAST(strlen(chat) AS BIGINT) AS n_bytes, sha256(chat) AS chat_sha256
FROM m JOIN c USING (conv_id)
"""
