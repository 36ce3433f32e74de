"""A corpus pipeline over documents: each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, mixing, similar, substrings, toxicity
from docloom.llm.common import cut


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list]:
    """docs with columns of an operator's own names renamed, and what selects the columns of docs again."""
    moved = {c: f"_own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(moved), [F.col(moved.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (learnt from the labels of these documents) doesn't predict to be toxic."""
    model = toxicity.train_from_tables(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows, back = _aside(docs, "score", "predicted")
    return toxicity.score_documents(rows, model).where("predicted = 0").select(*back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of 5-word shingles with a likeness of 0.8 or more make (found by SimHash and Golay keys,
    verified exactly): that of the smallest doc_id, then of the smallest hash of the row. Rows of equal or null doc_id are told apart; a null doc_id comes last."""
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = rows.join(similar.groups(rows).withColumnRenamed("node", "_row"), "_row")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*docs.columns), "_row")
    keep = found.groupBy("component").agg(F.min(order).alias("first")).select("first._row")
    return rows.join(keep, "_row", "left_semi").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what a document of a smaller doc_id has; n_chars follows. Documents of which nothing is left stay, empty."""
    rows, back = _aside(docs, "kept", "n_bytes", "n_removed", "spans")
    found = substrings.cut_repeats(rows, in_place=True)
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars")).cast("long")).select(*back)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: the words taken over its size, rounded, so that documents stay whole. Only
    the documents at the two ends of a shard's run are taken in part. Documents without words have no part in a mix."""
    taken = mixing.mix(docs, whole=True)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(F.lit(0)).cast("int")
    return taken.withColumn("_times", times).where("_times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit integers), their number, and digests of them and of the decoded bytes."""
    import public_tokenizers

    found = bpe.encode_documents(docs, public_tokenizers.path(bpe.RANKS), public_tokenizers.PATTERN)
    n = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return found.select(*docs.columns, "ids", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeated_passages),
    ("source mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: The first stage trains a model, which SQL can't express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on documents; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
    return docs
