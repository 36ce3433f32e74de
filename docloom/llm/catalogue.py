"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm import bpe, chat, licenses, lm, mixing, simhash, substrings, topk, toxicity, winnow


def _on(table: str, f: Callable, *more: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark, *(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in (table, *more)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_winnow": _on("documents", winnow.op1_winnow),
        "op2_substrings": _on("documents", substrings.op2_substrings),
        "op3_lm": _on("documents", lm.op3_lm),
        "op4_chat": _on("conversations", chat.op4_chat),
        "op5_mix": _on("documents", mixing.op5_mix),
        "op6_topk": _on("embeddings", topk.op6_topk),
        "op7_simhash": _on("documents", simhash.op7_simhash),
        "op8_licenses": _on("documents", licenses.op8_licenses),
        "op9_bpe_codec": _on("documents", bpe.op9_bpe_codec),
        "op10_toxicity": _on("documents", toxicity.op10_toxicity, "labels"),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_substrings": substrings.ORACLE, "op4_chat": chat.ORACLE, "op5_mix": mixing.ORACLE, "op6_topk": topk.ORACLE, "op8_licenses": licenses.ORACLE}
