"""JSON Lines and whole JSON files as DataFrames, and back."""

from __future__ import annotations

import os
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.config import DEFAULT, Config
from docloom.errors import INVALID_JSON, SIZE_LIMIT
from docloom.functions.columns import json_valid, variant

LINE_ERROR = "line_error"


def _wanted(value, config: Config):
    """Lines that count: not empty, not comments (# or //), if the configuration skips these."""
    bare = F.trim(value)
    keep = F.lit(True)
    if config.skip_empty:
        keep = keep & (bare != "")
    if config.skip_comments:
        keep = keep & ~bare.startswith("#") & ~bare.startswith("//")
    return keep


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_num, value): the lines of text files, numbered from 1 in each file.

    Files are split between tasks; a split's lines are numbered in it, and the number of lines before a split is a running sum
    over splits. So no file is sorted or read by one task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"))
    lines = lines.withColumn("_at", F.monotonically_increasing_id())
    inside = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_at"))
    counts = lines.groupBy("file", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("file", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    numbered = lines.withColumn("_i", inside).join(starts, ["file", "_block"])
    return numbered.select("file", (F.col("_before") + F.col("_i")).alias("line_num"), "value")


def read_jsonl(spark: SparkSession, path: str, config: Config = DEFAULT, objects_only: bool = False) -> DataFrame:
    """(file, line_num, value, v, error): JSON Lines, v as VARIANT. Lines that are too long, aren't JSON or (with objects_only) no
    objects have an error and no v; `strict` stops at them and `good` leaves them out."""
    lines = read_lines(spark, path).where(_wanted(F.col("value"), config))
    return with_values(lines, config, objects_only)


def with_values(lines: DataFrame, config: Config = DEFAULT, objects_only: bool = False) -> DataFrame:
    """lines with `v` and `error`, for streams as well."""
    parsed = lines.withColumn("v", variant("value"))
    error = F.when(F.octet_length("value") > config.max_line, SIZE_LIMIT).when(~json_valid("value", config), INVALID_JSON)
    if objects_only:
        error = error.when(~F.schema_of_variant("v").startswith("OBJECT"), "NOT_AN_OBJECT")
    parsed = parsed.withColumn("error", error)
    return parsed.withColumn("v", F.when(F.col("error").isNull(), F.col("v")))


def good(lines: DataFrame) -> DataFrame:
    """Lines without error: reading that goes on after errors."""
    return lines.where("error is null").drop("error")


def strict(lines: DataFrame) -> DataFrame:
    """Lines, with a failure at the first bad one that is met; it names the line."""
    said = F.concat(F.lit("line "), F.col("line_num").cast("string"), F.lit(": "), F.col("error"))
    return lines.withColumn("line_num", F.when(F.col("error").isNotNull(), F.raise_error(said).cast("bigint")).otherwise(F.col("line_num"))).drop("error")


def parse_jsonl(df: DataFrame, text: str, config: Config = DEFAULT) -> DataFrame:
    """df with `line_num` and `value` for the lines of a text column that count."""
    lines = df.select(*df.columns, F.posexplode(F.split(F.col(text), "\n")).alias("line_num", "value"))
    return lines.withColumn("line_num", F.col("line_num") + 1).where(_wanted(F.col("value"), config))


def read_into(spark: SparkSession, path: str, schema: str | T.StructType, continue_on_error: bool = False) -> DataFrame:
    """JSON Lines as typed rows, by Spark's own reader: lines that don't fit are left out, or stop the job."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if continue_on_error else "FAILFAST").json(path)


def load_file(spark: SparkSession, path: str, config: Config = DEFAULT) -> DataFrame:
    """(file, value, error): whole JSON files. Those over the size limit have an error and no value; `good` leaves them out."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    large = F.octet_length("value") > config.max_json_size
    return whole.select("file", F.when(~large, F.col("value")).alias("value"), F.when(large, F.lit(SIZE_LIMIT)).alias("error"))


def load_typed(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole JSON files as typed rows, one for each object or element of a root array."""
    return spark.read.schema(schema).json(path, multiLine=True)


def load_text(spark: SparkSession, text: str) -> DataFrame:
    """(value): a document that the driver has."""
    return spark.createDataFrame([(text,)], "value string")


def write_jsonl(df: DataFrame, path: str, column: str | None = None, mode: str = "error") -> None:
    """Rows as JSON Lines: a column of JSON text, or the whole row."""
    lines = df.select(F.col(column)) if column else df.select(F.to_json(F.struct(*df.columns)))
    lines.write.mode(mode).text(path)


def jsonl_stats(df: DataFrame, column: str) -> DataFrame:
    """(lines, bytes): what write_jsonl writes of a column."""
    return df.where(F.col(column).isNotNull()).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length(column) + 1).alias("bytes"))


def to_jsonl(df: DataFrame, by: list[str], order: str, column: str) -> DataFrame:
    """(by, jsonl): each group's documents as one text, line by line."""
    lists = df.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(order, column))).alias("_l"))
    return lists.select(*by, F.concat(F.array_join(F.col(f"_l.{column}"), "\n"), F.lit("\n")).alias("jsonl"))


def allowed_path(path: str, roots: list[str]) -> bool:
    """Whether a path without . and .. steps lies under one of the roots: a check for paths that users give."""
    if "\0" in path or any(x in path.lower() for x in ("%2e", "%2f", "%5c", "%00")):
        return False
    whole = PurePosixPath(os.path.normpath(path))
    return ".." not in PurePosixPath(path).parts and any(whole.is_relative_to(os.path.normpath(r)) for r in roots)
