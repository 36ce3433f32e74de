"""JSON Lines as a stream: the batch functions over Structured Streaming, with event time, state and sinks from Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docloom.config import DEFAULT, Config
from docloom.sources.jsonl import _wanted, good, with_values


def read_stream(spark: SparkSession, path: str, config: Config = DEFAULT, files_per_trigger: int | None = None) -> DataFrame:
    """(value, v, error) of each line of files that appear in a folder."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return with_values(reader.load(path).where(_wanted(F.col("value"), config)), config)


def windowed(stream: DataFrame, time: Column, late: str, window: str, by: list[Column], aggs: list[Column], slide: str | None = None) -> DataFrame:
    """Aggregates by event-time windows; rows later than `late` are dropped and finished windows leave the state."""
    timed = good(stream).withColumn("event_time", time).withWatermark("event_time", late)
    span = F.window("event_time", window, slide) if slide else F.window("event_time", window)
    return timed.groupBy(span.alias("window"), *by).agg(*aggs)


def for_each_batch(stream: DataFrame, f: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a function on each micro-batch, once for all that is there; the checkpoint makes it go on where it stopped."""
    return stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stream(stream: DataFrame, path: str, checkpoint: str, column: str = "value") -> StreamingQuery:
    """A column of JSON text as files of JSON Lines."""
    return stream.select(F.col(column)).writeStream.format("text").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
