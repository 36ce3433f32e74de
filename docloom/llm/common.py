"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8; null has none.

    bytes.lower() and bytes.split() know ASCII only, which is the definition wanted here.
    """
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(column: str, m: int) -> Column:
    """crc32 of a column as text, modulo m; null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def n_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, local mode takes a temporary one; elsewhere that is an error,
    as other machines don't see such a folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jsc = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jsc.get() if jsc.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="docloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    release()
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete a table that cut has written and that nothing reads any more: all that needs it is worked out or written."""
    spark = df.sparkSession
    if files := df.inputFiles():
        folder = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release() -> None:
    """Give free memory back to the system. Workers live through many tasks, and each would keep its largest task's memory."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    pa.default_memory_pool().release_unused()


def keep_memory() -> None:
    """Let this process reuse freed blocks of up to 100 MB instead of asking the system for fresh pages each time (release gives
    them back). Steps that make and drop the same arrays over and over take a third less time so."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-1, 100 << 20)  # trim threshold
        libc.mallopt(-3, 32 << 20)  # mmap threshold, the most that is allowed


def map_texts(df: DataFrame, text: str, fields: list[tuple[str, T.DataType]], make: Callable[[], Callable[[list], list[pa.Array]]], rows: int = 256) -> DataFrame:
    """df with new columns worked out from texts, `rows` of them at a time whatever the batches' size. `make` sets up in each task
    a function from a list of texts to an Arrow array for each field. Columns of df with a new name are replaced; all others pass
    as they are, whatever their types and nulls."""
    df = df.drop(*[name for name, _ in fields])
    out = T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in fields]])
    names = [f.name for f in out.fields]
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                yield pa.RecordBatch.from_arrays([*part.columns, *f(part.column(at).to_pylist())], names=names)
        release()

    return df.mapInArrow(run, out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all k-grams of an integer array: a polynomial hash put together from powers of two, then mixed."""
    n = len(symbols) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base, h, done = 0x9E3779B97F4A7C15, None, 0
    part, width, mult = symbols.astype(np.uint64) + np.uint64(1), 1, base
    rest = k
    while rest:
        if rest & 1:
            if h is None:
                h, done = part, width
            else:  # h covers done symbols, part covers width after them
                m = len(h) - width
                h, done = h[:m] * np.uint64(mult) + part[done : done + m], done + width
        rest >>= 1
        if rest:
            m = len(part) - width
            part, width, mult = part[:m] * np.uint64(mult) + part[width : width + m], 2 * width, mult * mult & 0xFFFFFFFFFFFFFFFF
    return mix64(h[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w."""
    n = len(x) - w + 1
    width = 1
    while 2 * width <= w:
        x, width = np.minimum(x[: len(x) - width], x[width:]), 2 * width
    return np.minimum(x[:n], x[w - width : w - width + n])


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the minimum of each window of w hashes, the rightmost of equals, each once, ascending.

    Hashes are compared by their upper 40 bits. Long arrays are cut into overlapping pieces, so positions always fit the other 24.
    """
    piece, found = 1 << 22, []
    low = np.uint64((1 << 24) - 1)
    if not len(h):
        return np.empty(0, np.int64)
    w = min(w, len(h))
    for at in range(0, len(h) - w + 1, piece):
        x = h[at : at + piece + w - 1]
        key = (x & ~low) | (low - np.arange(len(x), dtype=np.uint64))
        best = sliding_min(key, w)
        keep = np.empty(len(best), bool)
        keep[0] = True
        np.not_equal(best[1:], best[:-1], out=keep[1:])
        found.append((low - (best[keep] & low)).astype(np.int64) + at)
    return found[0] if len(found) == 1 else np.unique(np.concatenate(found))
