"""Document fingerprints by winnowing: k-gram hashes, the minimum of each window, and its place."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import gram_hashes, map_texts, n_parts, window_minima

#: Characters of a gram and grams of a window: any common passage of K + W - 1 = 32 characters shares a fingerprint.
K, W = 16, 17


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


def winnow(symbols: np.ndarray, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the fingerprints of a text, ascending by position.

    Of each window of w k-grams the one of the smallest hash (by its upper 40 bits) is chosen, the rightmost of equals.
    Equal passages of k + w - 1 symbols so choose an equal gram at the same place in them. A text with fewer grams than w
    is one window; one shorter than k has one fingerprint, of the whole, at 0; an empty one has none.
    """
    if len(symbols) < k:
        if not len(symbols):
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        return np.zeros(1, np.int64), np.array([xxhash.xxh64_intdigest(symbols.tobytes())], np.uint64)
    h = gram_hashes(symbols, k)
    at = window_minima(h, w)
    return at, h[at]


def digest(at: np.ndarray, h: np.ndarray) -> str:
    return hashlib.blake2b(at.astype("<i8").tobytes() + h.astype("<u8").tobytes(), digest_size=16).hexdigest()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted sets of hashes; two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprint_documents(docs: DataFrame, k: int = K, w: int = W, text: str = "text") -> DataFrame:
    """docs with `positions` (array<long>) and `hashes` (array<long>, the 64 bits signed). Null texts count as empty; rows are
    handled alone and repeated rows stay. Columns of docs with these names are replaced."""
    longs = T.ArrayType(T.LongType())

    def make():
        def run(texts: list[str | None]) -> list[pa.Array]:
            found = [winnow(code_points(t), k, w) for t in texts]
            return [pa.array([x.view(np.int64) for x in column], pa.list_(pa.int64())) for column in zip(*found, strict=True)]

        return run

    return map_texts(docs, text, [("positions", longs), ("hashes", longs)], make)


def runs_of_neighbours(docs: DataFrame, text: str = "text", docs_per_run: int = 500, most_runs: int = 20_000) -> DataFrame:
    """Rows (run, own, doc_id, text), dealt by run and sorted: a run's rows by doc_id then text, and after them (own = false)
    the first row of the next run. After the last run comes the first.

    Runs begin at doc_ids that stand in the data: of those that a hash picks, 8 for each run, every eighth. These whole numbers
    are all that comes to the driver; a text is shuffled once. Rows with a null doc_id are left out.
    """
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    n, low = rows.agg(F.count(F.lit(1)), F.min("doc_id")).first()
    runs = max(1, min(most_runs, -(-n // docs_per_run)))
    picked = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (8 * runs)))) == 0
    found = [r["doc_id"] for r in rows.where(picked).groupBy("doc_id").agg(F.count(F.lit(1))).select("doc_id").collect()] if runs > 1 else []
    starts = np.array([x for x in sorted(found)[7::8] if x != low], np.int64)

    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        """Twice the run's number, and 1 more where a run begins."""
        x = ids.to_numpy(np.int64)
        run = np.searchsorted(starts, x, side="right")
        begins = np.where(run > 0, starts[np.maximum(run - 1, 0)] == x if len(starts) else False, x == low)
        return pd.Series(2 * run + begins)

    at = rows.withColumn("_p", place("doc_id")).withColumn("run", F.floor(F.col("_p") / 2))
    before = F.when(F.col("run") > 0, F.col("run") - 1).otherwise(F.lit(len(starts)).cast("long"))
    here = F.struct(F.col("run").alias("run"), F.lit(True).alias("own"))
    both = F.when(F.col("_p") % 2 == 1, F.array(here, F.struct(before.alias("run"), F.lit(False).alias("own")))).otherwise(F.array(here))
    at = at.select("doc_id", "text", F.explode(both).alias("_r")).select("_r.run", "_r.own", "doc_id", "text")
    return at.repartition(n_parts(docs.sparkSession), "run").sortWithinPartitions("run", F.col("own").desc(), "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many, or all, of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_fingerprints long"


def _row(doc_id, text: str, mine, following: str, other, k: int, w: int) -> tuple:
    changed = edited(text, following)
    at, h = winnow(code_points(changed), k, w)
    own = np.unique(mine[1])
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, digest(*mine), digest(at, h), likeness(own, np.unique(h)), likeness(own, np.unique(other[1])), len(mine[0])


def compare_neighbours(docs: DataFrame, k: int = K, w: int = W, text: str = "text") -> DataFrame:
    """For each row: its fingerprints against those of its edited text (see edited) and of the next row by doc_id, then text.

    Null texts count as empty. After the last row comes the first. Rows with a null doc_id stand in no order: they come out
    with an empty next text. Repeated rows stay, each the neighbour of the one before. An empty table gives an empty table.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, out = None, []  # the own row that waits for its next one: (run, doc_id, text, fingerprints)
        for pdf in batches:
            for r, own, doc_id, t in zip(pdf["run"], pdf["own"], pdf["doc_id"], pdf["text"], strict=True):
                same = held is not None and held[0] == r
                if not own and not same:
                    continue  # another row of the id that begins the next run
                t = t or ""
                now = winnow(code_points(t), k, w)
                if same:
                    out.append(_row(held[1], held[2], held[3], t, now, k, w))
                held = (r, doc_id, t, now) if own else None
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _COLUMNS.split(", ")])
            out = []

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        empty = np.empty(0, np.int64), np.empty(0, np.uint64)
        for pdf in batches:
            rows = [_row(None, t or "", winnow(code_points(t), k, w), "", empty, k, w) for t in pdf["text"]]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _COLUMNS.split(", ")]).astype({"doc_id": "Int64"})

    ordered = runs_of_neighbours(docs, text).mapInPandas(run, _COLUMNS)
    return ordered.unionAll(docs.where("doc_id is null").select(F.col(text).alias("text")).mapInPandas(alone, _COLUMNS))


def op1_winnow(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return compare_neighbours(docs)
