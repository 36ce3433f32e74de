"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import crc_mod, map_texts, mix64, release, words_of

#: Size of the hashed feature space, as a power of two.
BITS = 20
#: The bound on labelled documents that the model is fitted on: those with the smallest hashes of doc_id.
TRAIN_DOCS = 12_000
#: Steps of training, about; rows that a feature must be in; steps for each row of label 1, the rarer one.
STEPS, SEEN, POSITIVE_STEPS = 48_000, 3, 2
#: Punctuation taken off both ends of a word.
EDGES = b".,;:!?\"'()[]{}<>|*_-"


class _WordHashes(dict):
    """Word to 64-bit hash, computed once; emptied when it grows large."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w.strip(EDGES))
        return h


def features(text: str | None, cache: _WordHashes, bits: int = BITS) -> np.ndarray:
    """Hashed features of a whole text, repeats included: words, pairs, triples, and pairs that skip one or two words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    found = [h]
    for gap, seed in ((1, 0xA5A5), (2, 0xB6B7), (3, 0xC7C9)):
        if len(h) > gap:
            found.append(h[:-gap] * np.uint64(0x9E3779B97F4A7C15) + h[gap:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(seed))
    if len(h) > 2:
        found.append(h[:-2] * np.uint64(0x165667B19E3779F9) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return (mix64(np.concatenate(found)) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class FTRL:
    """FTRL-proximal: a rate for each coordinate, L1 for sparsity. Slot 2**bits is the bias, which has no L1."""

    bits: int = BITS
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.3
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z, self.n = np.zeros(2**self.bits + 1), np.zeros(2**self.bits + 1)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def bias(self) -> float:
        return float(-self.z[-1] * self.alpha / (self.beta + np.sqrt(self.n[-1])))

    def learn(self, x: np.ndarray, y: int) -> None:
        """One step on the distinct features x of a row."""
        w, b = self.weights(x), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
        if abs(g) < 1e-6:
            return
        n = self.n[x]
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[x] = n + g * g
        n = self.n[-1]
        self.z[-1] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * b
        self.n[-1] = n + g * g


@dataclass
class Model:
    """What scoring needs: the few features whose weights aren't zero."""

    index: np.ndarray
    weight: np.ndarray
    bias: float
    bits: int

    def scorer(self):
        w, cache = np.zeros(2**self.bits, np.float64), _WordHashes()
        w[self.index] = self.weight
        used = w != 0

        def score(text: str | None) -> float:
            x = features(text, cache, self.bits)
            x = np.unique(x[used[x]])
            return float(1 / (1 + np.exp(-np.clip(w[x].sum() + self.bias, -35, 35))))

        return score


def learnt(rows: list[tuple[int, int, bytes]], bits: int, steps: int) -> Model:
    """The model of rows (a hash, label, features as 32-bit numbers), which it empties: about `steps` steps in a fixed order."""
    rows.sort()
    model, seen = FTRL(bits), np.zeros(2**bits, np.int32)
    for _, _, x in rows:
        seen[np.frombuffer(x, "<u4")] += 1
    xs, ys = [], [y for _, y, _ in rows]
    for i in range(len(rows)):
        x = np.frombuffer(rows[i][2], "<u4")
        xs.append(x[seen[x] >= SEEN])
        rows[i] = None  # the filtered copy is enough
    rng = np.random.default_rng(7)
    for _ in range(min(12, max(4, steps // len(xs))) if xs else 0):
        for i in rng.permutation(len(xs)):
            for _ in range(POSITIVE_STEPS if ys[i] else 1):
                model.learn(xs[i], ys[i])
    w, bias = model.weights(slice(0, 2**bits)), model.bias() if xs else 0.0
    index = np.flatnonzero(w)
    return Model(index, w[index].astype(np.float64), bias, bits)


def fit(labelled: DataFrame, bits: int = BITS, steps: int = STEPS) -> Model:
    """Fit on labelled rows (doc_id, text, toxic), of which the caller holds the number down. Rows with a null label are left out.

    One task receives the features of each row, a few KB, and makes all steps; features of fewer than SEEN rows are left out. The
    driver receives the few weights that aren't zero. With no rows every score is 0.5.
    """
    rows = labelled.where(F.col("toxic").isNotNull()).select(F.xxhash64("doc_id", "toxic").alias("k"), (F.col("toxic") > 0).cast("int").alias("y"), "text")

    def make():
        cache = _WordHashes()
        return lambda texts: [pa.array([np.unique(features(t, cache, bits)).astype("<u4").tobytes() for t in texts], pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("k", "y", "x")), strict=True)]
        m = learnt(got, bits, steps)
        yield pa.record_batch([pa.array([m.index.astype("<i8").tobytes()], pa.binary()), pa.array([m.weight.tobytes()], pa.binary()), pa.array([m.bias])], names=["i", "w", "bias"])
        del m
        release()

    found = map_texts(rows, "text", [("x", T.BinaryType())], make).drop("text")
    made = found.repartition(1).mapInArrow(run, "i binary, w binary, bias double").collect()
    i, w, bias = made[0] if made else (b"", b"", 0.0)
    return Model(np.frombuffer(i, "<i8"), np.frombuffer(w, np.float64), bias, bits)


def bounded_labels(labels: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """The labelled rows that fit may learn from: doc_id hash order, train_docs at most, one row for each doc_id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with `score` (0 to 1) and `predicted` (score >= 0.5). Null and empty texts get the bias alone. Rows are handled
    alone, repeated rows stay, and columns of docs named score or predicted are replaced."""

    def make():
        score = model.scorer()

        def run(texts: list[str | None]) -> list[pa.Array]:
            x = np.array([score(t) for t in texts], np.float64)
            return [pa.array(x), pa.array((x >= 0.5).astype(np.int32))]

        return run

    return map_texts(docs, text, [("score", T.DoubleType()), ("predicted", T.IntegerType())], make)


def train_from_tables(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Learn from labels of documents whose crc32(doc_id as text) mod 5 isn't 0: of several rows with one doc_id from the smallest
    text, so that train_docs bounds the rows, too."""
    chosen = bounded_labels(labels.where(crc_mod("doc_id", 5) != 0), train_docs)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # train_docs rows of two numbers at most
    return fit(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def op10_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_documents(docs.select("doc_id", "text"), train_from_tables(docs, labels))
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
