"""SimHash near-duplicates, with candidate keys from the binary Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import cut, map_texts, n_parts, words_of
from docloom.llm.components import components

#: Fixed value: generator polynomial x^11+x^9+x^7+x^6+x^5+x+1 of the [23,12,7] Golay code.
GOLAY = 0b101011100011
#: 64 bits in three segments: first bit and length. The last is padded with zeros to 23.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: The number of differing bits that the keys are made for.
LINK = 2


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text's word shingles, repeats included; texts without words get 0."""
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate((np.zeros(1, np.int64), ends[:-1] + 1))
    h64 = xxhash.xxh64_intdigest
    h = np.fromiter((h64(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp): fp has the 64 bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    make = lambda: lambda texts: [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]
    return map_texts(rows, "text", [("fp", T.LongType())], make).drop("text")


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For each 11-bit syndrome, the error word of weight 3 or less; and for each the errors of weight 4, as a matrix padded with -1."""
    words = {n: np.array([sum(1 << b for b in bits) for bits in combinations(range(23), n)], np.int64) for n in range(5)}
    lead = np.zeros(1 << 11, np.int64)
    for n in range(4):
        lead[_syndrome(words[n])] = words[n]
    four = words[4]
    s = _syndrome(four)
    order = np.argsort(s, kind="stable")
    four, s = four[order], s[order]
    first = np.searchsorted(s, np.arange(1 << 11))
    far = np.full((1 << 11, np.diff(np.append(first, len(s))).max()), -1, np.int64)
    far[s, np.arange(len(s)) - first[s]] = four
    return lead, far


def _syndrome(x: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        x = x ^ np.where((x >> bit) & 1, GOLAY << (bit - 11), 0)
    return x


def near_codewords(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codeword indices (12 bits) of all codewords within four bits of the 23-bit words x.

    The code is perfect: one codeword is within three bits of any word. Words that differ in one bit share a codeword
    here, as the one that decodes the first is within four bits of the second.
    """
    lead, far = _golay()
    s = _syndrome(x.astype(np.int64))
    words = np.concatenate((lead[s][:, None], far[s]), axis=1)
    row, col = np.nonzero(words >= 0)
    return row, (x[row] ^ words[row, col]) >> 11


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys. Two bits that differ leave, going round three segments, one segment equal whose next differs in one bit at most."""
    u, rows, keys = fp.view(np.uint64), [], []
    part = [((u >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    for i in range(3):
        row, code = near_codewords(part[(i + 1) % 3])
        rows.append(row)
        keys.append((np.int64(i) << 60) | (part[i][row] << 16) | code)
    return np.concatenate(rows), np.concatenate(keys)


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def links_in_group(fp: np.ndarray, most: int = LINK) -> list[tuple[int, int]]:
    """Row pairs that span the components of distinct fingerprints under `most` differing bits: fewer pairs than rows.

    Small groups compare each row with all; large ones look up each fingerprint's 2,080 neighbours, so time stays linear.
    """
    n, top = len(fp), np.arange(len(fp))

    def find(a: int) -> int:
        while top[a] != a:
            top[a] = top[top[a]]
            a = top[a]
        return a

    found, order = [], np.argsort(fp)
    ordered = fp[order]
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate((one, one[i] ^ one[j]))
    for a in range(n):
        if n <= 2081:
            near = a + 1 + np.flatnonzero(_bits(fp[a] ^ fp[a + 1 :]) <= most)
        else:
            want = (fp[a].view(np.uint64) ^ flips).view(np.int64)
            at = np.minimum(np.searchsorted(ordered, want), n - 1)
            near = order[at[ordered[at] == want]]
        for b in near.tolist():
            x, y = find(a), find(b)
            if x != y:
                top[max(x, y)] = min(x, y)
                found.append((a, b))
    return found


def _key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        fp, rep = pdf["fp"].to_numpy(np.int64), pdf["rep"].to_numpy(np.int64)
        for at in range(0, len(fp), 20_000):
            row, key = keys_of(fp[at : at + 20_000])
            yield pd.DataFrame({"key": key, "fp": fp[at + row], "rep": rep[at + row]})


def _link_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches sorted by key; the last key of a batch waits for the next batch, in pieces that are put together once."""
    kept: list[pd.DataFrame] = []

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        key, fp, rep = (pdf[c].to_numpy(np.int64) for c in ("key", "fp", "rep"))
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
        end = np.append(start[1:], len(key))
        u, v = [], []
        size = end - start
        two = start[size == 2]  # most groups
        two = two[_bits(fp[two] ^ fp[two + 1]) <= LINK]
        u.append(rep[two]), v.append(rep[two + 1])
        for a, b in zip(start[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            if got := links_in_group(fp[a:b]):
                i = np.array(got) + a
                u.append(rep[i[:, 0]]), v.append(rep[i[:, 1]])
        return pd.DataFrame({"u": np.concatenate(u), "v": np.concatenate(v)})

    for pdf in batches:
        if not len(pdf):
            continue
        if kept and kept[0]["key"].iloc[0] == pdf["key"].iloc[-1]:  # all of it goes on with the key that waits
            kept.append(pdf)
            continue
        whole = pd.concat((*kept, pdf), ignore_index=True)
        at = int(np.searchsorted(whole["key"].to_numpy(), whole["key"].iloc[-1]))
        kept = [whole.iloc[at:]]
        yield pairs(whole.iloc[:at])
    if kept:
        yield pairs(pd.concat(kept, ignore_index=True))


def near_duplicates(docs: DataFrame, shingle: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs: component_id is the smallest doc_id that links of LINK bits or fewer reach.

    Equal fingerprints become one row before candidates are sought, so large groups of copies make no pairs. Groups under
    a key hold distinct fingerprints only and give back a spanning set of links, never all pairs. Null and empty texts have
    fingerprint 0 and link like others. Rows with a null doc_id keep a row; where no other id is reachable, their
    component_id is null. Repeated rows stay. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    fps = cut(fingerprints(docs, shingle, text), "fps")
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "reps")
    keyed = reps.mapInPandas(_key_rows, "key long, fp long, rep long")
    edges = keyed.repartition(n_parts(spark), "key").sortWithinPartitions("key").mapInPandas(_link_rows, "u long, v long")
    found = components(edges)
    classes = reps.join(found, reps["rep"] == found["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(classes, "fp", "left").select("doc_id", "fp", "component_id")


def op7_simhash(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
