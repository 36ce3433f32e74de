"""Byte-level BPE: texts to token ids and back, by tiktoken with a local rank file."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import map_texts

RANKS = "byte_bpe_50k.tiktoken"
#: Texts longer than this many characters are cut at safe places.
PIECE = 1 << 16


@lru_cache(2)
def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int) -> Iterator[str]:
    """Cut a long text before single spaces that stand between two non-spaces.

    No match of the pattern goes on across such a space and none looks behind itself, so the pieces' tokens are the text's tokens.
    """
    at, n = 0, len(text)
    while n - at > size:
        p = at + size
        while True:
            p = text.find(" ", p, n - 1)
            if p < 0 or not (text[p - 1].isspace() or text[p + 1].isspace()):
                break
            p += 1
        if p < 0:
            break
        yield text[at:p]
        at = p
    yield text[at:]


@lru_cache(2)
def _matcher(pattern: str):
    return regex.compile(pattern)


def encode_text(text: str | None, enc, pattern: str, size: int = PIECE) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers; null and empty texts have none."""
    if not text:
        return np.empty(0, "<u4")
    if len(text) <= size:
        return np.array(enc.encode_ordinary(text), "<u4")
    ids: list[int] = []
    for piece in safe_pieces(text, size):
        if len(piece) <= 2 * size:
            ids += enc.encode_ordinary(piece)
            continue
        # no safe place for long: match by match, so that no engine's backtracking limit is met
        for m in _matcher(pattern).finditer(piece):
            ids += enc._encode_single_piece(m[0])
    return np.array(ids, "<u4")


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text", decode: bool = True) -> DataFrame:
    """df with `ids` (binary: little-endian unsigned 32-bit integers) and `decoded` (binary: the bytes those ids stand for).

    Rows are handled alone: no shuffle, and repeated rows stay. Null and empty texts have empty ids. Columns of df named
    ids or decoded are replaced. An empty table gives an empty table.
    """

    def make():
        enc = encoding(path, pattern)

        def run(texts: list[str | None]) -> list[pa.Array]:
            ids = [encode_text(x, enc, pattern) for x in texts]
            out = [pa.array([x.tobytes() for x in ids], pa.binary())]
            return [*out, pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary())] if decode else out

        return run

    return map_texts(df, text, [("ids", T.BinaryType()), ("decoded", T.BinaryType())][: 1 + decode], make)


def op9_bpe_codec(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Ids and decoded bytes of every whole text, as digests."""
    import public_tokenizers

    found = encode_documents(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
