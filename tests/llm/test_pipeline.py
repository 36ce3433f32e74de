"""The pipeline's stages, each held against a brute-force version on its own input."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from docloom.llm import bpe, mixing, simhash
from tests.llm.test_llm_operators import DOCS, slow_cut, slow_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output, as lists of rows."""
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(900)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows, labels = [], []
    for i in range(260):
        words = [r.choice(vocabulary) for _ in range(r.randrange(30, 90))]
        toxic = i % 4 == 1
        if toxic:
            for _ in range(6):
                words[r.randrange(len(words))] = r.choice(["idiot", "moron"])
        text = " ".join(words) + (" " + passage if i % 9 == 2 else "")
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(300, rows[0][1], "en", "s0", 0), (301, rows[0][1], "en", "s1", 0), (302, None, "en", "s0", 0), (303, "", "en", None, 0), (None, "a row without a number", "en", "s0", None), (304, "é" * 200, "fr", "s1", 200)]
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs, found = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        columns = out.columns
        out.write.parquet(f"{sf}/stage{k}")
        got = spark.read.parquet(f"{sf}/stage{k}")
        found.append((name, docs.collect(), got.collect(), columns))
        docs = got
    return found, sf


def test_columns(stages):
    for k, (_, _, _, columns) in enumerate(stages[0]):
        assert columns == COLUMNS if k < 4 else columns[:5] == COLUMNS


def test_toxic_documents_go(stages):
    _, before, after, _ = stages[0][0]
    kept = {r.doc_id for r in after}
    gone = {r.doc_id for r in before} - kept
    assert all(i is not None and i < 260 and i % 4 == 1 for i in gone) and len(gone) >= 60
    assert {302, 303, 304, None} <= kept


def test_one_of_each_group_stays(stages):
    _, before, after, _ = stages[0][1]
    fps = {}
    for r in before:
        fps.setdefault(slow_fingerprint(r.text), []).append(r.doc_id)
    assert 300 not in {r.doc_id for r in after} and 301 not in {r.doc_id for r in after} and 0 in {r.doc_id for r in after}
    texts = {r.doc_id: r.text for r in before}
    for r in after:
        assert texts[r.doc_id] == r.text
    kept = [slow_fingerprint(r.text) for r in after if r.doc_id is not None]
    assert all((a ^ b).bit_count() > simhash.LINK for i, a in enumerate(kept) for b in kept[:i])
    assert {302, 303} & {r.doc_id for r in after} == {302}


def test_repeated_passages_are_cut(stages):
    _, before, after, _ = stages[0][2]
    want = {(d, digest) for d, _, _, _, digest in slow_cut([(r.doc_id, r.text) for r in before])}
    assert {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in after} == want
    was = {r.doc_id: r.text for r in before}
    changed = [r for r in after if r.text != was[r.doc_id]]
    assert len(changed) > 10 and all(r.n_chars == len(r.text) for r in changed)


def test_sources_are_mixed(stages, spark):
    _, before, after, _ = stages[0][3]
    taken = {(r.doc_id, r.source): (r.taken, r.size, r.target) for r in mixing.mix(spark.createDataFrame(before, DOCS)).collect()}
    times = Counter((r.doc_id, r.source) for r in after)
    for key, (t, size, _) in taken.items():
        assert times[key] == (int(t / size + 0.5) if size else 0)
    words, target = Counter(), {}
    for r in after:
        words[r.source] += len((r.text or "").split())
    for (_, source), (_, size, goal) in taken.items():
        target[source] = goal
        assert size < 1000
    assert all(abs(words[s] - target[s]) <= 300 for s in target)


def test_tokens_decode(stages):
    import public_tokenizers as P

    _, before, after, _ = stages[0][4]
    enc = bpe.encoding(P.path(bpe.RANKS), P.PATTERN)
    assert len(before) == len(after)
    for r in after:
        ids = np.frombuffer(r.ids, "<u4")
        assert enc.decode_bytes(ids.tolist()) == (r.text or "").encode() and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_run_is_the_stages(stages, spark):
    found, sf = stages
    assert Counter((r.doc_id, r.ids_sha256) for r in pipeline.run(spark, sf).collect()) == Counter((r.doc_id, r.ids_sha256) for r in found[4][2])
