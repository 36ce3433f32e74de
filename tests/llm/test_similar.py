"""Near copies by exact likeness, against a comparison of all pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline as pipeline
from docloom.llm import common, similar
from tests.llm.test_llm_operators import DOCS


def slow_components(texts, least=0.8):
    sets = []
    for t in texts:
        w = common.words_of(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (not a and not b) or len(a & b) >= least * len(a | b):
                x, y = top[i], top[j]
                top = [min(x, y) if t in (x, y) else t for t in top]
    return top


def edited_copies(r, n_base=40):
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(40)]
    out = []
    for k in range(n_base):
        base = [r.choice(vocabulary) for _ in range(r.randrange(60, 140))] + (passage if k % 3 == 0 else [])
        for _ in range(r.randrange(1, 6)):
            words = list(base)
            for _ in range(r.randrange(0, 4)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            out.append(" ".join(words))
    return out


def test_edited_copies_go(spark):
    texts = [*edited_copies(random.Random(4)), "a b", "a b", None, "", "c"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS).repartition(3)
    top = slow_components(texts)
    assert len({t for i, t in enumerate(top) if i != t}) > 20
    assert sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, "").collect()) == sorted(set(top))


def test_repeated_ids_and_null_ids_are_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a, "en", "s", 0), (1, a, "en", "s", 0), (1, b, "en", "s", 0), (2, b, "en", "s", 0), (None, a, "en", "s", 0), (None, "x", "en", "s", 0), (None, "x", "en", "s", 0)]
    got = pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS).repartition(2), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(1, a), (1, b), (None, "x")])


def test_a_large_group_of_edited_copies(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(500):
        words = list(base)
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(60)] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(3)
    got = {x.node: x.component for x in similar.groups(rows).collect()}
    assert [got[i] for i in range(500)] == slow_components(texts)


def test_long_keys_and_hot_keys_find_the_same(spark, monkeypatch):
    texts = edited_copies(random.Random(8), 20)
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(3)
    want = slow_components(texts)
    got = {x.node: x.component for x in similar.groups(rows, segments=similar.LARGE_SEGMENTS, take=similar.LARGE_TAKE).collect()}
    assert [got[i] for i in range(len(texts))] == want
    monkeypatch.setattr(similar, "SMALL", 2)
    monkeypatch.setattr(similar, "KEY_CELL", 2)
    monkeypatch.setattr(similar, "CELL", 2)
    got = {x.node: x.component for x in similar.groups(rows).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_keys_meet_for_like_sets():
    rng, met = np.random.default_rng(2), 0
    for _ in range(300):
        both = rng.integers(0, 2**63, 240).astype(np.uint64)
        a, b = (np.append(both, rng.integers(0, 2**63, 30).astype(np.uint64)) for _ in range(2))  # likeness 0.8
        z = np.stack([similar.sums(a), similar.sums(b)])
        assert int(((z[0] > 0) != (z[1] > 0)).sum()) <= similar.most_bits(similar.SEGMENTS, 0.8)
        x, y = similar.keys_of(similar.decode(z))
        met += bool(np.intersect1d(x, y).size)
    assert met >= 290


def test_decoding_finds_the_nearest_codewords():
    z = np.random.default_rng(3).standard_normal((20, 23))
    words = similar._codewords()
    assert ((words[:, :1] != words[:, 1:]).sum(0) >= 7).all()
    best = np.argsort(-(z.astype(np.float32) @ words), axis=1, kind="stable")[:, :2]
    assert (similar.decode(z)[:, 0] == best).all()


def test_rows_of_shared_keys_over_batches():
    r = random.Random(1)
    key = sorted(r.randrange(60) for _ in range(100))
    rows = list(zip(key, range(100)))
    want = [x for x in rows if key.count(x[0]) > 1]
    for size in (1, 2, 3, 7, 100):
        batches = [pa.record_batch([pa.array([k for k, _ in rows[i : i + size]]), pa.array([n for _, n in rows[i : i + size]])], names=["key", "node"]) for i in range(0, 100, size)]
        got = [(k, n) for b in similar._shared(iter(batches)) for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert got == want


def test_pairs_within_keys_over_batches(monkeypatch):
    monkeypatch.setattr(similar, "SMALL", 4)
    r = random.Random(3)
    key = sorted([r.randrange(30) for _ in range(70)] + [40] * 11)
    rows = [(k, i, 100, bytes(8)) for i, k in enumerate(key)]
    want = set()
    for i, k in enumerate(key):
        same = [j for j in range(len(key)) if key[j] == k]
        want |= {(j, i) for j in same if j < i} if len(same) <= 4 else {(j, i) for j in (i - 1, same[0]) if j in same and j < i}
    for size in (1, 2, 3, 5, 9, 100):
        batches = [pa.record_batch([pa.array(c) for c in zip(*rows[i : i + size])], names=["key", "node", "n", "fp"]) for i in range(0, len(rows), size)]
        got = [(u, v) for b in similar._within(3, 0.8)(iter(batches)) for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        assert set(got) == want


def test_a_dense_group_with_few_links(spark, monkeypatch):
    """Copies of one text with so many edits that their fingerprints are near, but only some pairs are linked."""
    r = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(160):
        words = list(base)
        for at in r.sample(range(120), r.randrange(2, 6)):
            words[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    want, calls, dense = slow_components(texts), [], similar._dense_links
    assert len(set(want)) > 20
    monkeypatch.setattr(similar, "_dense_links", lambda *a: calls.append(1) or dense(*a))
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(3)
    for cell in (similar.CELL, 8):
        monkeypatch.setattr(similar, "CELL", cell)
        got = {x.node: x.component for x in similar.groups(rows).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert len(calls) == 2


def test_a_dense_group_verifies_few_pairs(spark, monkeypatch):
    """Near copies that share keys but mostly aren't linked: what is verified pair by pair follows the texts, not their candidates."""
    r = random.Random(21)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(500):
        words = list(base)
        for at in r.sample(range(120), r.randrange(2, 8)):
            words[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    seen, verified = [], similar.verified
    monkeypatch.setattr(similar, "verified", lambda pairs, *a: seen.append(pairs.count()) or verified(pairs, *a))
    rows = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(3)
    got = {x.node: x.component for x in similar.groups(rows).collect()}
    assert [got[i] for i in range(500)] == slow_components(texts)
    assert sum(seen) <= 3 * len(texts), seen


def test_nearest_takes_a_pair_for_each_end(spark):
    pairs = [(1, 2, 9), (1, 3, 4), (2, 3, 7), (4, 5, 1), (3, 5, 4)]
    got = similar.nearest(spark.createDataFrame(pairs, "u long, v long, bits long")).collect()
    assert sorted((x.u, x.v) for x in got) == [(1, 3), (2, 3), (4, 5)]
