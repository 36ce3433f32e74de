"""Work over whole blocks gives what documents, contexts and positions give one by one."""

import random

import numpy as np

from docloom.llm import attention, bpe, lm, substrings
from docloom.llm.attention import Attention


def test_anchors_of_a_block_are_those_of_its_documents():
    r = random.Random(5)
    texts = [bytes(r.choice(b"ab c") for _ in range(n)) for n in [0, 3, 49, 50, 51, 120, 49, 50, 2, 700, 40_000, 60, 1] * 4]
    texts[5], texts[-4] = b"\0" * 300, b"\0" * 60
    judged = [i for i in range(len(texts)) if i % 7 != 3]
    data = np.frombuffer(b"\0".join(texts), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[judged]
    got = substrings.block_anchors(data, starts, starts + [len(texts[i]) for i in judged])
    each = [substrings.anchors(np.frombuffer(texts[i], np.uint8)) for i in judged]
    for k, x in enumerate(got):
        assert x.tolist() == [int(v) + (int(s) if k < 3 else 0) for a, s in zip(each, starts, strict=True) for v in a[k]]


def test_small_groups_are_sorted_without_tries(monkeypatch):
    r = random.Random(7)
    text = np.frombuffer("".join(("abcdefgh" * 4)[: r.randrange(24, 33)] + r.choice("xyz") * 20 + str(i) * 9 for i in range(12)).encode() + b"z" * 60, np.uint8)
    starts = np.arange(len(text) - 60)
    keys = [text[s : s + 50].tobytes() for s in starts]

    def no_trie():
        raise AssertionError("a trie for a small group")

    monkeypatch.setattr(substrings, "FEW", 1_000, raising=False)
    monkeypatch.setattr(substrings, "BlindTrie", no_trie)
    order, number = substrings.suffix_classes(text, starts)
    rank = {k: i for i, k in enumerate(sorted(set(keys)))}
    assert [keys[i] for i in order] == sorted(keys) and number.tolist() == [rank[k] for k in keys]


def test_wanted_positions_are_those_of_all():
    net, r = Attention(lm.N_CLASSES, n_inputs=lm.N_INPUTS), np.random.default_rng(2)
    x, y = r.integers(0, lm.N_INPUTS, (5, 32)), r.integers(0, lm.N_CLASSES, (5, 32))
    some = np.flatnonzero(r.random(160) < 0.4)
    assert np.abs(net.log_probability(x, y, some) - net.log_probability(x, y).ravel()[some]).max() < 1e-5


def test_all_windows_are_those_of_each_text():
    sizes = np.array([1, 32, 2, 33, 60, 61, 4, 88, 5, 1024, 31, 200])
    start, first, text = attention.all_windows(sizes)
    at = np.cumsum(sizes) - sizes
    each = [attention.windows(n) for n in sizes.tolist()]
    assert start.tolist() == [int(a + x) for a, (s, _) in zip(at, each, strict=True) for x in s]
    assert first.tolist() == [int(a + x) for a, (_, f) in zip(at, each, strict=True) for x in f]
    assert text.tolist() == [i for i, (s, _) in enumerate(each) for _ in s]
    assert all(len(x) == 0 for x in attention.all_windows(sizes[:0]))


def test_words_of_a_call_are_spelt_once():
    import public_tokenizers as P

    path, pattern = P.path(bpe.RANKS), P.PATTERN
    units = {b"a": lm.N_IDS, b"word7": lm.N_IDS + 1}
    texts = [None, "", "a b unheardof", "word7 Unheardof unheardof\n\nword8 a", " ".join(f"w{i % 70}" for i in range(900)), "x" * 3000]
    coder, seen = lm.Coder(units, path, pattern), []
    spell = coder.spell
    coder.spell = lambda w: seen.append(w) or spell(w)
    flat, ends, rare = coder.read(texts)
    enc = bpe.encoding(path, pattern)
    want = [[i for w in [*lm.words_of(t), lm.END] for i in lm._ids_of(w, enc, units)] for t in texts]
    heads = [k == 0 for t in texts for w in [*lm.words_of(t), lm.END] for k, _ in enumerate(lm._ids_of(w, enc, units))]
    assert [x.tolist() for x in np.split(flat & (lm.FIRST - 1), ends[:-1])] == want and (flat >= lm.FIRST).tolist() == heads
    assert rare.to_pylist() == [[w for w in lm.words_of(t) if w not in units] for t in texts]
    assert len(seen) == len(set(seen)) == len({w for t in texts for w in lm.words_of(t) if w not in units})
    assert coder.read([])[0].tolist() == []


def test_transitions_are_counted_in_the_pass_over_pieces(spark):
    read, of = np.arange(lm.N_IDS) % lm.N_INPUTS, np.arange(lm.N_IDS) % 70 + 1
    texts = [[5, 9, 9, 7], [5, 9, 9, 7], list(range(4_000, 6_500)), [1]]  # equal pieces come once, their transitions don't
    rows = [(i % 3, np.array(t, "<u4").tobytes()) for i, t in enumerate(texts)]
    rows[1] = rows[0]
    got = lm.coded_pieces(spark.createDataFrame(rows, "h long, ids binary").coalesce(1), read, of, counted=True).cache()
    want = np.zeros((lm.N_INPUTS, lm.N_CLASSES), np.int64)
    for t in texts:
        np.add.at(want, ([0, *read[t[:-1]]], of[t] - 1), 1)
    assert (lm.counted_transitions(got) == want).all()
    plain = lm.coded_pieces(spark.createDataFrame(rows, "h long, ids binary").coalesce(1), read, of).collect()
    assert sorted(plain) == sorted(got.where("h is not null").collect()) and len(plain) == 5


def test_queries_and_keys_are_one_map():
    net = Attention(lm.N_CLASSES, n_inputs=lm.N_INPUTS)
    assert net._maps().shape == (net.width, 2 * net.width)
    assert np.abs(net._maps()[:, : net.width] - net.p["Q"] @ net.p["K"].T).max() < 1e-6
