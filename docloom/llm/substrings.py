"""Exact substring dedup with sparse suffix arrays, sorted deep-shallow.

A byte goes if a string of LENGTH bytes over it also starts in a document of a smaller doc_id. Sorting every suffix of a
corpus would move it many times over, so suffixes are chosen first:

1. Each string of LENGTH bytes has one anchor, the smallest of its GRAM-byte grams; equal strings have equal anchors at equal
   places. About one byte in 14 is an anchor. Blocks of documents send their anchors' hashes, distinct in the block, to
   buckets of hashes, and get back one bit for each: whether other documents have it. No document is left out for its hash;
   a wrong match of hashes only costs a comparison.
2. For shared anchors, blocks send the bytes around them (contexts; equal ones once, with the smallest doc_id) to the
   buckets. There, the strings around anchors with more than one context become suffixes of a text, which is sorted: by
   multikey quicksort to a shallow depth, and what is equal so far by its other symbols (few) or blind tries. Equal strings stand together, and
   the smallest doc_id of each is known.
3. Blocks get back a bit for each string of each context, and mark and cut their documents' bytes.

Texts are shuffled once, in blocks that the three steps share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.common import gram_hashes, mix64, n_parts, release, sliding_min

#: Bytes of a string, and of the grams that anchor it.
LENGTH, GRAM = 50, 24
#: Grams of a string; bytes of a context: the string may begin up to LEFT bytes before its anchor.
GRAMS = LENGTH - GRAM + 1
LEFT = GRAMS - 1
CONTEXT = LEFT + LENGTH
ROW = 80  # bytes of a context with its range of strings and padding: ten words
#: Bytes that multikey quicksort looks at before blind tries take over.
SHALLOW = 24
#: Suffixes that are equal to the shallow depth are sorted together with those of other such groups, if they are so few; else by a trie.
FEW = 16
#: Bytes of documents whose anchors are found at once, about: their arrays stay in a core's cache.
PIECE = 1 << 14
#: Contexts whose strings are sorted at once, about.
AT_ONCE = 30_000
#: Bits of an anchor's hash that are kept.
HASH_BITS = 48
#: An anchor is hot if the documents with it, where it has different surroundings, are more than this part of its bucket's anchors.
HOT_SHARE = 16
#: Kinds of replies from buckets to blocks.
SHARED, GONE = 0, 1


def anchors(b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a document: place, first and last start of the strings they stand for, and hash of the gram."""
    h = gram_hashes(b, GRAM)
    low = np.uint64((1 << 24) - 1)
    found = []
    for at in range(0, len(b) - LENGTH + 1, 1 << 22):  # places within a piece fit 24 bits
        x = h[at : at + (1 << 22) + GRAMS - 1]
        best = sliding_min((x & ~low) | (low - np.arange(len(x), dtype=np.uint64)), GRAMS)
        first = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
        last = np.append(first[1:], len(best)) - 1
        p = (low - (best[first] & low)).astype(np.int64)
        found.append((p + at, first + at, last + at))
    if not found:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    p, first, last = (np.concatenate(x) for x in zip(*found, strict=True)) if len(found) > 1 else found[0]
    return p, first, last, mix64(h[p]) >> np.uint64(64 - HASH_BITS)  # mixed anew: anchors were chosen for small hashes


def block_anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of documents that stand in data one after the other, a byte or more apart; places count from the beginning of data."""
    low, found, k = np.uint64((1 << 24) - 1), [(np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)], 0
    while k < len(starts):
        z = max(k + 1, int(np.searchsorted(ends, starts[k] + PIECE, "right")))
        a, b = int(starts[k]), data[starts[k] : ends[z - 1]]
        if z == k + 1:  # however long
            p, first, last, h = anchors(b)
            found.append((p + a, first + a, last + a, h))
        elif len(b) >= LENGTH:
            h = gram_hashes(b, GRAM)
            best = sliding_min((h & ~low) | (low - np.arange(len(h), dtype=np.uint64)), GRAMS)
            whole = np.ones(len(best), bool)
            for end in (ends[k:z] - a).tolist():  # strings that would go beyond their document
                whole[max(0, end - LENGTH + 1) : end + 1] = False
            gap = starts[k + 1 : z] - ends[k : z - 1] > 1
            for x, y in zip((ends[k : z - 1][gap] - a).tolist(), (starts[k + 1 : z][gap] - a).tolist(), strict=True):
                whole[x:y] = False  # documents that are left out
            at = np.flatnonzero(whole)
            best = best[at]
            head = np.flatnonzero(np.append(True, best[1:] != best[:-1])[: len(best)])
            p = (low - (best[head] & low)).astype(np.int64)
            last = at[np.append(head[1:], len(at))[: len(head)] - 1]
            found.append((p + a, at[head] + a, last + a, mix64(h[p]) >> np.uint64(64 - HASH_BITS)))
        k = z
    p, first, last, h = (np.concatenate(x) for x in zip(*found, strict=True))
    return p, first, last, h


def _masks() -> np.ndarray:
    """By how far before the anchor strings begin, most and least: the bytes that they cover, as words."""
    at, most, least = np.arange(ROW), np.arange(GRAMS)[:, None, None], np.arange(GRAMS)[None, :, None]
    return np.where((at >= LEFT - most) & (at < LEFT - least + LENGTH), np.uint8(255), np.uint8(0)).view(np.uint64)


_MASKS = _masks()


def contexts(b: np.ndarray, p: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Rows of ROW bytes: what the anchor's strings cover, zero elsewhere; then how far before the anchor they begin, least and most."""
    text = np.concatenate((np.zeros(LEFT, np.uint8), b, np.zeros(ROW, np.uint8)))
    rows, least, most = np.ndarray(len(text) - ROW + 1, f"V{ROW}", text.data, strides=(1,))[p].view(np.uint8).reshape(-1, ROW), p - last, p - first
    for k in range(0, len(rows), 4_096):
        rows[k : k + 4_096].view(np.uint64)[:] &= _MASKS[most[k : k + 4_096], least[k : k + 4_096]]
    rows[:, CONTEXT], rows[:, CONTEXT + 1] = least, most
    return rows


_MULT = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1) ** 5) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(ROW // 8)], np.uint64)


def strings(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts taken apart: a context for each of their strings, and which one it is of."""
    back = np.arange(GRAMS)
    of, k = np.nonzero((back >= rows[:, CONTEXT][:, None]) & (back <= rows[:, CONTEXT + 1][:, None]))
    out = rows[of]
    out.view(np.uint64)[:] &= _MASKS[k, k]
    out[:, CONTEXT] = out[:, CONTEXT + 1] = k
    return out, of


def row_keys(rows: np.ndarray) -> np.ndarray:
    return (rows.view(np.uint64) * _MULT).sum(axis=1, dtype=np.uint64)


def distinct_rows(rows: np.ndarray, *before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of rows in which equal ones stand together, and where a new one begins. `before`: keys that come first.

    Rows are ordered by a hash and compared in full; should two differ under one hash, a row may show up as new twice,
    which repeats work and changes nothing.
    """
    words, key = rows.view(np.uint64), row_keys(rows)
    key ^= key >> np.uint64(29)
    order = np.lexsort((key, *before))
    if not len(order):
        return order, np.empty(0, bool)
    w = words[order]
    new = np.append(True, (w[1:] != w[:-1]).any(axis=1))
    for x in before:
        x = x[order]
        new[1:] |= x[1:] != x[:-1]
    return order, new


# ---- deep-shallow sorting


class BlindTrie:
    """A binary blind trie over equally long strings, given as integers: inner nodes know only the bit in which their leaves differ first.

    To insert, descend blindly, compare once with the leaf that is met, and branch where the two differ.
    """

    def __init__(self) -> None:
        self.root = None  # a leaf: (value, members); an inner node: [bit, node for 0, node for 1]

    def insert(self, value: int, member: int) -> None:
        if self.root is None:
            self.root = (value, [member])
            return
        node = self.root
        while type(node) is list:
            node = node[1 + (value >> node[0] & 1)]
        differ = (value ^ node[0]).bit_length() - 1
        if differ < 0:
            node[1].append(member)
            return
        above, side, node = None, 0, self.root
        while type(node) is list and node[0] > differ:
            above, side = node, 1 + (value >> node[0] & 1)
            node = above[side]
        leaf = (value, [member])
        branch = [differ, node, leaf] if value >> differ & 1 else [differ, leaf, node]
        if above is None:
            self.root = branch
        else:
            above[side] = branch

    def leaves(self) -> Iterator[list[int]]:
        """Members of equal strings, in the strings' order."""
        stack = [self.root]
        while stack:
            node = stack.pop()
            if type(node) is list:
                stack += [node[2], node[1]]
            elif node is not None:
                yield node[1]


def _symbol(text: np.ndarray, at: np.ndarray, width: int = 8) -> np.ndarray:
    """Big-endian integers of the `width` (8 at most) bytes at each place; text goes on for 8 bytes after the last."""
    every = np.ndarray(len(text) - 7, ">u8", text.data, strides=(1,))
    return every[at].astype(np.uint64) >> np.uint64(8 * (8 - width))


def _quicksorted(text: np.ndarray, starts: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: the order of suffixes by their first `shallow` bytes, and for each place the first place of its equals.

    Each pass parts every open segment in three by the median of three of its symbols (eight bytes): smaller and larger ones stay
    at their depth, equal ones go on to the next symbol. All segments of a pass are moved at once, by counting.
    """
    n = len(starts)
    order, segment = np.arange(n), np.zeros(n, np.int64)
    i, seg, depth = (np.arange(n), segment, np.zeros(n, np.int64)) if n > 1 else (np.empty(0, np.int64),) * 3  # of open places
    key = _symbol(text, starts[order[i]])
    while len(i):
        head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        size = np.diff(np.append(head, len(i)))
        of = np.repeat(np.arange(len(head)), size)
        x, y, z = key[head], key[head + size // 2], key[head + size - 1]
        pivot = np.maximum(np.minimum(x, y), np.minimum(np.maximum(x, y), z))[of]
        part = (key > pivot).astype(np.int64) + (key >= pivot)
        count = np.bincount(3 * of + part, minlength=3 * len(head))
        first, by = np.cumsum(count) - count, np.empty(len(i), np.int64)
        for k in range(3):
            some = np.flatnonzero(part == k)
            shift = first[k::3] - (np.cumsum(count[k::3]) - count[k::3])
            by[shift[of[some]] + np.arange(len(some))] = some
        order[i], key = order[i[by]], key[by]
        full = np.flatnonzero(count)
        seg, size = np.repeat(i[first[full]], count[full]), np.repeat(count[full], count[full])
        segment[i] = seg
        equal = np.repeat(full % 3 == 1, count[full])
        depth = depth[by] + 8 * equal
        open_ = (size > 1) & (depth < shallow)
        i, seg, depth, key, equal = i[open_], seg[open_], depth[open_], key[open_], equal[open_]
        key[equal] = _symbol(text, starts[order[i[equal]]] + depth[equal])
    return order, segment


def suffix_classes(text: np.ndarray, starts: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of text at `starts` by their first `depth` bytes: their order, and their number among the distinct ones.

    Multikey quicksort on symbols of eight bytes orders them to the shallow depth.
    Segments that are still equal there hold long common prefixes: if their rest is equal to the segment's first, they are
    done. Else small ones are sorted together by their other symbols, and each of the others by a blind trie.
    """
    n, text = len(starts), np.append(text, np.zeros(8, np.uint8))
    order, segment = _quicksorted(text, starts, shallow)
    open_ = np.bincount(segment, minlength=n + 1)[segment] > 1
    i = np.flatnonzero(open_)
    if len(i):
        seg, places = segment[i], starts[order[i]]
        head = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        count = np.diff(np.append(head, len(i)))
        lead = np.repeat(head, count)
        differ, keys = np.zeros(len(i), bool), []
        for at in range(shallow, depth, 8):
            keys.append(_symbol(text, places + at, min(8, depth - at)))
            differ |= keys[-1] != keys[-1][lead]
        mixed = np.logical_or.reduceat(differ, head)
        some = np.flatnonzero(np.repeat(mixed & (count <= FEW), count))
        if len(some):  # segments stay where they are, so sorted ones fill the same places
            by = some[np.lexsort((*(key[some] for key in reversed(keys)), lead[some]))]
            new = np.append(True, lead[by][1:] != lead[by][:-1])
            for key in keys:
                new[1:] |= key[by][1:] != key[by][:-1]
            order[i[some]] = order[i[by]]
            segment[i[some]] = i[some][new][np.cumsum(new) - 1]
        for g in np.flatnonzero(mixed & (count > FEW)).tolist():
            a, m = int(head[g]), int(count[g])
            trie, members = BlindTrie(), order[i[a : a + m]]
            for k, s in enumerate(places[a : a + m].tolist()):
                trie.insert(int.from_bytes(text[s + shallow : s + depth].tobytes(), "big"), k)
            base, done = int(i[a]), 0
            for leaf in trie.leaves():
                order[base + done : base + done + len(leaf)] = members[leaf]
                segment[base + done : base + done + len(leaf)] = base + done
                done += len(leaf)
    number = np.empty(n, np.int64)
    number[order] = np.cumsum(np.append(True, segment[1:] != segment[:-1])) - 1 if n else segment
    return order, number


def earliest(rows: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For distinct contexts and their smallest doc_ids, piece by piece: numbers of contexts, and the smallest doc_id of each of
    their strings, as a matrix by distance before the anchor. Contexts alone with their gram need no comparison and don't appear.
    """
    gram = np.ascontiguousarray(rows[:, LEFT : LEFT + GRAM]).view(">u8")
    order = np.lexsort((gram[:, 2], gram[:, 1], gram[:, 0]))
    g = gram[order]
    head = np.flatnonzero(np.append(True, (g[1:] != g[:-1]).any(axis=1))) if len(g) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(g)))
    several = np.flatnonzero(size > 1)
    upto, back, at = np.cumsum(size[several]), np.arange(GRAMS), 0
    while at < len(several):  # whole grams, about AT_ONCE contexts
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + AT_ONCE, side="right")))
        some = np.concatenate([order[head[k] : head[k] + size[k]] for k in several[at:end].tolist()])
        at = end
        row, k = np.nonzero((back >= rows[some, CONTEXT][:, None]) & (back <= rows[some, CONTEXT + 1][:, None]))
        _, number = suffix_classes(rows[some].reshape(-1), row * ROW + LEFT - k)
        owner = doc[some][row]
        by = np.lexsort((owner, number))
        first = np.flatnonzero(np.append(True, number[by][1:] != number[by][:-1]))
        low = np.empty(len(first), np.int64)
        low[number[by][first]] = owner[by][first]
        least = np.repeat(doc[some][:, None], GRAMS, axis=1)
        least[row, k] = low[number]
        yield some, least


# ---- blocks and buckets


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes())


def _loosen(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _planes(x: np.ndarray) -> bytes:
    """Ascending integers below 2**48: their differences, byte by byte of their place, compressed."""
    return _squeeze(np.diff(x, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T)


def _unplaned(b: bytes) -> np.ndarray:
    six = _loosen(b, np.uint8).reshape(6, -1).T
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return np.cumsum(out.view("<u8").reshape(-1), dtype=np.uint64)


def _surroundings(data: np.ndarray, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the CONTEXT bytes around each place, 0 where its text's start or end is too near."""
    out, inside = np.zeros(len(p), np.uint64), np.flatnonzero((p - LEFT >= start) & (p - LEFT + CONTEXT <= end))
    for k in range(0, len(inside), 4_096):
        at = inside[k : k + 4_096]
        x = contexts_raw(data, p[at]) * _MULT
        out[at] = (x ^ (x >> np.uint64(29))).sum(axis=1, dtype=np.uint64)
    return out


def contexts_raw(data: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The CONTEXT bytes around places, all of them within data with ROW bytes after it, as words."""
    return np.ndarray(len(data) - ROW + 1, f"V{ROW}", data.data, strides=(1,))[p - LEFT].view(np.uint64).reshape(-1, ROW // 8) & _MASKS[LEFT, 0]


def _limits(n_buckets: int) -> np.ndarray:
    """Where buckets of hashes begin; the last one's end, too."""
    return np.array([(i << HASH_BITS) // n_buckets for i in range(n_buckets + 1)], np.uint64)


class _Block:
    """The documents of a block, their anchors, and the block's distinct hashes by bucket."""

    def __init__(self, table: pa.Table, text: str, n_buckets: int, census: bool = False) -> None:
        ids = table.column("doc_id").to_pylist()
        self.bytes = [b or b"" for b in table.column(text).cast(pa.large_binary()).to_pylist()]
        size = np.fromiter(map(len, self.bytes), np.int64, len(ids))
        self.starts = np.cumsum(size + 1) - size - 1
        self.data = np.frombuffer(b"\0".join(self.bytes) + bytes(ROW), np.uint8)
        judged = np.array([i is not None for i in ids], bool)  # others are kept whole and remove nothing
        self.ids, ends = np.array([0 if i is None else i for i in ids], np.int64), self.starts + size
        self.place, self.first, self.last, self.hash = block_anchors(self.data, self.starts[judged], ends[judged])
        self.of = np.searchsorted(self.starts, self.place, "right") - 1
        self.limits = _limits(n_buckets)
        if census:
            self._count(ends)
        else:
            self.hashes = np.unique(self.hash)
        self.cuts = np.searchsorted(self.hashes, self.limits)

    def _count(self, ends: np.ndarray) -> None:
        """Distinct hashes, which of them are in documents of different ids (several), and the number of documents with those
        that have different surroundings (varied, else 0)."""
        order = np.argsort(self.hash, kind="stable")  # by document, then
        every, of = self.hash[order], self.of[order]
        once = np.flatnonzero(np.append(True, (every[1:] != every[:-1]) | (of[1:] != of[:-1]))[: len(every)])  # each document's first
        order, every, of = order[once], every[once], of[once]
        head = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
        self.hashes, self.several, self.varied = every[head], np.zeros(len(head), bool), np.zeros(len(head), np.uint16)
        if len(head):
            near, ids = _surroundings(self.data, self.place[order], self.starts[of], ends[of]), self.ids[of]
            many = np.append(head[1:], len(every)) - head
            self.several = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
            differ = np.minimum.reduceat(near, head) != np.maximum.reduceat(near, head)
            self.varied = np.where(differ, np.minimum(many, 65_535), 0).astype(np.uint16)

    def shared(self, kinds: list[int], buckets: list[int], bits: list[bytes], more: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The block's hashes that the buckets' bits say other documents have too, and which of these are hot."""
        marks = np.zeros((2, len(self.hashes)), bool)
        for kind, k, *both in zip(kinds, buckets, bits, more, strict=True):
            if kind == SHARED:
                a, z = self.cuts[k], self.cuts[k + 1]
                for row, x in zip(marks, both, strict=True):
                    row[a:z] = np.unpackbits(np.frombuffer(x, np.uint8), count=z - a).astype(bool)
        return self.hashes[marks[0]], marks[1][marks[0]]

    def contexts(self, shared: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
        """Distinct contexts of shared anchors by hash: rows, smallest doc_ids, ends of buckets; then for each found context its
        number, its doc_id and its anchor.

        Contexts of hot anchors are taken apart: each string goes by its own hash, so the many contexts of a common phrase don't
        meet in one bucket, while their equal strings still do.
        """
        nth, apart = np.empty(0, np.int64), np.empty(0, bool)
        if len(shared):
            at = np.minimum(np.searchsorted(shared, self.hash), len(shared) - 1)
            nth = np.flatnonzero(shared[at] == self.hash)
            apart = hot[at[nth]]
        rows, hashes = contexts(self.data, self.place[nth], self.first[nth], self.last[nth]), self.hash[nth]
        if apart.any():
            single, of = strings(rows[apart])
            rows, nth = np.concatenate((rows[~apart], single)), np.concatenate((nth[~apart], nth[apart][of]))
            hashes = np.concatenate((hashes[~apart], mix64(row_keys(single)) >> np.uint64(64 - HASH_BITS)))
        docs = self.ids[self.of[nth]]
        order, new = distinct_rows(rows, hashes)
        head, number = np.flatnonzero(new), np.empty(len(rows), np.int64)
        number[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(docs[order], head) if len(head) else docs
        return rows[order[head]], least, np.searchsorted(hashes[order[head]], self.limits), number, docs, nth


def _bit(x: np.ndarray) -> np.ndarray:
    """The highest bit of each of some positive whole numbers."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64) - 1


def _runs(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs that some ranges cover together."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.flatnonzero(np.append(True, start[1:] > end[:-1])[: len(start)])
    return start[head], end[np.append(head[1:], len(end))[: len(head)] - 1]


def cut_repeats(docs: DataFrame, text: str = "text", blocks: int | None = None, buckets: int | None = None, in_place: bool = False) -> DataFrame:
    """docs with `kept` (binary: the bytes left, in order), `n_bytes`, `n_removed` (long) and `spans` (array of struct<start, end>: the
    bytes removed, as maximal runs).

    A byte goes if a string of LENGTH bytes over it also starts in a document with a smaller doc_id, judged on the input.
    Matches don't cross documents; rows of equal doc_id don't remove from each other. Null texts count as empty. Rows with a
    null doc_id are kept whole and remove nothing. Texts shorter than LENGTH lose nothing. Repeated rows stay. Columns of docs
    with the names of new ones are replaced. An empty table gives an empty table.

    in_place: what is left also takes the text's place, without the parts of characters that were cut in two.

    Copies in a block, however many, are one context; a bucket has one row from each block. Hot anchors
    (HOT_SHARE) go by their strings, not their contexts, so a common phrase in ever other places is spread over all buckets.
    blocks and buckets (twice and once the shuffle partitions) must grow with the input so that each fits a worker's memory.
    """
    parts = n_parts(docs.sparkSession)
    n_blocks, n_buckets = blocks or 2 * parts, buckets or parts
    docs = docs.drop("kept", "n_bytes", "n_removed", "spans", "_block")
    by = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.xxhash64("doc_id"))
    dealt = docs.withColumn("_block", F.pmod(by, F.lit(n_blocks)).cast("int")).repartition(parts, "_block")
    lists = lambda table, *names: [table.column(x).to_pylist() for x in names]
    table = lambda types, *columns: pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))
    hashed = {"bucket": pa.int32(), "block": pa.int32(), "hashes": pa.binary(), "several": pa.binary(), "varied": pa.binary()}
    masked = {"_block": pa.int32(), "bucket": pa.int32(), "kind": pa.int32(), "bits": pa.binary(), "more": pa.binary()}
    sent_as = {"bucket": pa.int32(), "block": pa.int32(), "rows": pa.binary(), "least": pa.binary()}

    def send_hashes(key: tuple[pa.Scalar, ...], left: pa.Table) -> pa.Table:
        release()
        block = _Block(left, text, n_buckets, census=True)
        ends = [(k, block.cuts[k], block.cuts[k + 1]) for k in np.flatnonzero(np.diff(block.cuts)).tolist()]
        return table(hashed, [k for k, _, _ in ends], [key[0].as_py()] * len(ends), [_planes(block.hashes[a:z]) for _, a, z in ends], [np.packbits(block.several[a:z]).tobytes() for _, a, z in ends], [_squeeze(block.varied[a:z]) for _, a, z in ends])

    def find_shared(sent: pa.Table) -> pa.Table:
        blocks_, buckets_, hashes, flags, counts = lists(sent, "block", "bucket", "hashes", "several", "varied")
        each = [_unplaned(x) for x in hashes]
        several = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=len(x)) for f, x in zip(flags, each, strict=True)]).astype(bool)
        _, back, n = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
        load = np.bincount(back, np.concatenate([_loosen(c, "<u2") for c in counts]), len(n))
        multi, many = n > 1, load > max(8, len(back) // HOT_SHARE)
        multi[back[several]] = True
        ends = np.cumsum([len(x) for x in each])[:-1]
        bits = ([np.packbits(x).tobytes() for x in np.split(kind[back], ends)] for kind in (multi, many))
        return table(masked, blocks_, buckets_, [SHARED] * len(each), *bits)

    def send_contexts(key: tuple[pa.Scalar, ...], left: pa.Table, masks: pa.Table) -> pa.Table:
        if not left.num_rows or not masks.num_rows:
            return table(sent_as, [], [], [], [])
        release()
        block = _Block(left, text, n_buckets)
        rows, least, ends, *_ = block.contexts(*block.shared(*lists(masks, "kind", "bucket", "bits", "more")))
        some = np.flatnonzero(np.diff(ends)).tolist()
        return table(sent_as, some, [key[0].as_py()] * len(some), *([_squeeze(x[ends[k] : ends[k + 1]]) for k in some] for x in (rows, least)))

    def sort_suffixes(sent: pa.Table) -> pa.Table:
        release()
        blocks_, buckets_, packed, owners = lists(sent, "block", "bucket", "rows", "least")
        each = [_loosen(x, np.uint8).reshape(-1, ROW) for x in packed]
        rows, doc = np.concatenate(each), np.concatenate([_loosen(x, "<i8") for x in owners])
        order, new = distinct_rows(rows)
        head, number = np.flatnonzero(new), np.empty(len(rows), np.int64)
        number[order] = np.cumsum(new) - 1
        own = np.minimum.reduceat(doc[order], head)
        gone = np.where(own[number] < doc, np.uint32((1 << GRAMS) - 1), np.uint32(0))
        ends = np.append(head, len(order))
        for some, least in earliest(rows[order[head]], own):
            n = ends[some + 1] - ends[some]
            at = order[np.repeat(ends[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]  # the rows of these contexts
            lower = np.repeat(least, n, axis=0) < doc[at][:, None]
            gone[at] |= (lower @ (1 << np.arange(GRAMS, dtype=np.int64))).astype(np.uint32)
        bits = [_squeeze(x) for x in np.split(gone, np.cumsum([len(x) for x in each])[:-1])]
        return table(masked, blocks_, buckets_, [GONE] * len(each), bits, [None] * len(each))

    def cut_bytes(left: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        block = _Block(left, text, n_buckets)
        kinds, buckets_, bits, more = lists(replies, "kind", "bucket", "bits", "more")
        rows, least, ends, number, docs_, nth = block.contexts(*block.shared(kinds, buckets_, bits, more))
        marks = np.zeros(len(rows), np.int64)
        for kind, k, x in zip(kinds, buckets_, bits, strict=True):
            if kind == GONE:
                marks[ends[k] : ends[k + 1]] = _loosen(x, "<u4")
        # later documents of the block lose every string of a context that an earlier one has; the first what other blocks have
        mine = np.where(docs_ > least[number], (1 << GRAMS) - 1, marks[number]) if len(number) else number
        mine &= ((2 << rows[number, CONTEXT + 1].astype(np.int64)) - 1) & -(1 << rows[number, CONTEXT].astype(np.int64))  # a context's own strings
        live = np.flatnonzero(mine)
        mine, place = mine[live], block.place[nth[live]]
        # a context's strings lie over each other, so those that go cover one run
        start, end = _runs(place - _bit(mine), place - _bit(mine & -mine) + LENGTH)
        of = np.searchsorted(block.starts, start, "right") - 1
        removed, many = (np.bincount(of, w, len(block.bytes)).astype(np.int64) for w in (end - start, None))
        start, end = start - block.starts[of], end - block.starts[of]
        edges, kept = np.append(0, np.cumsum(many)), list(block.bytes)
        for k in np.flatnonzero(many).tolist():
            a, z = edges[k], edges[k + 1]
            kept[k] = b"".join([kept[k][x:y] for x, y in zip([0, *end[a:z].tolist()], [*start[a:z].tolist(), len(kept[k])], strict=True)])
        left = left.drop_columns("_block")
        if in_place:
            whole = pa.array([None if t is None else k.decode("utf-8", "ignore") for t, k in zip(left.column(text).to_pylist(), kept, strict=True)], pa.string())
            left = left.set_column(left.column_names.index(text), text, whole)
        spans = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(end, pa.int64())], ["start", "end"]))
        for name, column in (("kept", pa.array(kept, pa.binary())), ("n_bytes", pa.array([len(b) for b in block.bytes], pa.int64())), ("n_removed", pa.array(removed)), ("spans", spans)):
            left = left.append_column(name, column)
        return left

    hashes = dealt.groupBy("_block").applyInArrow(send_hashes, "bucket int, block int, hashes binary, several binary, varied binary")
    replies = "_block int, bucket int, kind int, bits binary, more binary"
    masks = hashes.groupBy("bucket").applyInArrow(find_shared, replies)
    sent = dealt.groupBy("_block").cogroup(masks.groupBy("_block")).applyInArrow(send_contexts, "bucket int, block int, rows binary, least binary")
    gone = sent.groupBy("bucket").applyInArrow(sort_suffixes, replies)
    out = T.StructType([*docs.schema.fields, *T._parse_datatype_string("kept binary, n_bytes bigint, n_removed bigint, spans array<struct<start: bigint, end: bigint>>").fields])
    return dealt.groupBy("_block").cogroup(masks.unionAll(gone).groupBy("_block")).applyInArrow(cut_bytes, out)


def op2_substrings(spark: SparkSession, docs: DataFrame) -> DataFrame:
    found = cut_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same over every string of every text, as hexadecimal digits.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT r, doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM d, LATERAL unnest(range(0, n - 49)) AS u(i) WHERE n >= 50),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
g AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50 AS apart FROM w JOIN f USING (s) WHERE first_id < doc_id),
k AS (SELECT r, i, sum(CASE WHEN apart THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM g),
c AS (SELECT r, run, min(i) AS a, max(i) + 50 AS z FROM k GROUP BY r, run),
p AS (SELECT r, a, z, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM c),
m AS (
  SELECT r, sum(z - a) AS removed, count(*) AS spans, max(z) AS last, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept
  FROM p JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN removed IS NULL THEN h ELSE kept || substring(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN m USING (r)
"""
