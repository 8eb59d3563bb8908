"""Signatures of word lists, for many texts at once: each different word of a batch is hashed once."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Words whose hashes are spread to single bits at a time, in rows of 256 bytes.
BITS_AT_ONCE = 1 << 16
#: Bits of a set's parity sketch, and sets whose bits are counted at a time.
SKETCH, SETS_AT_ONCE = 1024, 256
#: Pairs from which sets are compared by products of blocks of so many.
DENSE, BLOCK = 512, 256


def flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and where each list begins and the last ends."""
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.slice(offsets[0], offsets[-1] - offsets[0]), offsets - offsets[0]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the different words."""
    found = words.dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False), found.dictionary


def _digests(words: pa.Array) -> np.ndarray:
    """The 16 bytes of each word's MD5, as a row."""
    return np.frombuffer(b"".join(hashlib.md5(w.encode()).digest() for w in words.to_pylist()), np.uint8).reshape(-1, 16)


def simhash(lists: pa.Array) -> pa.Array:
    """64 signs of sums over the low 64 bits of the words' MD5, each as often as it stands; a tie sets the bit, no words give 0."""
    words, offsets = flat(lists)
    codes, different = coded(words)
    # The lowest bit comes first; a word counts 1 in a bit that it sets and -1 in one that it doesn't.
    signs = np.unpackbits(_digests(different)[:, :7:-1], axis=1, bitorder="little").astype(np.int32) * 2 - 1
    n = np.diff(offsets)
    out = np.zeros(len(n), np.uint64)
    powers = np.uint64(1) << np.arange(64, dtype=np.uint64)
    k = 0
    while k < len(n):
        # Texts of so many words together, or one of more.
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BITS_AT_ONCE, "right")) - 1)
        total = np.zeros((end - k, 64), np.int64)
        if end - k == 1:
            for at in range(offsets[k], offsets[end], BITS_AT_ONCE):
                total[0] += signs[codes[at : min(at + BITS_AT_ONCE, offsets[end])]].sum(0)
        else:
            full = np.flatnonzero(n[k:end])
            if len(full):
                total[full] = np.add.reduceat(signs[codes[offsets[k] : offsets[end]]], offsets[k:end][full] - offsets[k], axis=0)
        out[k:end] = ((total >= 0) & (n[k:end, None] > 0)) @ powers
        k = end
    return pa.array(out.view(np.int64))


def minhash(lists: pa.Array, masks: list[int]) -> pa.Array:
    """For each list the least, over its words, of the first 32 bits of their MD5 under each mask; 0 where it has no words."""
    words, offsets = flat(lists)
    codes, different = coded(words)
    hashes = np.ascontiguousarray(_digests(different)[:, :4]).view(">u4").reshape(-1).astype(np.uint32)
    n = np.diff(offsets)
    full = np.flatnonzero(n)
    out = np.zeros((len(n), len(masks)), np.int64)
    if len(full):
        each, starts = hashes[codes], offsets[:-1][full]
        for i, mask in enumerate(masks):
            out[full, i] = np.minimum.reduceat(each ^ np.uint32(mask), starts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * len(masks)), pa.array(out.reshape(-1)))


def parity(lists: pa.Array) -> pa.Array:
    """For each set of words SKETCH bits, of which each word turns one over: two sets differ in as many words as bits, at least."""
    words, offsets = flat(lists)
    codes, different = coded(words)
    bits = np.ascontiguousarray(_digests(different)[:, 4:8]).view(">u4").reshape(-1).astype(np.int64) % SKETCH
    out = np.zeros((len(lists), SKETCH // 8), np.uint8)
    for a in range(0, len(lists), SETS_AT_ONCE):
        n = np.diff(offsets[a : a + SETS_AT_ONCE + 1])
        at = np.repeat(np.arange(len(n)), n) * SKETCH + bits[codes[offsets[a] : offsets[a + len(n)]]]
        out[a : a + len(n)] = np.packbits(np.bincount(at, minlength=len(n) * SKETCH).reshape(-1, SKETCH) & 1, axis=1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(out.reshape(-1).view(np.int64)))


def alike(sets: list[str], a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Which pairs (a, b) of sets of words, each a text, have a Jaccard index of ``t`` in 10,000 at least."""
    words = [frozenset(x.split(" ")) if x else frozenset() for x in sets]
    n = np.fromiter(map(len, words), np.int64, len(words))
    if len(a) < DENSE:
        both = np.fromiter((len(words[i] & words[j]) for i, j in zip(a.tolist(), b.tolist())), np.int64, len(a))
    else:
        # Rows of ones and zeros, a block of sets against a block; sums are whole numbers that a float holds.
        numbers: dict[str, int] = {}
        columns = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in x), np.int64, len(x)) for x in words]
        both, blocks = np.zeros(len(a), np.int64), (a // BLOCK) * (len(sets) // BLOCK + 1) + b // BLOCK

        def rows(k: int) -> np.ndarray:
            own = columns[k * BLOCK : (k + 1) * BLOCK]
            out = np.zeros((len(own), len(numbers)), np.float32)
            out[np.repeat(np.arange(len(own)), [len(c) for c in own]), np.concatenate(own)] = 1
            return out

        order = np.argsort(blocks, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(blocks[order]) != 0]))
        at, left = -1, None
        for x, y in zip(starts, [*starts[1:], len(order)]):
            which = order[x:y]
            i, j = int(a[which[0]]) // BLOCK, int(b[which[0]]) // BLOCK
            if i != at:
                at, left = i, rows(i)
            both[which] = (left @ (left if j == i else rows(j)).T)[a[which] % BLOCK, b[which] % BLOCK]
    return both * 10_000 >= (n[a] + n[b] - both) * t
