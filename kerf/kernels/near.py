"""Pairs of 64-bit signatures that share one of four 16-bit bands and differ in few bits, found without a list of the pairs."""

from __future__ import annotations

import numpy as np

BANDS = 4
#: Pairs that are compared at a time, and signatures among which the first independent set is read off one table.
PAIRS, BASE = 1 << 20, 512


def band(h: np.ndarray, i: int) -> np.ndarray:
    return (h >> np.uint64(16 * i) & np.uint64(0xFFFF)).astype(np.uint16)


def links(a: np.ndarray, b: np.ndarray, i: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of two sets with an equal band ``i``, how many of the other differ in ``most`` bits at most and in every band before it."""
    na, nb = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    step = max(1, (PAIRS >> 2) // max(1, len(b)))
    for k in range(0, len(a), step):
        x = a[k : k + step, None] ^ b[None, :]
        near = np.bitwise_count(x) <= most
        for j in range(i):
            near &= (x & np.uint64(0xFFFF << 16 * j)) != 0
        na[k : k + step] = np.count_nonzero(near, axis=1)
        nb += np.count_nonzero(near, axis=0)
    return na, nb


def cover(h: np.ndarray, kept: np.ndarray, most: int) -> np.ndarray:
    """For each signature the first of ``kept`` that is near it, or -1."""
    best = np.full(len(h), len(kept), np.int64)
    for i in range(BANDS):
        theirs = band(kept, i)
        order, n = np.argsort(theirs, kind="stable"), np.bincount(theirs, minlength=1 << 16)
        mine = band(h, i)
        first, count = (np.cumsum(n) - n)[mine], n[mine]
        ends = np.cumsum(count)
        k = 0
        while k < len(h):
            # Signatures of so many pairs together, or one of more.
            done = ends[k] - count[k]
            end = max(k + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            own = np.repeat(np.arange(k, end), count[k:end])
            other = order[np.arange(ends[end - 1] - done) - np.repeat(ends[k:end] - count[k:end] - done, count[k:end]) + np.repeat(first[k:end], count[k:end])]
            near = np.bitwise_count(h[own] ^ kept[other]) <= most
            np.minimum.at(best, own[near], other[near])
            k = end
    return np.where(best < len(kept), best, -1)


def first_kept(h: np.ndarray, most: int) -> np.ndarray:
    """For each signature, in their order, the first kept one that is near it: itself unless an earlier kept one is."""
    out = np.arange(len(h))

    def small(at: np.ndarray) -> np.ndarray:
        x = h[at, None] ^ h[at][None, :]
        near = np.bitwise_count(x) <= most
        shared = np.zeros_like(near)
        for i in range(BANDS):
            shared |= (x & np.uint64(0xFFFF << 16 * i)) == 0
        near &= shared
        left, kept = np.ones(len(at), bool), []
        for k in range(len(at)):
            if left[k]:
                kept.append(k)
                gone = near[k] & left
                gone[: k + 1] = False
                out[at[gone]] = at[k]
                left &= ~gone
        return at[kept]

    def decide(at: np.ndarray) -> np.ndarray:
        if len(at) <= BASE:
            return small(at)
        kept = decide(at[: len(at) // 2])
        rest = at[len(at) // 2 :]
        by = cover(h[rest], h[kept], most)
        out[rest[by >= 0]] = kept[by[by >= 0]]
        return np.concatenate([kept, decide(rest[by < 0])])

    if len(h):
        decide(np.arange(len(h)))
    return out
