"""TF-IDF over lists of texts, each list a group of its own, for many groups at once and without a row for each term."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from kerf.functions.sizing import TERM
from kerf.kernels.signatures import coded, flat

_TERM = re.compile(TERM)
#: Bytes of text that are weighed at a time; a longer group is taken as one.
BYTES = 1 << 20


def terms(text: str | None) -> list[str]:
    return _TERM.findall(text.lower()) if text else []


def slices(lists: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of lists of so many bytes together, or of one that is longer."""
    items, offsets = flat(lists)
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(items), 0).to_numpy(zero_copy_only=False))])[offsets]
    k = 0
    while k < len(lists):
        end = max(k + 1, int(np.searchsorted(size, size[k] + BYTES, "right")) - 1)
        yield k, min(end, len(lists))
        k = end


def counts(items: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(item, term, times), in this order, of the terms of each text, and the different terms that the numbers stand for."""
    found = [terms(t) for t in items.to_pylist()]
    codes, different = coded(pa.array(list(chain.from_iterable(found)), pa.string()))
    v = max(1, len(different))
    item = np.repeat(np.arange(len(found)), np.fromiter(map(len, found), np.int64, len(found)))
    key, times = np.unique(item * v + codes, return_counts=True)
    return key // v, key % v, times, different


def weights(items: pa.Array, groups: np.ndarray, max_vocab: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(item, term, weight): L2-normalised TF-IDF within each group, on its most frequent terms (ties by name)."""
    item, term, times, different = counts(items)
    v = max(1, len(different))
    pairs, back, df = np.unique(groups[item] * v + term, return_inverse=True, return_counts=True)
    size = np.bincount(pairs // v, minlength=1)
    if size.max() > max_vocab:
        name = np.empty(v, np.int64)
        name[pc.array_sort_indices(different).to_numpy()] = np.arange(len(different))
        order = np.lexsort((name[pairs % v], -df, pairs // v))
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.arange(len(pairs)) - (np.cumsum(size) - size)[pairs[order] // v]
        known = (rank < max_vocab)[back]
        item, term, times, back = item[known], term[known], times[known], back[known]
    n = np.bincount(groups, minlength=1)[groups[item]]
    raw = (1 + np.log(times)) * (np.log((1 + n) / (1 + df[back])) + 1)
    return item, term, raw / np.sqrt(np.bincount(item, raw * raw, minlength=len(items)))[item], different


def adjacent(lists: pa.Array, max_vocab: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """For each item of all lists the cosine with the next one of its list, and the list that each belongs to."""
    items, offsets = flat(lists)
    groups = np.repeat(np.arange(len(lists)), np.diff(offsets))
    item, term, w, different = weights(items, groups, max_vocab)
    v = max(1, len(different))
    key = item * v + term
    at = np.minimum(np.searchsorted(key, key + v), max(0, len(key) - 1))
    hit = np.flatnonzero((key[at] == key + v) & (groups[item] == groups[item[at]]))
    return np.bincount(item[hit], w[hit] * w[at[hit]], minlength=len(items)), groups


def coherence(lists: pa.Array) -> pa.Array:
    """The mean similarity of neighbours in each list, 1 with fewer than two items."""
    out = np.ones(len(lists))
    for a, b in slices(lists):
        near, groups = adjacent(lists.slice(a, b - a))
        inside = np.flatnonzero(groups[:-1] == groups[1:])
        n = np.bincount(groups[inside], minlength=b - a)
        total = np.bincount(groups[inside], near[inside], minlength=b - a)
        out[a:b][n > 0] = total[n > 0] / n[n > 0]
    return pa.array(out)


def first_similarity(lists: pa.Array) -> pa.Array:
    """The similarity of the first two items of each list, 0 with fewer."""
    out = np.zeros(len(lists))
    for a, b in slices(lists):
        part = lists.slice(a, b - a)
        near, _ = adjacent(part)
        _, offsets = flat(part)
        two = np.flatnonzero(np.diff(offsets) > 1)
        out[a + two] = near[offsets[two]]
    return pa.array(out)


def windows(lists: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, place, similarity): cosine of the ``window`` items that end with a place and the ``window`` behind it, where all are there.

    With two texts a term's inverse frequency is 1 in both and ln(3/2) + 1 in one.
    """
    items, offsets = flat(lists)
    groups = np.repeat(np.arange(len(lists)), np.diff(offsets))
    first, last = offsets[:-1][groups] + window - 1, offsets[1:][groups] - 1 - window
    here = np.arange(len(items))
    places = np.flatnonzero((here >= first) & (here <= last))
    item, term, times, different = counts(items)
    v = max(1, len(different))
    # An item is before the places from it on and behind those before it.
    keys, side, n = [], [], []
    for d in range(-window, window):
        place = item + d
        inside = np.flatnonzero((place >= first[item]) & (place <= last[item]))
        keys.append(place[inside] * v + term[inside])
        side.append(np.full(len(inside), d >= 0))
        n.append(times[inside])
    keys, side, n = np.concatenate(keys), np.concatenate(side), np.concatenate(n)
    order = np.argsort(keys, kind="stable")
    keys, side, n = keys[order], side[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    a, b = (np.add.reduceat(np.where(s, n, 0), starts) if len(starts) else np.zeros(0, np.int64) for s in (side, ~side))
    idf = np.where((a > 0) & (b > 0), 1.0, np.log(1.5) + 1)
    u, w = (np.where(x > 0, 1 + np.log(np.maximum(x, 1)), 0.0) * idf for x in (a, b))
    place = keys[starts] // v
    uv, uu, ww = (np.bincount(place, x, minlength=len(items))[places] for x in (u * w, u * u, w * w))
    full = (uu > 0) & (ww > 0)
    return groups[places], places - offsets[:-1][groups[places]], np.where(full, uv / np.sqrt(np.where(full, uu * ww, 1)), 0.0)


def of_source(contents: pa.Array, texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """For each text whether its source's bytes of the range are the text's, and what part of its different terms the source has."""
    rows = []
    for content, said, a, b in zip(contents.to_pylist(), texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
        if content is None:
            rows.append([{"reconstruction": None, "coverage": None} for _ in said])
            continue
        source, theirs = content.encode(), set(terms(content))
        out = []
        for text, x, y in zip(said, a, b):
            own = set(terms(text))
            same = None if text is None or x is None or y is None else float(source[x:y] == text.encode())
            out.append({"reconstruction": same, "coverage": len(own & theirs) / len(own) if own else 1.0})
        rows.append(out)
    return pa.array(rows, pa.list_(pa.struct([("reconstruction", pa.float64()), ("coverage", pa.float64())])))
