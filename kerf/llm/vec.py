"""Vectorised text kernels over the UTF-8 buffers of Arrow columns.

A kernel never builds one Python object per word: words are runs of bytes found
with array operations, and a word is known by a 64-bit hash of its bytes.  Work is
cut into slices of a bounded number of bytes, so a batch of very long texts needs
no more memory than a batch of short ones (one text is never cut).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
#: Bytes that belong to words: ASCII letters and digits, and all of a multi-byte character.
WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash, in place."""
    h ^= h >> np.uint64(33)
    h *= _M1
    h ^= h >> np.uint64(33)
    h *= _M2
    h ^= h >> np.uint64(33)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; offsets has one entry more than the rows. Nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_large_string(col.type):
        kind = np.int64
    else:
        col, kind = col.cast(pa.string()), np.int32
    _, off, data = col.buffers()
    n = len(col)
    offsets = np.frombuffer(off, kind, n + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64) if off else np.zeros(n + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def unused(names: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that are none of ``names``, whatever their case."""
    taken, out = {n.lower() for n in names}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def slices(col: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each, or of one row."""
    _, offsets = buffers(col) if not isinstance(col, np.ndarray) else (None, col)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = to


def lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col)


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, lengths in bytes, row offsets into these) of the words of each row."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = WORD[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(raw)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    rows = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), lengths, rows
    return hash_runs(raw[inside], lengths), lengths, rows


def hash_runs(packed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive runs of bytes, none of them empty."""
    begin = np.cumsum(lengths) - lengths
    at = np.arange(len(packed), dtype=np.int32)
    at -= np.repeat(begin.astype(np.int32), lengths)
    value = _BYTE[packed]
    if len(lengths) and lengths.max() > len(_POWERS):
        # Beyond the table a multiplier is changed by how often the table was used up, so none comes again.
        value *= _POWERS[at % len(_POWERS)] + (at // len(_POWERS)).astype(np.uint64) * _M2
    else:
        value *= _POWERS[at]
    h = np.add.reduceat(value, begin)
    h += lengths.astype(np.uint64)
    return mix(h)


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of the words of each of a few texts, lower case."""
    raw, offsets = buffers(lower(pa.array(texts, pa.string())))
    h, _, rows = words(raw, offsets)
    return [h[rows[i] : rows[i + 1]] for i in range(len(texts))]
