"""Token ids of texts, by byte-level BPE.

Equal stretches between single white-space characters are encoded once in a worker: the pre-tokenizer
always cuts before a white-space character that stands alone, so ids of the stretches in order are the
ids of the text.  A stretch that was met before is found by its hash and taken only if its bytes are the same; those of
short ones are compared as two numbers.  No Python object is built for a stretch that is like others.

The ranks are read on the driver; a ``Codec`` that is broadcast carries them to the executors.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
import tiktoken

from kerf.llm import vec

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space of the pattern: bytes that are (1) or may begin (2) one, and which of the characters below U+4000 are that have several bytes.
_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] = 2
_WIDE = np.zeros(1 << 14, bool)
_WIDE[[0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True

#: Slots of the table of stretches that were met, which are at most half as many; bytes of the longest that is kept.
_SLOTS, _LONGEST = 1 << 21, 1 << 12
#: Bytes of a stretch that are compared as two numbers, and what such a number keeps of its first bytes.
_HEAD = 16
_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space; ``raw`` has two bytes behind the last character."""
    kind = _KIND[raw]
    space = kind == 1
    lead = np.flatnonzero(kind == 2)
    if len(lead):
        a, b, c = (raw[lead + k].astype(np.int32) for k in range(3))
        wide = _WIDE[np.where(a == 0xC2, b, (a & 3) << 12 | (b & 63) << 6 | c & 63)]
        lead, long = lead[wide], (a > 0xC2)[wide]
        space[lead] = space[lead + 1] = True
        space[lead[long] + 2] = True
    return space


def _runs(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of stretches, one after another."""
    begin = np.cumsum(lengths) - lengths
    return raw[np.arange(int(lengths.sum()), dtype=np.int32) + np.repeat((starts - begin).astype(np.int32), lengths)]


def _heads(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first _HEAD bytes of each stretch as two numbers; ``raw`` has as many bytes behind the last stretch."""
    view = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    out = np.zeros((2, len(starts)), np.uint64)
    out[0] = view[starts] & _KEEP[np.minimum(lengths, 8)]
    more = np.flatnonzero(lengths > 8)
    out[1, more] = view[starts[more] + 8] & _KEEP[np.minimum(lengths[more] - 8, 8)]
    return out


def _hash(heads: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of at most _HEAD bytes."""
    h = heads[0] * _M1
    h += heads[1] * _M2
    h += lengths.astype(np.uint64)
    return vec.mix(h)


class _Met:
    """Stretches that were met: hash, head and length, where the bytes of long ones are, where ids are. The first is the end of a text."""

    def __init__(self, eot: int):
        self.slot = np.full(_SLOTS, -1, np.int32)
        self.known = np.zeros((1024, 4), np.uint64)
        self.at = np.zeros((1024, 3), np.int64)
        self.bytes, self.ids = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint16)
        self.n = self.n_bytes = self.n_ids = 0
        none = np.zeros(1, np.int64)
        self.add(np.zeros(1, np.uint64), np.zeros((2, 1), np.uint64), np.zeros(0, np.uint8), none, none, np.array([eot], np.uint16), none + 1)

    @staticmethod
    def _room(a: np.ndarray, n: int) -> np.ndarray:
        return a if n <= len(a) else np.concatenate([a, np.zeros((max(len(a), n - len(a)), *a.shape[1:]), a.dtype)])

    def add(self, hashes: np.ndarray, heads: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Keeps stretches of ``raw`` with ``counts`` of ``ids`` each; returns their numbers."""
        k, long = self.n + np.arange(len(starts)), lengths > _HEAD
        data, held = _runs(raw, starts[long], lengths[long]), lengths * long
        self.known, self.at = self._room(self.known, self.n + len(k)), self._room(self.at, self.n + len(k))
        self.bytes, self.ids = self._room(self.bytes, self.n_bytes + len(data)), self._room(self.ids, self.n_ids + len(ids))
        for column, x in enumerate((hashes, *heads, lengths)):
            self.known[k, column] = x
        for column, x in enumerate((self.n_bytes + np.cumsum(held) - held, self.n_ids + np.cumsum(counts) - counts, counts)):
            self.at[k, column] = x
        self.bytes[self.n_bytes : self.n_bytes + len(data)] = data
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n, self.n_bytes, self.n_ids = self.n + len(k), self.n_bytes + len(data), self.n_ids + len(ids)
        return k

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of the stretch of each hash, or -1."""
        place = (h & np.uint64(_SLOTS - 1)).astype(np.int32)
        found = self.slot[place]
        open_ = np.flatnonzero((found >= 0) & (self.known[:, 0][found] != h))
        while len(open_):
            place[open_] = (place[open_] + 1) & (_SLOTS - 1)
            found[open_] = self.slot[place[open_]]
            open_ = open_[(found[open_] >= 0) & (self.known[:, 0][found[open_]] != h[open_])]
        return found

    def enter(self, h: np.ndarray, k: np.ndarray) -> None:
        """Puts numbers under different hashes that have no number yet."""
        place = (h & np.uint64(_SLOTS - 1)).astype(np.int32)
        while len(k):
            free = self.slot[place] < 0
            # Of several for one slot the last one gets it; the others and those before taken slots move on.
            self.slot[place[free]] = k[free]
            rest = self.slot[place] != k
            place, k = (place[rest] + 1) & (_SLOTS - 1), k[rest]


class Codec:
    """Ranks and what a worker has met; pickled as the ranks alone."""

    def __init__(self, ranks: bytes, pattern: str):
        self.made = ranks, pattern
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        #: The first free id ends each text.
        self.eot = self.encoding.max_token_value + 1
        if self.eot >= 1 << 16:
            raise ValueError("ids do not fit in 16 bits")
        self.met = _Met(self.eot)
        self.size = np.zeros(self.eot + 1, np.int64)
        for token, i in table.items():
            self.size[i] = len(token)

    def __reduce__(self):
        return _codec, self.made

    @staticmethod
    def _same(heads: np.ndarray, lengths: np.ndarray, raw: np.ndarray, starts: np.ndarray, other: tuple) -> np.ndarray:
        """Whether stretches have the bytes of the other ones (heads, lengths, bytes, where each begins in them)."""
        same = (heads[0] == other[0][0]) & (heads[1] == other[0][1]) & (lengths == other[1])
        long = np.flatnonzero(same & (lengths > _HEAD))
        if len(long):
            n = lengths[long]
            equal = _runs(raw, starts[long], n) == _runs(other[2], other[3][long], n)
            same[long] = np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return same

    def _look(self, raw: np.ndarray, space: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The numbers of stretches in ``met``; what wasn't there is encoded. ``space`` has the bytes of white space."""
        if self.met.n > _SLOTS // 2:
            self.met = _Met(self.eot)
        met = self.met
        heads = _heads(raw, starts, lengths)
        h = _hash(heads, lengths)
        long = np.flatnonzero(lengths > _HEAD)
        if len(long):
            h[long] = vec.hash_runs(_runs(raw, starts[long], lengths[long]), lengths[long])
        found = met.find(h)
        # A hit counts if it has the same bytes; a stretch that shares its hash with another isn't entered.
        known = met.known[found]
        same = (found >= 0) & self._same(heads, lengths, raw, starts, ((known[:, 1], known[:, 2]), known[:, 3].view(np.int64), met.bytes, met.at[:, 0][found]))
        fresh = np.flatnonzero(~same)
        if len(fresh):
            heads, h, at, n = heads[:, fresh], h[fresh], starts[fresh], lengths[fresh]
            order = np.argsort(h)
            new = np.ones(len(h), bool)
            new[1:] = h[order[1:]] != h[order[:-1]]
            which = np.empty(len(h), np.int64)
            which[order] = np.cumsum(new) - 1
            first = order[new]
            of = first[which]
            odd = np.flatnonzero(~self._same(heads, n, raw, at, (heads[:, of], n[of], raw, at[of])))
            own: dict[bytes, int] = {}
            for i in odd.tolist():
                which[i] = len(first) + own.setdefault(raw[at[i] : at[i] + n[i]].tobytes(), len(own))
            first = np.append(first, odd[np.unique(which[odd], return_index=True)[1]])
            k = met.add(h[first], heads[:, first], raw, at[first], n[first], *self._encode(raw, space, at[first], n[first]))
            fit = (found[fresh[first]] < 0) & (n[first] <= _LONGEST)
            fit[len(first) - len(own) :] = False
            met.enter(h[first[fit]], k[fit])
            found[fresh] = k[which]
        return found

    def _encode(self, raw: np.ndarray, space: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all stretches, their number in each); those between which the pre-tokenizer always cuts are encoded as one text."""
        sound = (lengths > 1) & space[starts] & ~space[starts + 1] & ~space[starts + lengths - 1]
        n = lengths[sound]
        joined = np.array(self.encoding.encode_ordinary(_runs(raw, starts[sound], n).tobytes().decode()), np.uint16)
        end = np.zeros(int(n.sum()) + 1, bool)
        end[np.cumsum(n)] = True
        counts = np.zeros(len(starts), np.int64)
        counts[sound] = np.diff(np.flatnonzero(end[np.cumsum(self.size[joined])]) + 1, prepend=0)
        if sound.all():
            return joined, counts
        rest = np.flatnonzero(~sound)
        others = [self.encoding.encode_ordinary(raw[s : s + m].tobytes().decode()) for s, m in zip(starts[rest].tolist(), lengths[rest].tolist())]
        counts[rest] = [len(x) for x in others]
        ids, mine = np.empty(int(counts.sum()), np.uint16), np.repeat(sound, counts)
        ids[mine] = joined
        ids[~mine] = np.concatenate([np.array(x, np.uint16) for x in others])
        return ids, counts

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids as uint16, row offsets into them) of texts, each followed by the end-of-text id; nulls are empty texts."""
        raw, offsets = vec.buffers(col)
        n = len(offsets) - 1
        if not len(raw):
            return np.full(n, self.eot, np.uint16), np.arange(n + 1)
        padded = np.append(raw, np.zeros(_HEAD, np.uint8))
        spaces = _spaces(padded)
        space = spaces[: len(raw)]
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[:-1] &= ~space[1:]
        cut[0] = cut[-1] = False
        inner = offsets[:-1][offsets[:-1] < len(raw)]
        cut[inner[inner > 0] - 1] = False
        cut[inner] = True
        starts = np.flatnonzero(cut)
        found = self._look(padded, spaces, starts, np.diff(np.append(starts, len(raw))))
        # Each row's stretches and, behind them, its end.
        ends = np.searchsorted(starts, offsets[1:])
        which = np.insert(found, ends, 0)
        at = self.met.at
        sizes = at[:, 2][which]
        to = np.cumsum(sizes)
        total = int(to[-1])
        out = self.met.ids[np.arange(total, dtype=np.int32) + np.repeat((at[:, 1][which] - to + sizes).astype(np.int32), sizes)]
        return out, np.concatenate(([0], to[ends + np.arange(n)]))

    def decode(self, ids) -> str:
        return self.encoding.decode_bytes([int(i) for i in ids if i != self.eot]).decode("utf-8", errors="replace")


@functools.cache
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


@functools.cache
def codec(path: str = TOKENIZER, pattern: str = PATTERN) -> Codec:
    with open(path, "rb") as f:
        return _codec(f.read(), pattern)
