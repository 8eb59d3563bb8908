"""An adaptive context-mixing range coder for token ids, many blocks at a time.

A block starts with an empty model, so blocks are coded and read independently.  For each id the contexts of
order 2 (hashed to 16 bits) and order 1 predict the id that followed them last.  Whether a prediction
holds is a probability mixed by adaptive weights, in the logistic domain, from two adaptive statistics: the records of
both orders together, and the prediction's frequency in the block (order 0) with its own record.  A three-way decision says that order 2 is right, order 1 is right, or neither; then the id follows
in two bytes from the adaptive counts of order 0.  Weights move by their gradient every STEP ids.

A writer knows all ids of a block, so what the model has seen before each of them is computed for whole blocks by
sorting and running sums; only the arithmetic of the coder goes from id to id, with array operations over the
blocks of a batch.  A reader goes from id to id with tables.  All arithmetic is on integers (or on quotients in double precision whose
floor is exact), so any machine reads what any other wrote.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK = 8192
#: Ids between two moves of the weights; blocks of which the statistics are computed together, and that are read together.
STEP, TOGETHER, READ = 256, 16, 128
#: Ids of blocks together are fewer, so a place is sorted in one number of 32 bits with what it is sorted by.
_PLACES = TOGETHER << 16
_BITS = 16
#: Decisions are of 16 bits, bytes of 15; an id takes at most 46 bits of the range, which has 62 and is kept above 46.
_TOTAL, _BYTES = 1 << 16, 1 << 15
#: What an occurrence adds to a count of order 0, whose counts begin with 1.
_GAIN = 40
#: Ids that are compared with each other to count what is below them; at most 256.
_PIECE_BITS = 7
_PIECE = 1 << _PIECE_BITS
#: Ids that are coded before what they add is summed; bits by which a range is widened, by its exponent as a double; 16 bits.
_SPAN = 64
_WIDER = np.array([16 * sum(e - 1023 < k for k in (46, 30, 14)) for e in range(2048)], np.uint64)
_WORD = np.uint64(0xFFFF)
_RATE = 14
_WEIGHT, _MOST = 40_000, 200_000
_SQUASH = np.array([max(64, min(_TOTAL - 64, round(_TOTAL / (1 + math.exp(-i / 256))))) for i in range(-2048, 2048)], np.int32)
#: 256 ln i, and that of 2 i + 1.
_LOG = np.array([0, *(round(256 * math.log(i)) for i in range(1, 2 * _TOTAL + 2))], np.int32)
_ODD = _LOG[1::2].copy()
_STATES = (128, 32)
_BUCKET = np.array([min(7, i.bit_length()) for i in range(1 << 16)], np.uint8)


def _slot(older: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The context of order 2 of two ids (uint32)."""
    return (older * np.uint32(0x9E3779B1) + last * np.uint32(0x85EBCA6B)) >> np.uint32(_BITS)


def _ranks(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of keys of 16 bits: (positions in the order of keys and places, the same within all rows, whether each begins its key's run)."""
    rows, steps = key.shape
    s = np.sort(key << np.uint32(16) | np.arange(steps, dtype=np.uint32), axis=1)
    at = s & np.uint32(0xFFFF)
    s >>= np.uint32(16)
    new = np.empty(s.shape, bool)
    new[:, 0] = True
    np.not_equal(s[:, 1:], s[:, :-1], out=new[:, 1:])
    return at, at + (np.arange(rows) * steps)[:, None], new


def _seen(key: np.ndarray) -> np.ndarray:
    """How many equal keys are before each in its row; keys have 16 bits."""
    _, flat, new = _ranks(key)
    at = np.arange(key.shape[1], dtype=np.int32)
    out = np.empty(key.shape, np.int32)
    out.reshape(-1)[flat] = at - np.maximum.accumulate(at * new, axis=1)
    return out


def _predictions(context: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each context of a row predicts: (id that followed it last or -1, right answers in a row, bucket of that id's frequency then).

    ``told`` has each id and, above its 16 bits, the bucket of its frequency; what is predicted is moved in one number likewise.
    """
    rows, steps = told.shape
    _, flat, new = _ranks(context)
    follower = told.reshape(-1)[flat]
    before = np.zeros_like(follower)
    before[:, 1:] = follower[:, :-1]
    # Right answers in a row: steps since the last wrong one or the begin.
    here = np.arange(steps, dtype=np.int32)
    wrong = np.maximum.accumulate(here * (new | ((before ^ follower) & 0xFFFF != 0)), axis=1)
    sure = np.zeros_like(wrong)
    np.minimum(here[:-1] - wrong[:, :-1], 7, out=sure[:, 1:])
    sure <<= 19
    sure |= before
    sure |= 1 << 22
    sure *= ~new
    out = np.empty(rows * steps, np.int32)
    out[flat.reshape(-1)] = sure.reshape(-1)
    out = out.reshape(rows, steps)
    return np.where(out != 0, out & 0xFFFF, -1), out >> 19 & 7, out >> 16 & 7


def _evidence(at: np.ndarray, key: np.ndarray, hit: np.ndarray, out: np.ndarray) -> None:
    """Writes to ``out[at]`` the log odds of the hits among what came before under the same key; at, key and hit (uint32) take 20, 11 and one bit."""
    s = key << np.uint32(21) | at << np.uint32(1) | hit
    s.sort()
    of = s >> np.uint32(21)
    start = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), of[1:] != of[:-1]])).astype(np.int32)
    n_key = np.diff(start, append=np.int32(len(s)))
    before = np.zeros(len(s) + 1, np.int32)
    np.cumsum((s & np.uint32(1)).view(np.int32), out=before[1:])
    hits = before[:-1] - np.repeat(before[start], n_key)
    missed = np.arange(len(s), dtype=np.int32) - np.repeat(start, n_key)
    missed -= hits
    odds = _ODD[hits]
    odds -= _ODD[missed]
    np.maximum(odds, -2047, out=odds)
    out[s >> np.uint32(1) & np.uint32(_PLACES - 1)] = np.minimum(odds, 2047, out=odds)


def _chances(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, width of order 2's interval, width of order 1's) of each id of rows of ids."""
    rows, steps = ids.shape
    u = ids.astype(np.uint32)
    last = np.zeros_like(u)
    last[:, 1:] = u[:, :-1]
    older = np.zeros_like(u)
    older[:, 2:] = u[:, :-2]
    told = ids | _BUCKET[_seen(u)].astype(np.int32) << 16
    guess2, sure2, bucket2 = _predictions(_slot(older, last), told)
    guess1, sure1, bucket1 = _predictions(last, told)
    inside = np.arange(steps) < lengths[:, None]
    equal = guess1 == guess2
    there = (inside & (guess2 >= 0), inside & (guess1 >= 0) & ~equal)
    hit2 = guess2 == ids
    hit1 = there[1] & (guess1 == ids)
    kind = np.where(hit2, 0, np.where(hit1, 1, 2)).astype(np.int8)
    joint = (sure2 * 16 + sure1 * 2 + equal).astype(np.uint32)
    row = np.repeat(np.arange(rows, dtype=np.uint32), steps)
    widths = []
    for sure, bucket, seen, hit, judged in ((sure2, bucket2, there[0], hit2, there[0]), (sure1, bucket1, there[1], hit1, there[1] & (kind != 0))):
        # Statistics are needed wherever there is a prediction, and gathered where it was judged.
        at = np.flatnonzero(judged)
        h = hit.reshape(-1)[at].astype(np.uint32)
        r = row[at]
        place = at.astype(np.uint32)
        s = np.zeros((2, rows * steps), np.int32)
        for k, state in enumerate((joint, (bucket * 4 + np.minimum(sure, 3)).astype(np.uint32))):
            _evidence(place, r * np.uint32(_STATES[k]) + state.reshape(-1)[at], h, s[k])
        s = s.reshape(2, rows, steps)
        weight = np.full((2, rows), _WEIGHT, np.int32)
        width = np.empty((rows, steps), np.int32)
        right, counts = (judged & hit) * np.int32(_TOTAL - 1), judged.astype(np.int32)
        for lo in range(0, steps, STEP):
            part = slice(lo, lo + STEP)
            x = s[:, :, part]
            mixed = x[0] * weight[0][:, None]
            mixed += x[1] * weight[1][:, None]
            mixed >>= 16
            mixed += 2048
            # Index 0 has the probability of index 1, which is the least that there is.
            p = _SQUASH.take(mixed, mode="clip")
            width[:, part] = p
            p *= counts[:, part]
            error = right[:, part] - p
            error >>= 4
            # Below 2 ** 31: log odds have 11 bits, errors 12, and STEP is 256.
            move = np.einsum("krt,rt->kr", x, error) >> _RATE
            weight = np.minimum(np.maximum(weight + move, -_MOST), _MOST)
        width *= seen
        widths.append(width)
    return kind, widths[0], _second(widths[0], widths[1])


def _second(width2: np.ndarray, p1: np.ndarray) -> np.ndarray:
    """Order 1's interval within what order 2 leaves."""
    w = ((_TOTAL - width2).astype(np.uint32) * p1.astype(np.uint32)) >> np.uint32(16)
    return np.maximum(w, p1 > 0).astype(np.int32)


def _scaled(below: np.ndarray, total: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Where a byte's interval begins, of _BYTES; the floor is exact as totals are far below 2 ** 30."""
    return (below * float(_BYTES - 256) / total).astype(np.int32) + byte


def _below(byte: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many smaller bytes are before each in its group; groups of the given sizes, below 65536, follow one another."""
    pieces = -(-sizes // _PIECE)
    begin = np.cumsum(sizes) - sizes
    ahead = np.cumsum(pieces) - pieces
    at = np.arange(len(byte)) + np.repeat(ahead * _PIECE - begin, sizes)
    piece = at >> _PIECE_BITS
    n = int(pieces.sum())
    # Place in a piece by piece; what pads a group comes after all of it.
    x = np.zeros((_PIECE, n), np.uint8)
    to = (at & (_PIECE - 1)) * n + piece
    x.reshape(-1)[to] = byte
    count = np.zeros((_PIECE, n), np.uint8)
    less = np.empty((_PIECE, n), bool)
    for d in range(1, min(_PIECE, int(sizes.max(initial=1)))):
        np.less(x[:-d], x[d:], out=less[d:])
        count[d:] += less[d:].view(np.uint8)
    out = count.reshape(-1)[to].astype(np.int32)
    wide = pieces > 1
    if wide.any():
        many = slice(None) if wide.all() else np.flatnonzero(np.repeat(wide, sizes))
        k = int(pieces[wide].sum()) + 1
        first = (np.cumsum(pieces * wide) - pieces * wide)[wide]
        line = byte[many] * np.int64(k)
        cell = line + piece[many] - np.repeat(ahead[wide] - first, sizes[wide])
        # Smaller bytes in the pieces before, of all groups; sums go round at 16 bits, differences within a group don't.
        held = np.bincount(cell + (k + 1), minlength=257 * k + 1)[: 257 * k].astype(np.uint16).reshape(257, k)
        for v in range(1, 257):
            held[v] += held[v - 1]
        np.cumsum(held, axis=1, dtype=np.uint16, out=held)
        held = held.reshape(-1)
        out[many] += held[cell] - held[line + np.repeat(first, sizes[wide])]
    return out


def _spelled(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(start, size) of both bytes of the ids that order 0 codes, which follow one another block by block: a row of four for each."""
    n = len(ids)
    out = np.zeros((n, 4), np.uint16)
    if not n:
        return out
    row = np.repeat(np.arange(len(lengths)), lengths)
    high, low = (ids >> 8).astype(np.uint8), (ids & 255).astype(np.uint8)
    total = np.arange(n, dtype=np.int32) - np.repeat((np.cumsum(lengths) - lengths).astype(np.int32), lengths)
    under = _below(high, lengths)
    # In the order of blocks, high bytes and places.
    key = row * 256 + high
    order = key.astype(np.uint32) * np.uint32(_PLACES) + np.arange(n, dtype=np.uint32)
    order.sort()
    order = (order % np.uint32(_PLACES)).astype(np.int64)
    groups = np.bincount(key)
    groups = groups[groups > 0]
    seen = np.empty(n, np.int32)
    seen[order] = np.arange(n) - np.repeat(np.cumsum(groups) - groups, groups)
    under_low = np.empty(n, np.int32)
    under_low[order] = _below(low[order], groups)
    # Rows of equal length; what pads them comes last.
    rows = np.zeros((len(lengths), int(lengths.max())), np.uint32)
    at = row * rows.shape[1] + total
    rows.reshape(-1)[at] = ids
    same = _seen(rows).reshape(-1)[at]
    for k, (byte, less, equal, all_) in enumerate(((high, under, seen, total), (low, under_low, same, seen))):
        byte = byte.astype(np.int32)
        of = (256 + _GAIN * all_).astype(np.float64)
        begin = _scaled(byte + _GAIN * less, of, byte)
        out[:, 2 * k] = begin
        out[:, 2 * k + 1] = _scaled(byte + 1 + _GAIN * (less + equal), of, byte + 1) - begin
    return out


def _intervals(blocks: list[np.ndarray], out: list[np.ndarray], lane: int) -> None:
    """Writes the three intervals of each id of each block to ``out``, ids x blocks: start, size - 1 and, as one number, what ``_spelled`` gives."""
    lengths = np.array([len(b) for b in blocks])
    ids = np.zeros((len(blocks), max(1, int(lengths.max()))), np.uint16)
    for r, b in zip(ids, blocks):
        r[: len(b)] = b
    kind, width2, width1 = _chances(ids, lengths)
    edge = width2 + width1
    start = np.where(kind == 0, 0, np.where(kind == 1, width2, edge))
    size = np.where(kind == 0, width2, np.where(kind == 1, width1, _TOTAL - edge))
    plain = (kind == 2) & (np.arange(ids.shape[1]) < lengths[:, None])
    spelled = _spelled(ids[plain], plain.sum(1))
    for k, x in enumerate((start, size - 1)):
        out[k][: ids.shape[1], lane : lane + len(blocks)] = x.T
    x = np.full(ids.shape, np.array([0, _BYTES, 0, _BYTES], np.uint16).view(np.uint64)[0])
    x[plain] = spelled.view(np.uint64)[:, 0]
    out[2][: ids.shape[1], lane : lane + len(blocks)] = x.T


def _code(table: list[np.ndarray], lengths: np.ndarray) -> list[bytes]:
    """The streams of blocks, all in lockstep, longest first; ``table`` is what ``_intervals`` wrote.

    Only the range goes from id to id. What an id adds to the stream is its start in units of the range, so many words behind
    the begin as the range was widened before; such numbers are summed where they lie, and carries are done at the end.
    """
    steps, lanes = table[0].shape
    rng, used = np.full(lanes, 1 << 62, np.uint64), np.zeros(lanes, np.int64)
    words = np.zeros((lanes, 4096), np.uint32)
    columns = (*table[:2], *np.moveaxis(table[2].view(np.uint16).reshape(steps, lanes, 4), 2, 0))
    bits, active = (np.uint64(16), np.uint64(15), np.uint64(15)), lanes
    unit, wider = np.zeros((3, _SPAN, lanes), np.uint64), np.zeros((_SPAN, lanes), np.uint64)
    for t0 in range(0, steps, _SPAN):
        some = [x[t0 : t0 + _SPAN].astype(np.uint64, order="C") for x in columns]
        some[1] += np.uint64(1)
        n = len(some[0])
        # Blocks that have ended add nothing.
        unit[:, :, active:] = wider[:, active:] = 0
        for t in range(n):
            while active and lengths[active - 1] <= t0 + t:
                active -= 1
                unit[:, t:, active] = wider[t:, active] = 0
            if not active:
                break
            ra = rng[:active]
            for k in range(3):
                u = unit[k, t, :active]
                np.right_shift(ra, bits[k], out=u)
                np.multiply(u, some[2 * k + 1][t, :active], out=ra)
            # The exponent tells how many words are missing; up to 2 ** 53 it is exact, and above none is.
            w = wider[t, :active]
            _WIDER.take((ra.astype(np.float64).view(np.int64) >> 52), out=w, mode="clip")
            ra <<= w
        if n < _SPAN:
            unit[:, n:] = wider[n:] = 0
        added = unit[0, :n] * some[0]
        added += unit[1, :n] * some[2]
        added += unit[2, :n] * some[4]
        moved = (wider[:n].T >> np.uint64(4)).astype(np.int32, order="C")
        place = np.cumsum(moved, axis=1, dtype=np.int32)
        if int(used.max() + place[:, -1].max()) + 8 >= words.shape[1]:
            words = np.concatenate([words, np.zeros_like(words)], 1)
        # One sum for each place of a lane, below 2 ** 63.
        new = np.empty((lanes, n), bool)
        new[:, 0] = True
        np.not_equal(moved[:, :-1], 0, out=new[:, 1:])
        new = np.flatnonzero(new)
        total = np.add.reduceat(np.ascontiguousarray(added.T).reshape(-1), new)
        lane = new // n
        at = lane * words.shape[1] + used[lane] + (place - moved).reshape(-1)[new]
        flat = words.reshape(-1)
        for k, part in enumerate((total >> np.uint64(46), total >> np.uint64(30) & _WORD, total >> np.uint64(14) & _WORD, total << np.uint64(2) & _WORD)):
            flat[at + k] += part.astype(np.uint32)
        used += place[:, -1]
    used += 4
    # Words of 16 bits with all carries done.
    words = np.ascontiguousarray(words[:, : int(used.max())].T)
    for k in range(len(words) - 1, 0, -1):
        words[k - 1] += words[k] >> 16
    out = words.astype(np.uint16).T.astype(">u2", order="C")
    return [out[i, :n].tobytes() for i, n in enumerate(used.tolist())]


def checksum(ids: np.ndarray, payload: bytes) -> int:
    return zlib.crc32(payload, zlib.crc32(np.ascontiguousarray(ids, ">u2").tobytes()))


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """One stream for each block of ids (uint16), of at most 65535 ids."""
    if not blocks:
        return []
    if max(map(len, blocks)) >= 1 << 16:
        raise ValueError("a block has at most 65535 ids")
    order = np.argsort([-len(x) for x in blocks], kind="stable")
    lengths = np.array([len(blocks[i]) for i in order])
    table = [np.zeros((int(lengths[0]), len(blocks)), kind) for kind in (np.uint16, np.uint16, np.uint64)]
    for lo in range(0, len(blocks), TOGETHER):
        _intervals([blocks[i] for i in order[lo : lo + TOGETHER]], table, lo)
    out: list[bytes] = [b""] * len(blocks)
    for i, s in zip(order, _code(table, lengths)):
        out[i] = s
    return out


class _Reader:
    def __init__(self, streams: list[bytes]):
        w = np.zeros((len(streams), max(len(s) // 2 for s in streams) + 5), np.uint64)
        for i, s in enumerate(streams):
            w[i, : len(s) // 2] = np.frombuffer(s[: len(s) // 2 * 2], ">u2")
        shift = [np.uint64(k) for k in (46, 30, 14)]
        self.offset = (w[:, 0] << shift[0]) | (w[:, 1] << shift[1]) | (w[:, 2] << shift[2]) | (w[:, 3] >> np.uint64(2))
        # What follows is two bits off the words.
        self.words = ((w[:, 3:-1] & np.uint64(3)) << np.uint64(14)) | (w[:, 4:] >> np.uint64(2))
        self.range = np.full(len(streams), 1 << 62, np.uint64)
        self.used = np.zeros(len(streams), np.int64)

    def peek(self, lanes: np.ndarray, bits: int) -> np.ndarray:
        self.unit = self.range[lanes] >> np.uint64(bits)
        return np.minimum(self.offset[lanes] // np.maximum(self.unit, np.uint64(1)), np.uint64((1 << bits) - 1)).astype(np.int64)

    def take(self, lanes: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.offset[lanes] -= self.unit * start.astype(np.uint64)
        self.range[lanes] = self.unit * size.astype(np.uint64)

    def skip(self, lanes: np.ndarray) -> None:
        """Both bytes of ids that were predicted."""
        for _ in range(2):
            self.range[lanes] = (self.range[lanes] >> np.uint64(15)) << np.uint64(15)

    def refill(self, active: int) -> None:
        """Words until the range is above 46 bits again; a damaged stream ends its words early."""
        short = np.flatnonzero(self.range[:active] < (1 << 46))
        for _ in range(4):
            if not len(short):
                break
            at = np.minimum(self.used[short], self.words.shape[1] - 1)
            self.offset[short] = (self.offset[short] << np.uint64(16)) | self.words[short, at]
            self.used[short] += 1
            self.range[short] <<= np.uint64(16)
            short = short[self.range[short] < (1 << 46)]


def _read(streams: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks of the given lengths, longest first."""
    lanes, steps = len(streams), int(lengths.max())
    reader = _Reader(streams)
    ids = np.zeros((steps, lanes), np.uint16)
    # By order and lane: what a context predicts, as id + 1, and its record; hits and judgements of each state.
    memo = np.zeros((2, lanes, 1 << _BITS), np.int32)
    record = np.zeros((2, lanes, 1 << _BITS), np.uint8)
    tried = np.zeros((2, 2, lanes, 128), np.int32)
    hits = np.zeros((2, 2, lanes, 128), np.int32)
    weight = np.full((2, 2, lanes), _WEIGHT, np.int32)
    slope = np.zeros((2, 2, lanes), np.int64)
    frequency = np.zeros((lanes, 1 << 16), np.uint16)
    counts = [np.zeros((lanes * 256**k, 256), np.uint16) for k in range(2)]
    last, older = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
    both = np.arange(2)[:, None]
    active = lanes
    for t in range(steps):
        while active and lengths[active - 1] <= t:
            active -= 1
        a = np.arange(active)
        if t and t % STEP == 0:
            weight = np.clip(weight + (slope >> _RATE), -_MOST, _MOST).astype(np.int32)
            slope[:] = 0
        context = np.stack([_slot(older[a], last[a]), last[a]]).astype(np.int64)
        guess, rec = memo[both, a, context] - 1, record[both, a, context]
        sure, bucket = (rec & 7).astype(np.int64), (rec >> 3).astype(np.int64)
        equal = guess[0] == guess[1]
        there = guess >= 0
        there[1] &= ~equal
        joint = sure[0] * 16 + sure[1] * 2 + equal
        s, states, p = [], [], np.zeros((2, active), np.int32)
        for o in range(2):
            state = np.stack([joint, bucket[o] * 4 + np.minimum(sure[o], 3)])
            h, n = hits[o, both, a, state], tried[o, both, a, state]
            x = np.clip(_LOG[2 * h + 1] - _LOG[2 * (n - h) + 1], -2047, 2047)
            p[o] = _SQUASH[np.clip((weight[o, :, :active] * x).sum(0, dtype=np.int32) >> 16, -2047, 2047) + 2048]
            s.append(x)
            states.append(state)
        width2 = np.where(there[0], p[0], 0)
        width1 = _second(width2, np.where(there[1], p[1], 0))
        edge = width2 + width1
        v = reader.peek(a, 16)
        kind = (v >= width2).astype(np.int64) + (v >= edge)
        start = np.where(kind == 0, 0, np.where(kind == 1, width2, edge))
        reader.take(a, start, np.where(kind == 0, width2, np.where(kind == 1, width1, _TOTAL - edge)))
        token = np.where(kind == 0, guess[0], guess[1]).astype(np.int64)
        reader.skip(np.flatnonzero(kind != 2))
        plain = np.flatnonzero(kind == 2)
        if len(plain):
            prefix = np.zeros(len(plain), np.int64)
            here = np.arange(len(plain))
            for k in range(2):
                row = plain * 256**k + prefix
                below = np.zeros((len(plain), 257), np.int64)
                np.cumsum(1 + _GAIN * counts[k][row].astype(np.int64), axis=1, out=below[:, 1:])
                begin = _scaled(below, below[:, 256:].astype(np.float64), np.arange(257))
                v = reader.peek(plain, 15)
                byte = (begin[:, 1:] <= v[:, None]).sum(1)
                reader.take(plain, begin[here, byte], begin[here, byte + 1] - begin[here, byte])
                counts[k][row, byte] += 1
                prefix = prefix * 256 + byte
            token[plain] = prefix
        reader.refill(active)
        ids[t, :active] = token
        seen = _BUCKET[frequency[a, token]]
        frequency[a, token] += 1
        for o in range(2):
            hit = there[o] & (guess[o] == token)
            judged = there[o] if o == 0 else there[1] & (kind != 0)
            error = np.where(judged, hit * (_TOTAL - 1) - p[o], 0) >> 4
            slope[o, :, :active] += s[o].astype(np.int64) * error
            tried[o, both, a, states[o]] += judged
            hits[o, both, a, states[o]] += judged & hit
            memo[o, a, context[o]] = token + 1
            record[o, a, context[o]] = np.where(guess[o] == token, np.minimum(sure[o] + 1, 7), 0) | seen.astype(np.int64) << 3
        older[a] = last[a]
        last[a] = token
    return [ids[:n, i] for i, n in enumerate(lengths)]


def decode_blocks(payloads: list[bytes], lengths: list[int], checksums: list[int] | None = None) -> list[np.ndarray]:
    """The ids of each block; with checksums, ValueError where a block isn't what was written."""
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(payloads)
    order = np.argsort(-np.array(lengths, np.int64), kind="stable")
    for lo in range(0, len(order), READ):
        some = order[lo : lo + READ]
        for i, ids in zip(some, _read([payloads[i] for i in some], np.array([lengths[i] for i in some]))):
            out[i] = ids
    for i, c in enumerate(checksums or []):
        if checksum(out[i], payloads[i]) != c:
            raise ValueError(f"block {i} is damaged")
    return out
