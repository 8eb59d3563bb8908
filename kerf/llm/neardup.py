"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A text's fingerprint has 192 bits over its distinct lower-case words, a word weighing
its length in bytes (15 at most), so that short and frequent words say little.  Four
segments of 23 bits are each decoded with the perfect binary Golay code (23, 12, 7):
a segment's keys are the codewords that decoding gives for the segment and for its 23
neighbours (one or six of them), so segments that differ in two bits or less always
share a key.  By the pigeonhole principle fingerprints that differ in eight bits or
less over the four segments agree so in two segments at least; hence the keys that are
joined are pairs of codewords, one for each pair of segments.  What is shuffled is one row for each first codeword with all
second ones, which are laid out where they arrive.  The join itself tests most of
what lies outside the segments by the bound on the whole fingerprint, so it passes over no near-duplicate, and
what it lets through is verified on the whole fingerprint.  Beyond eight bits the search is approximate; its recall is
measured by the tests.

Defined cases: texts that are equal byte for byte are copies, whatever they hold, but for
null and empty texts, which are never copies; texts without words are copies of equal texts
only; rows without doc_id are neither compared nor reported; of repeated rows of one doc_id
none is a copy of another; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm import vec
from kerf.plans.session import checkpoint

BITS, SEGMENTS, SEGMENT_BITS = 192, 4, 23
#: Differing bits of near-duplicates, of 192; 28 is a cosine of about 0.9 of weighted word sets.
MAX_DISTANCE = 28
PAIRS = list(itertools.combinations(range(SEGMENTS), 2))

_GENERATOR = 0xC75


def _syndromes() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each of the 23 bits, error pattern of each syndrome)."""
    bit = np.zeros(23, np.int32)
    for i in range(23):
        r = 1 << i
        for k in range(22, 10, -1):
            if r >> k & 1:
                r ^= _GENERATOR << (k - 11)
        bit[i] = r
    error = np.zeros(2048, np.int32)
    for n in (1, 2, 3):
        for places in itertools.combinations(range(23), n):
            error[np.bitwise_xor.reduce(bit[list(places)])] = sum(1 << p for p in places)
    return bit, error


_SYN, _ERR = _syndromes()
_HALF = 12
_SYN_LOW = np.array([np.bitwise_xor.reduce([_SYN[i] for i in range(12) if w >> i & 1] or [0]) for w in range(1 << 12)], np.int32)
_SYN_HIGH = np.array([np.bitwise_xor.reduce([_SYN[12 + i] for i in range(11) if w >> i & 1] or [0]) for w in range(1 << 11)], np.int32)


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the Golay codeword nearest to each 23-bit word (never more than three bits away)."""
    s = _SYN_LOW[words & 0xFFF] ^ _SYN_HIGH[words >> _HALF]
    return (words ^ _ERR[s]) >> 11


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n x 6 codeword indices, n x 6 flags of those in use) of 23-bit words."""
    around = np.concatenate([words[:, None], words[:, None] ^ (1 << np.arange(23, dtype=np.int32))], 1)
    found = np.sort(decode(around), 1)
    fresh = np.ones_like(found, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    rank = np.cumsum(fresh, 1) - 1
    keys, used = np.zeros((len(words), 6), np.int32), np.zeros((len(words), 6), bool)
    row, col = np.nonzero(fresh)
    keys[row, rank[row, col]] = found[row, col]
    used[row, rank[row, col]] = True
    return keys, used


def fingerprints(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(n x 3 fingerprints as uint64, number of distinct words) of texts of at most a slice together."""
    h, lengths, rows = vec.words(*vec.buffers(vec.lower(col)))
    n = len(rows) - 1
    doc = np.repeat(np.arange(n, dtype=np.uint64), np.diff(rows))
    key = (doc << np.uint64(42)) | (h >> np.uint64(26) << np.uint64(4)) | np.minimum(lengths, 15).astype(np.uint64)
    key.sort()
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    at = np.searchsorted(key >> np.uint64(42), np.arange(n + 1, dtype=np.uint64))
    out = np.zeros((n, BITS // 64), np.uint64)
    full = np.flatnonzero(np.diff(at) > 0)
    step = 1 << 15
    totals = np.zeros((n, BITS), np.int32)
    weights = np.zeros(n, np.int64)
    word = key & np.uint64((1 << 42) - 1)
    for lo in range(0, len(key), step):
        part = word[lo : lo + step]
        bits = np.empty((len(part), BITS // 64), np.uint64)
        for k in range(BITS // 64):
            bits[:, k] = vec.mix(part * np.uint64(2 * k + 3) + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (2**64 - 1)))
        flat = np.unpackbits(bits.view(np.uint8), axis=1)
        w = (part & np.uint64(15)).astype(np.uint8)
        flat *= w[:, None]
        first, last = np.searchsorted(at, lo, "right") - 1, np.searchsorted(at, lo + len(part), "left")
        docs = np.arange(first, last)
        docs = docs[(np.minimum(at[docs + 1], lo + len(part)) > np.maximum(at[docs], lo))]
        begin = np.maximum(at[docs], lo) - lo
        totals[docs] += np.add.reduceat(flat, begin, axis=0, dtype=np.uint16 if len(part) * 15 < 65536 else np.int32).astype(np.int32)
        weights[docs] += np.add.reduceat(w, begin, dtype=np.int64)
    if len(full):
        out[full] = np.packbits(2 * totals[full] >= weights[full, None], axis=1).view(np.uint64)
    return out, np.diff(at)


def segments(f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
    """n x 4 words of 23 bits: the first 92 bits of the fingerprints."""
    mask = np.uint64((1 << 23) - 1)
    s = [f0 & mask, f0 >> np.uint64(23) & mask, (f0 >> np.uint64(46)) | ((f1 & np.uint64(31)) << np.uint64(18)), f1 >> np.uint64(5) & mask]
    return np.stack([x.astype(np.int32) for x in s], 1)


def _fingerprint_batches(batches):
    for batch in batches:
        for a, b in vec.slices(batch.column(3)):
            part = batch.slice(a, b - a)
            f, n = fingerprints(part.column(3))
            none = n == 0
            yield pa.record_batch([*part.columns[:3], *(pa.array(f[:, k].view(np.int64), mask=none) for k in range(3))], names=["doc_id", "t0", "t1", "f0", "f1", "f2"])


def _key_batches(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            ids, f0, f1, f2 = (c.to_numpy(zero_copy_only=False) for c in batch.slice(a, 4096).columns)
            seg = segments(f0.view(np.uint64), f1.view(np.uint64))
            check = f1 >> 32 & 0xFFFFFFFF
            keys, used = zip(*(fuzzy_keys(seg[:, k]) for k in range(SEGMENTS)))
            for c, (i, j) in enumerate(PAIRS):
                row, x = np.nonzero(used[i])
                # Codewords in use come first, so their number tells which.
                second = keys[j].astype(np.int64)
                five = sum(second[:, n] << (3 + 12 * n) for n in range(5)) | used[j].sum(1)
                columns = (c << 12) | keys[i][row, x], (second[:, 5] << 32 | check)[row], five[row], f2[row], ids[row]
                yield pa.record_batch([pa.array(columns[0].astype(np.int32)), *map(pa.array, columns[1:])], names=["g", "k", "s", "c", "id"])


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, two hashes of the text, fingerprint) of each row with a doc_id and a text."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), "text").alias("t1"), "text").where("doc_id is not null and text <> ''")
    return rows.mapInArrow(_fingerprint_batches, "doc_id bigint, t0 bigint, t1 bigint, f0 bigint, f1 bigint, f2 bigint")


def similar_pairs(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b, distance), a < b, of the near-duplicates among (id, f0, f1, f2)."""
    # A row is a first codeword with all second ones, and 96 bits of the fingerprint that are in no segment.
    rows = distinct.where("f0 is not null").select("id", "f0", "f1", "f2").mapInArrow(_key_batches, "g int, k bigint, s bigint, c bigint, id bigint").repartition("g")
    second = F.slice(F.array(*(F.shiftright("s", 3 + 12 * n).bitwiseAND(F.lit(4095)) for n in range(5)), F.shiftright("k", 32)), 1, F.col("s").bitwiseAND(F.lit(7)).cast("int"))
    keys = rows.select("g", "k", "c", "id", F.explode(second).alias("y"))
    left, right = keys.toDF("g", "ka", "ca", "a", "y"), keys.toDF("g", "kb", "cb", "b", "y")
    bits = "bit_count((ka ^ kb) & 4294967295L) + bit_count(ca ^ cb)"
    near = left.join(right.hint("merge"), ["g", "y"]).where(F.expr(f"a < b and {bits} <= {max_distance}")).select("a", "b").distinct()
    # Rows are where their first codeword is, which is as good as by both; the join is run while the planner may know.
    conf, name = distinct.sparkSession.conf, "spark.sql.requireAllClusterKeysForCoPartition"
    before = conf.get(name)
    conf.set(name, "false")
    try:
        near = checkpoint(near)
    finally:
        conf.set(name, before)
    f = distinct.select("id", "f0", "f1", "f2")
    near = near.join(f.toDF("a", "a0", "a1", "a2"), "a").join(f.toDF("b", "b0", "b1", "b2"), "b")
    return near.select("a", "b", F.expr("bit_count(a0 ^ b0) + bit_count(a1 ^ b1) + bit_count(a2 ^ b2)").alias("distance")).where(f"distance <= {max_distance}")


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): the least id of the connected component of each id in ``pairs`` (a, b), but for the roots themselves.

    Alternates large-star and small-star steps until no edge changes; each round is written to the shared folder.
    """
    edges = checkpoint(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.union(least.where("u <> m").toDF("u", "v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = checkpoint(joined.select("u", F.col("m").alias("v")).union(joined.select("v", "m")).where("u <> v").distinct())
        now = state(edges)
        if now == seen:
            return edges.toDF("id", "root")
        seen = now


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, kept_doc_id) of every document that copies another; of a group the least doc_id is kept."""
    found = texts(docs)
    found = checkpoint(found)
    distinct = found.groupBy("t0", "t1").agg(F.min("doc_id").alias("id"), *(F.first(f"f{k}").alias(f"f{k}") for k in range(3)))
    roots = components(similar_pairs(distinct.select("id", "f0", "f1", "f2"), max_distance))
    members = found.select("doc_id", "t0", "t1").join(distinct.select("t0", "t1", "id"), ["t0", "t1"])
    linked = members.join(roots, "id", "left").select("doc_id", F.coalesce("root", "id").alias("kept_doc_id"))
    return linked.where("doc_id <> kept_doc_id").groupBy("doc_id").agg(F.min("kept_doc_id").alias("kept_doc_id"))


def deduplicate(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of ``docs`` that copy no kept document, all columns kept."""
    drop = near_duplicates(docs, max_distance).select(F.col("doc_id").alias("__copy"))
    return docs.join(drop, docs["doc_id"] == drop["__copy"], "left_anti")
