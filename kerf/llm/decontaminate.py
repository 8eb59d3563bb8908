"""Benchmark decontamination with spaced seeds.

A spaced seed is a fixed mask of required and ignored token positions.  Every
placement of every mask on a benchmark item and on a training document is hashed;
equal hashes are hits, which tolerate substitutions at ignored positions.  Around
each hit the two texts are aligned without gaps and the best-scoring overlap is
kept (a match scores 1, a substitution ``-penalty``).

Tokens are lower-case runs of letters and digits.  Defined cases: null or empty
texts and items have no tokens and never hit; items of fewer than four tokens are common phrases by which no leak is told, and
never hit; items shorter than the longest mask are searched with all masks that an accepted overlap of theirs can need; repeated rows give their hits once each;
equal items each give a row; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerf.llm import vec

#: Required positions; weight 6 over spans of 9 to 11 tokens, with few shared differences.
MASKS = ("110110011", "1101001011", "11100010101", "10110010011")
MIN_MATCHED, PENALTY, MIN_SHARE, SMALL_ITEM = 12, 1.5, 0.8, 4
#: Placed hashes of the benchmark that are sent to every executor; a larger benchmark is joined by shuffle instead.
BROADCAST_HASHES = 4_000_000
SCHEMA = "doc_id bigint, item_id bigint, doc_start int, item_start int, n_tokens int, n_matched int"
_BITS = 22


def _positions(mask: str) -> list[int]:
    return [i for i, c in enumerate(mask) if c == "1"]


def short_masks(n: int) -> set[str]:
    """Masks for an item of ``n`` tokens: all with as many positions left out as an accepted overlap may miss, without ignored ends."""
    if n < SMALL_ITEM:
        return set()
    missed = n - math.ceil(MIN_SHARE * n)
    return {"".join("0" if i in out else "1" for i in range(n)).strip("0") for out in itertools.combinations(range(n), missed)}


def _multiplier(k: int) -> np.uint64:
    return np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & (2**64 - 1))


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of ``mask`` at each start in the token hashes ``h``; mask identity is part of it."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(int(mask, 2) + len(mask) * 7919), np.uint64)
    for k, p in enumerate(_positions(mask)):
        out += h[p : p + n] * _multiplier(k)
    out *= np.uint64(0x9FB21C651E98DF25)
    out ^= out >> np.uint64(32)
    return out


def overlap(doc: np.ndarray, item: np.ndarray, diagonal: int) -> tuple[int, int, int, int, float] | None:
    """The best ungapped overlap on ``diagonal`` (document position minus item position): (doc start, item start, tokens, matched, score)."""
    lo, hi = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    if hi <= lo:
        return None
    same = doc[lo + diagonal : hi + diagonal] == item[lo:hi]
    total = np.concatenate(([0.0], np.cumsum(np.where(same, 1.0, -PENALTY))))
    floor = np.minimum.accumulate(total)
    end = int(np.argmax(total - floor))
    start = int(np.flatnonzero(total[: end + 1] == floor[end])[-1])
    if end <= start:
        return None
    return lo + diagonal + start, lo + start, end - start, int(same[start:end].sum()), float(total[end] - total[start])


def accepted(found: tuple, n_item: int) -> bool:
    """Whether an overlap counts: enough matched tokens, or most of an item (of four tokens at least)."""
    return found[3] >= MIN_MATCHED or (n_item >= SMALL_ITEM and found[3] >= MIN_SHARE * n_item)


class Index:
    """The placed hashes of all benchmark items, for searching whole corpora."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = [(k, h) for k, h in items if len(h)]
        short = {len(h) for _, h in self.items if len(h) < max(map(len, MASKS))}
        by_length = {n: short_masks(n) for n in short}
        self.masks = [*MASKS, *sorted(set().union(*by_length.values()))]
        self.placed = []
        for mask in self.masks:
            rows = [(i, s) for i, (_, h) in enumerate(self.items) if mask in MASKS or mask in by_length.get(len(h), ()) for s in [seeds(h, mask)] if len(s)]
            if not rows:
                self.placed.append(None)
                continue
            key = np.concatenate([s for _, s in rows])
            item = np.concatenate([np.full(len(s), i, np.int32) for i, s in rows])
            at = np.concatenate([np.arange(len(s), dtype=np.int32) for _, s in rows])
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _BITS, bool)
            seen[key >> np.uint64(64 - _BITS)] = True
            self.placed.append((key[order], item[order], at[order], seen))

    def candidates(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document position, item, item position) of every hit."""
        out = []
        for mask, placed in zip(self.masks, self.placed):
            if placed is None:
                continue
            key, item, at, seen = placed
            s = seeds(h, mask)
            where = np.flatnonzero(seen[s >> np.uint64(64 - _BITS)])
            left, right = np.searchsorted(key, s[where], "left"), np.searchsorted(key, s[where], "right")
            n = right - left
            if n.any():
                k = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                out.append((np.repeat(where, n), item[k], at[k]))
        return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3

    def search(self, h: np.ndarray, rows: np.ndarray) -> Iterator[tuple]:
        """(row, item id, doc start, item start, tokens, matched) for each row and item with an accepted overlap: the best one."""
        pos, item, at = self.candidates(h)
        if not len(pos):
            return
        row = np.searchsorted(rows, pos, "right") - 1
        diagonal = pos - rows[row] - at
        best: dict[tuple[int, int], tuple] = {}
        for r, i, d in np.unique(np.stack([row, item, diagonal], 1), axis=0).tolist():
            found = overlap(h[rows[r] : rows[r + 1]], self.items[i][1], d)
            if found and accepted(found, len(self.items[i][1])):
                rank = (found[4], found[3], -found[0], -found[1])
                if (r, i) not in best or rank > best[r, i][0]:
                    best[r, i] = (rank, found)
        for (r, i), (_, found) in sorted(best.items()):
            yield r, self.items[i][0], *found[:4]


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = ["doc_id", "item_id", "doc_start", "item_start", "n_tokens", "n_matched"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=names)


def _hashed(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, token hashes, row offsets) of slices of a batch of (id, text)."""
    for a, b in vec.slices(batch.column(1)):
        part = batch.slice(a, b - a)
        h, _, rows = vec.words(*vec.buffers(vec.lower(part.column(1))))
        yield part.column(0), h, rows


def find_overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """Accepted overlaps of ``docs`` (doc_id, text) with ``benchmark`` (item_id, text): at most one row for a document row and an item.

    The benchmark's size is measured first: up to ``broadcast_hashes`` placed hashes the index goes to every
    executor and the corpus is read once, without a shuffle; beyond it, hashes are joined by shuffle.
    """
    return _find(docs.select("doc_id", "text"), benchmark, broadcast_hashes)


def _find(docs: DataFrame, benchmark: DataFrame, broadcast_hashes: int) -> DataFrame:
    spark = docs.sparkSession
    benchmark = benchmark.select("item_id", "text").where("text is not null")
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    if size * len(MASKS) // 2 <= broadcast_hashes:
        rows = benchmark.collect()
        shared = spark.sparkContext.broadcast(Index(list(zip([r.item_id for r in rows], vec.word_hashes([r.text for r in rows])))))

        def scan(batches):
            for batch in batches:
                for ids, h, at in _hashed(batch):
                    found = [(ids[r].as_py(), *x) for r, *x in shared.value.search(h, at)]
                    if found:
                        yield _arrow(found)

        return docs.mapInArrow(scan, SCHEMA)
    return _by_shuffle(spark, docs, benchmark)


def _by_shuffle(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Hits by an equi-join of placed hashes; the texts join only the hits."""
    short = benchmark.select(F.size(F.expr("regexp_extract_all(lower(text), '[0-9a-z\\\\x{80}-\\\\x{10FFFF}]+', 0)")).alias("n")).where(f"n > 0 and n < {max(map(len, MASKS))}")
    by_length = {r.n: short_masks(r.n) for r in short.distinct().collect()}
    masks = [*MASKS, *sorted(set().union(*by_length.values()))]

    def place(batches):
        for batch in batches:
            for ids, h, rows in _hashed(batch):
                for mask in masks:
                    s = seeds(h, mask)
                    row = np.searchsorted(rows, np.arange(len(s)), "right") - 1
                    whole = np.arange(len(s)) + len(mask) <= rows[row + 1] if len(s) else np.zeros(0, bool)
                    if len(s) and mask not in MASKS and batch.schema.names[0] == "item_key":
                        whole &= np.isin(rows[row + 1] - rows[row], [n for n, some in by_length.items() if mask in some])
                    keep = np.flatnonzero(whole)
                    yield pa.record_batch([pa.array(s[keep].view(np.int64)), ids.take(pa.array(row[keep])), pa.array((keep - rows[row[keep]]).astype(np.int32))], names=["h", "id", "at"])

    placed = "h bigint, id bigint, at int"
    key = F.xxhash64("text", "doc_id")
    numbered = docs.where("text is not null").withColumn("copy", key)
    train = numbered.select("copy", "text").distinct().mapInArrow(place, placed).withColumnRenamed("id", "copy")
    # Items are known by their rows' hash, as ids may be null; equal rows each join and give a row.
    named = benchmark.withColumn("item_key", F.xxhash64("text", "item_id"))
    test = named.select("item_key", "text").distinct().mapInArrow(place, placed).withColumnsRenamed({"id": "item_key", "at": "item_at"})
    hits = train.join(test, "h").select("copy", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = hits.groupBy("copy", "item_key").agg(F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    wide = hits.join(numbered, "copy").join(named.select("item_key", "item_id", F.col("text").alias("item")), "item_key")

    def verify(batches):
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                h, item = vec.word_hashes([r["text"], r["item"]])
                all_ = [x for d in r["diagonals"] if (x := overlap(h, item, d)) and accepted(x, len(item))]
                if all_:
                    found.append((r["doc_id"], r["item_id"], *max(all_, key=lambda x: (x[4], x[3], -x[0], -x[1]))[:4]))
            yield _arrow(found)

    return wide.select("doc_id", "item_id", "text", "item", "diagonals").mapInArrow(verify, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_hashes: int = BROADCAST_HASHES) -> DataFrame:
    """The rows of ``docs`` without an accepted overlap, all columns kept; each row is judged by its own text."""
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text").where("text is not null")
    bad = _find(keyed, benchmark, broadcast_hashes).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["__leak"], "left_anti")
