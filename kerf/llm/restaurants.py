"""Perplexities under a hierarchical Pitman-Yor model of token ids, whose restaurants are spread over the cluster.

A context of two ids is a restaurant, whose parent is the context of the last id alone; the base measure of that
one is the ids' frequency in the corpus, over the whole vocabulary of the byte-level tokenizer, so that no two symbols
are one.  Texts are tokenized once, into chunks of a bounded number of ids that are written to the shared folder.  Each
chunk sends its different grams (two ids of context and one) with their counts to buckets by the last context id, so a bucket holds all of its
restaurants and their parents, and cells grow with the corpus.  A bucket adds up its cells, samples their seatings as
``pitmanyor`` does, and sends each chunk the log probabilities of the grams that it asked for; with them the chunk's
texts are scored.  What is sent is one entry for a gram and a chunk, whatever the number of buckets.
Where one id has more than a bucket's positions, it is a context together with a class of the id before it: its
restaurant is one for each class, so no bucket grows with the corpus but their number does.

Only the counts of single ids (as many as the tokenizer has) come to the driver.

Defined cases: a null text counts as an empty one; both have no tokens and a null perplexity; equal texts have equal results, and count as
often as they occur; before a text there are end-of-text ids, and the one that ends it is counted but not scored; null doc_ids are kept; extra
columns are ignored; generators are seeded by bucket; log probabilities are rounded to 1/2048 before they are added up; a very long text is a chunk of its own;
an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm import pitmanyor, tokens, vec
from kerf.plans.session import checkpoint

SIZE = 1 << 16
SWEEPS, BURN_IN = 3, 1
#: Positions of a bucket at most, on average, and ids of a chunk, if it isn't a single text.
BUCKET, CHUNK = 6_000_000, 4_000_000
#: Log probabilities are multiples of this; the least that can be told is 32 below none.
_STEP = 2048.0
_CODEC = "zstd"
_CHUNKS = "chunk bigint, doc_ids array<bigint>, n bigint, lengths binary, ids binary"
_PACKETS = "bucket bigint, chunk bigint, n bigint, packed binary"


class Model(pitmanyor.Model):
    """Restaurants of one and two ids under a given distribution of single ids."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, root: np.ndarray, seed: int):
        self.root = root
        super().__init__(grams, counts, 3, SIZE, seed)

    def base(self, k: int) -> np.ndarray:
        p = self.root[self.cells[0]]
        for level in range(k):
            p = self.predict(level, p)[self.up[level + 1]]
        return p

    def predict(self, k: int, parent: np.ndarray) -> np.ndarray:
        return parent if k == 0 else super().predict(k, parent)


def probabilities(grams: np.ndarray, counts: np.ndarray, root: np.ndarray, sweeps: int = SWEEPS, burn_in: int = BURN_IN, seed: int = 1) -> np.ndarray:
    """The averaged predictive probability of each gram (two ids of context and one); grams ascend."""
    model = Model(grams, counts, root, seed)
    total = np.zeros(len(grams))
    for s in range(sweeps):
        model.sweep()
        if s >= burn_in:
            total += model.predict(2, model.base(2))
    return total / (sweeps - burn_in)


def _mixed(x: np.ndarray, by: int) -> np.ndarray:
    """A hash of integers."""
    return vec.mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(by))


def _pack(*columns: np.ndarray) -> bytes:
    return pa.compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns), _CODEC, asbytes=True)


def _unpack(packed: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize * n for k in kinds]
    raw = pa.decompress(packed, sum(sizes), _CODEC, asbytes=True)
    return [np.frombuffer(raw, k, n, at) for k, at in zip(kinds, np.cumsum([0, *sizes]).tolist())]


def chunks(docs: DataFrame, codec: tokens.Codec, size: int = CHUNK) -> DataFrame:
    """Rows of texts as ids, written to the shared folder: a chunk's number must stay the same for all who read it."""
    shared = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches):
        first, k = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def row():
            names, ids, lengths = (pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held]))
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary())
            return pa.record_batch([pa.array([v], t) for v, t in zip((first + k, names.to_pylist(), len(ids), _pack(lengths), _pack(ids)), kinds)], names=["chunk", "doc_ids", "n", "lengths", "ids"])

        for batch in batches:
            for a, b in vec.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                ids, ends = shared.value.encode(part.column(1))
                if held and sum(len(h[1]) for h in held) + len(ids) > size:
                    yield row()
                    held, k = [], k + 1
                held.append((part.column(0), ids, np.diff(ends).astype(np.int64)))
        if held:
            yield row()

    return checkpoint(docs.select("doc_id", "text").mapInArrow(run, _CHUNKS))


def unigrams(found: DataFrame) -> np.ndarray:
    """How often each id occurs in all chunks."""

    def run(batches):
        total = np.zeros(SIZE, np.int64)
        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                total += np.bincount(_unpack(ids.as_py(), n, np.uint16)[0], minlength=SIZE)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["id", "n"])

    out = np.zeros(SIZE, np.int64)
    for r in found.select("n", "ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def _grams(ids: np.ndarray, lengths: np.ndarray, eot: int) -> np.ndarray:
    """The last id of the context, the one before it and the id itself, of each position, as one number."""
    begin = np.cumsum(lengths) - lengths
    a = np.empty(len(ids), np.int64)
    a[1:] = ids[:-1]
    a[begin] = eot
    b = np.empty(len(ids), np.int64)
    b[1:] = a[:-1]
    b[begin] = eot
    a <<= 32
    b <<= 16
    a |= b
    a |= ids
    return a


def _buckets(grams: np.ndarray, parts: np.ndarray, buckets: int) -> np.ndarray:
    last, before = grams >> 32, grams >> 16 & 0xFFFF
    hot = parts[last] > 1
    key = last << 32
    if hot.any():
        key[hot] |= (_mixed(before[hot], 1) % parts[last[hot]]).astype(np.int64)
    return (_mixed(key, 2) % np.uint64(buckets)).astype(np.int64)


def perplexities(docs: DataFrame, bucket: int = BUCKET, sweeps: int = SWEEPS, burn_in: int = BURN_IN, tokenizer: str = tokens.TOKENIZER, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_symbols, log_prob, perplexity) of every row over its whole text, under the model of all rows."""
    codec = tokens.codec(tokenizer)
    eot, context = codec.eot, docs.sparkSession.sparkContext
    found = chunks(docs, codec, chunk)
    counts = unigrams(found)
    # Every id of the tokenizer has a share, so any text has a probability.
    root = np.zeros(SIZE)
    root[: eot + 1] = (counts[: eot + 1] + 0.5) / (counts.sum() + 0.5 * (eot + 1))
    buckets = int(counts.sum()) // bucket + context.defaultParallelism
    parts = np.maximum(1, -(-counts // bucket)).astype(np.uint64)
    shared = context.broadcast((root, parts))

    def asked(ids: np.ndarray, lengths: np.ndarray, **options):
        """(different grams and what else was wanted of them, the order in which buckets get them, their buckets in that order)."""
        grams, *rest = np.unique(_grams(ids, lengths, eot), **options)
        to = _buckets(grams, shared.value[1], buckets)
        order = np.argsort(to, kind="stable")
        return grams, *rest, order, to[order]

    def read(batch):
        """(chunk, ids, lengths) of each row."""
        for number, names, n, lengths, ids in zip(*(batch.column(c) for c in ("chunk", "doc_ids", "n", "lengths", "ids"))):
            yield number.as_py(), names, _unpack(ids.as_py(), n.as_py(), np.uint16)[0], _unpack(lengths.as_py(), len(names), np.int64)[0]

    def spread(batches):
        for batch in batches:
            for number, _, ids, lengths in read(batch):
                grams, times, order, to = asked(ids, lengths, return_counts=True)
                grams, times = grams[order], times[order].astype(np.uint32)
                edges = np.flatnonzero(np.diff(to, prepend=-1))
                out = [(int(to[x]), number, int(y - x), _pack((grams[x:y] >> 32).astype(np.uint16), (grams[x:y] >> 16).astype(np.uint16), grams[x:y].astype(np.uint16), times[x:y])) for x, y in zip(edges, [*edges[1:], len(to)])]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "chunk", "n", "packed"])

    def fit(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_pylist()
        grams, times = [], []
        for n, packed in zip(sizes, table.column("packed")):
            a, b, w, t = _unpack(packed.as_py(), n, np.uint16, np.uint16, np.uint16, np.uint32)
            grams.append(b.astype(np.int64) << 32 | a.astype(np.int64) << 16 | w)
            times.append(t)
        cells, which = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.bincount(which, np.concatenate(times)).astype(np.int64)
        del grams, times
        p = probabilities(cells, counts, shared.value[0], sweeps, burn_in, int(table.column("bucket")[0].as_py()))
        rounded = np.minimum(np.round(-np.log(p) * _STEP), SIZE - 1).astype(np.uint16)[which]
        packed = [_pack(rounded[y - n : y]) for n, y in zip(sizes, np.cumsum(sizes).tolist())]
        return pa.table({"bucket": table.column("bucket"), "chunk": table.column("chunk"), "n": table.column("n"), "packed": pa.array(packed, pa.binary())})

    def score(batches):
        for batch in batches:
            for (_, names, ids, lengths), packets in zip(read(batch), batch.column("packets").to_pylist()):
                grams, which, order, _ = asked(ids, lengths, return_inverse=True)
                packets.sort(key=lambda r: r["bucket"])
                logs = np.empty(len(grams))
                logs[order] = np.concatenate([_unpack(r["packed"], r["n"], np.uint16)[0] for r in packets]) / -_STEP
                each = logs[which]
                each[np.cumsum(lengths) - 1] = 0
                total = np.add.reduceat(each, np.cumsum(lengths) - lengths)
                n = lengths - 1
                with np.errstate(invalid="ignore", divide="ignore"):
                    perplexity = np.exp(-total / n)
                yield pa.record_batch([names.values, pa.array(n.astype(np.int32)), pa.array(total, mask=n == 0), pa.array(perplexity, mask=n == 0)], names=["doc_id", "n_symbols", "log_prob", "perplexity"])

    answers = found.mapInArrow(spread, _PACKETS).groupBy("bucket").applyInArrow(fit, _PACKETS)
    answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "packed")).alias("packets")).withColumnRenamed("chunk", "of")
    return found.join(answers, F.col("chunk") == F.col("of")).drop("of").mapInArrow(score, "doc_id bigint, n_symbols int, log_prob double, perplexity double")
