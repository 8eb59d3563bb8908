"""Texts as checksummed blocks of range-coded token ids.

Documents of a partition follow one another, each ended by the end-of-text id, and are cut into
blocks of a fixed number of ids (the last of a partition is shorter).  A block is coded on its own and
carries a CRC-32 of its ids and its bytes; it lists the documents in it, where each
piece begins within its document, and how many ids it has, so that any document can be read from its blocks alone.

Defined cases: a null or empty text is the end-of-text id alone; null doc_ids are listed as nulls; repeated rows
are written as often as they occur; extra columns are ignored; a very long text runs over many blocks;
an empty table gives no blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerf.llm import rangecoder, tokens, vec

#: Blocks that are coded side by side; with BLOCK ids each this bounds a task's memory to about 200 MB.
LANES = 512
SCHEMA = "doc_ids array<bigint>, part_starts array<bigint>, part_sizes array<int>, n_ids int, crc bigint, payload binary"
_NAMES = ["doc_ids", "part_starts", "part_sizes", "n_ids", "crc", "payload"]


class _Writer:
    def __init__(self, block: int):
        self.block = block
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[pa.Array, np.ndarray]] = []
        self.held = 0
        self.done = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.docs.append((doc_ids, np.diff(ends)))
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        """Codes the blocks that are full, or all; ``done`` is what the first document held has in earlier blocks."""
        n = self.held if last else self.held - self.held % self.block
        if not n:
            return None
        ids = np.concatenate(self.ids)
        names = pa.concat_arrays([d for d, _ in self.docs])
        sizes = np.concatenate([s for _, s in self.docs])
        ends = np.cumsum(sizes) - self.done
        begins = ends - sizes
        rows = ([], [], [])
        blocks = []
        for lo in range(0, n, self.block):
            hi = min(lo + self.block, n)
            a, b = np.searchsorted(ends, lo, "right"), np.searchsorted(begins, hi, "left")
            rows[0].append(names.slice(a, b - a).to_pylist())
            rows[1].append(np.maximum(lo - begins[a:b], 0))
            rows[2].append((np.minimum(ends[a:b], hi) - np.maximum(begins[a:b], lo)).astype(np.int32))
            blocks.append(ids[lo:hi])
        payloads = rangecoder.encode_blocks(blocks)
        keep = int(np.searchsorted(ends, n, "right"))
        self.docs = [(names.slice(keep), sizes[keep:])] if keep < len(sizes) else []
        self.done = int(n - begins[keep]) if keep < len(sizes) else 0
        self.ids, self.held = ([ids[n:]], len(ids) - n) if n < len(ids) else ([], 0)
        crc = [rangecoder.checksum(b, p) for b, p in zip(blocks, payloads)]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.binary()]
        return pa.record_batch([pa.array(c, k) for c, k in zip((*rows, [len(b) for b in blocks], crc, payloads), kinds)], names=_NAMES)


def write_blocks(docs: DataFrame, tokenizer: str = tokens.TOKENIZER, block: int = rangecoder.BLOCK, lanes: int = LANES) -> DataFrame:
    """One row for each block of the ids of ``docs`` (doc_id, text), in the order of rows; ``tokenizer`` is read on the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens.codec(tokenizer))

    def run(batches):
        codec, writer = shared.value, _Writer(block)
        for batch in batches:
            for a, b in vec.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                writer.add(part.column(0), *codec.encode(part.column(1)))
                if writer.held >= lanes * block:
                    yield writer.flush(False)
        if (rest := writer.flush(True)) is not None:
            yield rest

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def read_blocks(blocks: DataFrame, lanes: int = LANES) -> DataFrame:
    """(doc_id, part_start, ids) of every piece of a document in ``blocks``; a damaged block is an error."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, lanes):
                rows = batch.slice(at, lanes).to_pylist()
                found = rangecoder.decode_blocks([r["payload"] for r in rows], [r["n_ids"] for r in rows], [r["crc"] for r in rows])
                out: list[tuple] = []
                for r, ids in zip(rows, found):
                    cuts = np.cumsum([0, *r["part_sizes"]])
                    out += [(d, s, ids[x:y].astype(np.int32)) for d, s, x, y in zip(r["doc_ids"], r["part_starts"], cuts, cuts[1:])]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.list_(pa.int32())))], names=["doc_id", "part_start", "ids"])

    return blocks.mapInArrow(run, "doc_id bigint, part_start bigint, ids array<int>")
