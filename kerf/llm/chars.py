"""Character n-gram counts over whole corpora.

Texts are mapped to a small alphabet and n-grams are counted as numbers, with one
bincount for each slice of texts; a task emits the cells that are not zero, and
these are added up by an ordinary aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm import vec

#: 0: white space and the edges of texts; 1-26: letters; 27: digits; 28: punctuation; 29-46: frequent letters with
#: marks; 47: any other character.
MARKED = "äöüßéèêëàâçñóíáúôî"
SIZE = 48
_ASCII = np.full(256, 28, np.uint8)
_ASCII[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 0
_ASCII[97:123] = np.arange(1, 27)
_ASCII[65:91] = np.arange(1, 27)
_ASCII[48:58] = 27
_ASCII[128:192] = 255
_ASCII[192:] = 47
_SECOND = np.full(128 * 64, 47, np.uint8)
for _i, _c in enumerate(MARKED):
    _a, _b = _c.encode()
    _SECOND[(_a - 192) * 64 + _b - 128] = 29 + _i
    _a, _b = _c.upper().encode() if _c != "ß" else _c.encode()
    _SECOND[(_a - 192) * 64 + _b - 128] = 29 + _i


def codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the characters, row offsets): case is folded, and each character is one code."""
    out = _ASCII[raw]
    lead = np.flatnonzero((raw >= 0xC3) & (raw < 0xE0))
    lead = lead[lead + 1 < len(raw)]
    if len(lead):
        follow = raw[lead + 1]
        ok = (follow & 0xC0) == 0x80
        lead, follow = lead[ok], follow[ok]
        out[lead] = _SECOND[(raw[lead].astype(np.int32) - 192) * 64 + (follow & 63)]
    keep = out != 255
    before = np.concatenate(([0], np.cumsum(keep)))
    return out[keep], before[offsets]


def ngrams(code: np.ndarray, rows: np.ndarray, order: int) -> np.ndarray:
    """The number, in base SIZE, of the n-gram that ends at each character; before a text there is white space."""
    out = code.astype(np.int32)
    first = np.full(len(code), False)
    at = rows[:-1][rows[:-1] < len(code)]
    previous = code
    blocked = first
    for k in range(1, order):
        moved = np.zeros_like(previous)
        moved[1:] = previous[:-1]
        moved[at] = 0
        previous = moved
        out += previous.astype(np.int32) * SIZE**k
    return out


def count(docs: DataFrame, order: int, text: str = "text") -> DataFrame:
    """(gram, n) of all n-grams of all texts; null and empty texts have none."""

    def run(batches):
        total = np.zeros(SIZE**order, np.int64)
        for batch in batches:
            for a, b in vec.slices(batch.column(0)):
                code, rows = codes(*vec.buffers(batch.column(0).slice(a, b - a)))
                if len(code):
                    total += np.bincount(ngrams(code, rows, order), minlength=len(total))
        found = np.flatnonzero(total)
        if len(found):
            yield pa.record_batch([pa.array(found), pa.array(total[found])], names=["gram", "n"])

    return docs.select(F.col(text)).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
