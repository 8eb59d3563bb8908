"""Spans of one document: (start, end) in code points, byte offsets by prefix sums, and the rules that join spans."""

from __future__ import annotations

import bisect
import re
from array import array
from collections.abc import Callable

import numpy as np

Span = tuple[int, int]
Size = Callable[[str], int]
_NWS = re.compile(r"[\t\n\x0b\f\r ]")


def nws_bytes(text: str) -> int:
    return len(_NWS.sub("", text).encode("utf-8", "surrogatepass"))


def counter(unit: str, tokenizer: Callable[[str], int] | None = None) -> Size:
    """The size of a text in a unit; tokens are words unless a tokenizer counts them."""
    if unit == "chars":
        return len
    if unit == "nws":
        return lambda t: sum(not c.isspace() for c in t)
    if unit == "tokens":
        return tokenizer or (lambda t: len(t.split()))
    raise ValueError(f"unknown size unit: {unit}")


class Index:
    """Lines and bytes of positions in a text."""

    def __init__(self, text: str):
        self.ascii = text.isascii()
        codes = np.frombuffer(text.encode(), np.uint8) if self.ascii else np.frombuffer(text.encode("utf-32-le"), np.uint32)
        self.newlines = array("q", np.flatnonzero(codes == 10).tobytes())
        if not self.ascii:
            self.bytes = array("q", np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)]).tobytes())

    def line(self, position: int) -> int:
        return bisect.bisect_left(self.newlines, position)

    def byte(self, position: int) -> int:
        return position if self.ascii else self.bytes[position]


def cover(spans: list[Span], n: int) -> list[Span]:
    """Spans that together cover range(n): nested ones go, gaps belong to the span after, the tail to the last."""
    out: list[Span] = []
    at = 0
    for _, end in sorted(spans):
        if end > at:
            out.append((at, min(end, n)))
            at = end
    if at < n:
        out = [*out[:-1], (out[-1][0], n)] if out else [(0, n)]
    return out


def join_blank(text: str, spans: list[Span]) -> list[Span]:
    """Joins spans of white space only to the one before, or the first to the one after."""
    out: list[Span] = []
    for a, b in spans:
        if out and not text[a:b].strip():
            out[-1] = (out[-1][0], b)
        elif out and not text[out[-1][0] : out[-1][1]].strip():
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def greedy(spans: list[Span], sizes: list[int], limit: int) -> list[Span]:
    """Runs of neighbours whose sizes together are within the limit; a larger one stands alone."""
    out: list[Span] = []
    used = 0
    for (a, b), n in zip(spans, sizes):
        if out and used + n <= limit:
            out[-1] = (out[-1][0], b)
            used += n
        else:
            out.append((a, b))
            used = n
    return out


def merge_small(text: str, spans: list[Span], smallest: int, size: Size, fixed: set[Span] = frozenset()) -> list[Span]:
    """Spans under a size take in the next one, the last joins the one before; spans in ``fixed`` stay as they are."""
    out: list[Span] = []
    k = 0
    spans = list(spans)
    while k < len(spans):
        a, b = spans[k]
        while (a, b) not in fixed and size(text[a:b]) < smallest and k + 1 < len(spans) and spans[k + 1] not in fixed:
            k += 1
            b = spans[k][1]
        if (a, b) not in fixed and size(text[a:b]) < smallest and out and k + 1 == len(spans) and out[-1] not in fixed:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        k += 1
    return out
