"""Plain text and Markdown: blocks, headings and pieces of blocks that are too large."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from kerf.kernels.spans import Size, Span

_FENCE = re.compile(r"^[ ]{0,3}(`{3,}|~{3,})[ \t]*([\w+#.-]*)[^\n]*$", re.M)
_HEADING = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+([^\n]*?)[ \t]*#*[ \t]*$", re.M)
_FRONT = re.compile(r"\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")
#: Places to cut: blank lines, lines, sentences, clauses, commas, words and closing brackets, all pooled.
_CUTS = re.compile(r"\n\s*\n|\n|[.!?]+[\"')\]]*\s+|[;:]\s+|,\s+|\s+|[)\]}]")


@dataclass
class Block:
    start: int
    end: int
    kind: str = "paragraph"
    headings: list[str] = field(default_factory=list)
    language: str = ""

    @property
    def span(self) -> Span:
        return self.start, self.end


def paragraphs(text: str, start: int = 0, end: int | None = None) -> list[Block]:
    """Stretches between blank lines."""
    end = len(text) if end is None else end
    out, at = [], start
    for m in re.finditer(r"\n\s*\n", text[start:end]):
        a, b = at, start + m.start()
        if text[a:b].strip():
            out.append(Block(a, b))
        at = start + m.end()
    if text[at:end].strip():
        out.append(Block(at, end))
    return out


def _kind(text: str) -> str:
    lines = [x for x in text.split("\n") if x.strip()]
    if lines and all(_TABLE.match(x) for x in lines):
        return "table"
    return "list" if lines and _LIST.match(lines[0]) else "paragraph"


def markdown(text: str, flat: bool = False) -> list[Block]:
    """Front matter, fenced code, headings, tables, lists and paragraphs, each with the headings that it is under.

    ``flat`` forgets all headings but the one that opens the section, as if a section ended at any next heading.
    """
    fences, pending = [], None
    for m in _FENCE.finditer(text):
        if pending is None:
            pending = m
        elif m[1][0] == pending[1][0] and len(m[1]) >= len(pending[1]) and not m[2]:
            fences.append((pending.start(), m.end(), pending[2].lower()))
            pending = None
    marks: list[Block] = [Block(a, b, "code_block", language=tag) for a, b, tag in fences]
    front = _FRONT.match(text)
    at_front = front.end() if front else 0
    if front:
        marks.append(Block(0, at_front, "frontmatter"))
    inside = sorted(m.span for m in marks)
    k = reach = 0
    for m in _HEADING.finditer(text):
        while k < len(inside) and inside[k][0] <= m.start():
            reach = max(reach, inside[k][1])
            k += 1
        if m.start() >= reach:
            marks.append(Block(m.start(), m.end(), "heading"))
    out: list[Block] = []
    at, stack = 0, []
    for mark in [*sorted(marks, key=lambda b: b.start), Block(len(text), len(text), "end")]:
        path = [t for _, t in stack]
        for p in paragraphs(text, at, mark.start):
            p.kind, p.headings = _kind(text[p.start : p.end]), path
            out.append(p)
        if mark.kind == "heading":
            m = _HEADING.match(text, mark.start)
            level, title = len(m[1]), m[2].strip()
            stack = [] if flat else [x for x in stack if x[0] < level]
            stack.append((level, title))
        if mark.kind != "end":
            mark.headings = [t for _, t in stack]
            out.append(mark)
        at = mark.end
    return out


def split_large(text: str, span: Span, limit: int, size: Size) -> list[Span]:
    """Pieces of a span: each ends at the furthest cut at which it is within the limit, or after as much as fits."""
    start, end = span
    cuts = sorted({*(m.end() for m in _CUTS.finditer(text, start, end)), end})
    out, at, k = [], start, 0
    while at < end:
        while k < len(cuts) and cuts[k] <= at:
            k += 1
        # Sizes only grow with the end, so the furthest cut is found by bisection.
        lo, hi = k, len(cuts)
        step = 1
        while lo + step < hi and size(text[at : cuts[lo + step]]) <= limit:
            step *= 2
        hi = min(hi, lo + step + 1)
        best = None
        while lo < hi:
            mid = (lo + hi) // 2
            if size(text[at : cuts[mid]]) <= limit:
                best, lo = cuts[mid], mid + 1
            else:
                hi = mid
        if best is None:
            a, b = at + 1, cuts[k]
            while a < b:
                mid = b - (b - a) // 2
                if size(text[at:mid]) <= limit:
                    a = mid
                else:
                    b = mid - 1
            best = a
        out.append((at, best))
        at = best
    return out


def windows(text: str, blocks: list[Block], limit: int, size: Size) -> list[tuple[Span, Block]]:
    """Greedy windows over blocks, code blocks and pieces of large ones alone, with the first block of each."""
    out: list[tuple[Span, Block]] = []
    used, open_ = 0, False
    for b in blocks:
        n = size(text[b.start : b.end])
        if b.kind == "code_block":
            out.append((b.span, b))
            open_ = False
        elif n > limit:
            out += [(s, b) for s in split_large(text, b.span, limit, size)]
            open_ = False
        elif open_ and used + n <= limit:
            (a, _), first = out[-1]
            out[-1] = ((a, b.end), first)
            used += n
        else:
            out.append((b.span, b))
            used, open_ = n, True
    return out
