"""Documents that hold segments of prose and code: notebooks, LaTeX, PDF and Word files."""

from __future__ import annotations

import io
import json
import re
from dataclasses import dataclass, field

from kerf.kernels.spans import Span

_ENVIRONMENT = re.compile(r"\\begin\{(minted|verbatim|lstlisting)\*?\}.*?\\end\{\1\*?\}", re.S)
_SECTION = re.compile(r"^[ \t]*\\(?:part|chapter|(?:sub){0,2}section|paragraph)\*?\{", re.M)


@dataclass
class Loaded:
    text: str
    segments: list[tuple[Span, str, dict]]
    format: str
    warnings: list[str] = field(default_factory=list)


def _joined(parts: list[tuple[str, str, dict]], kind: str, gap: str = "\n\n", warnings: list[str] | None = None) -> Loaded:
    text, segments = "", []
    for part, what, meta in parts:
        if not part:
            continue
        text += gap if text else ""
        segments.append(((len(text), len(text) + len(part)), what, meta))
        text += part
    return Loaded(text, segments, kind, warnings or [])


def notebook(content: str) -> Loaded:
    """Cells of a notebook in order, code cells followed by their text outputs; what can't be read is a warning."""
    try:
        data = json.loads(content)
        cells = data.get("cells", []) if isinstance(data, dict) else []
    except ValueError as e:
        return Loaded(content, [((0, len(content)), "prose", {})], "ipynb", [f"not a notebook: {e}"])
    kernel = ((data.get("metadata") or {}).get("kernelspec") or {}) if isinstance(data, dict) else {}
    language = str(kernel.get("language") or "python").lower()
    parts, warnings = [], []

    def text_of(x) -> str:
        return "".join(x) if isinstance(x, list) else str(x or "")

    for k, cell in enumerate(cells):
        kind = cell.get("cell_type") if isinstance(cell, dict) else None
        if kind not in ("markdown", "code", "raw"):
            warnings.append(f"cell {k}: unknown type {kind}")
            continue
        meta = {"cell": str(k), "cell_type": kind}
        parts.append((text_of(cell.get("source")), "code" if kind == "code" else "prose", meta | ({"language": language} if kind == "code" else {})))
        for out in cell.get("outputs", []) if kind == "code" else ():
            said = text_of(out.get("text") or (out.get("data") or {}).get("text/plain"))
            parts.append((said, "prose", meta | {"cell_type": "output"}))
    return _joined(parts, "ipynb", warnings=warnings)


def latex(content: str) -> Loaded:
    """Listings are code; the rest is prose, cut at sections."""
    segments: list[tuple[Span, str, dict]] = []
    at = 0

    def prose(a: int, b: int) -> None:
        cuts = [a, *(m.start() for m in _SECTION.finditer(content, a, b) if m.start() > a), b]
        segments.extend(((x, y), "prose", {}) for x, y in zip(cuts, cuts[1:]) if y > x)

    for m in _ENVIRONMENT.finditer(content):
        prose(at, m.start())
        segments.append(((m.start(), m.end()), "code", {"environment": m[1]}))
        at = m.end()
    prose(at, len(content))
    warnings = [f"unbalanced {e}" for e in ("lstlisting", "verbatim", "minted") if content.count(f"\\begin{{{e}}}") != content.count(f"\\end{{{e}}}")]
    return Loaded(content, segments, "tex", warnings)


def looks_like_code(text: str) -> bool:
    lines = [x for x in text.split("\n") if x.strip()]
    return bool(lines) and sum(bool(re.search(r"[;{}]\s*$|^\s*(?:def|class|import|from|return|if|for)\b|=\s*\S", x)) for x in lines) > 0.5 * len(lines)


def pdf(data: bytes) -> Loaded:
    """Page texts; needs pypdf."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ImportError("reading PDF needs the package pypdf") from e
    parts = []
    for k, page in enumerate(PdfReader(io.BytesIO(data)).pages, 1):
        text = page.extract_text() or ""
        parts.append((text if k == 1 else f"--- page {k} ---\n\n{text}", "code" if looks_like_code(text) else "prose", {"page": str(k)}))
    return _joined(parts, "pdf")


def docx(data: bytes) -> Loaded:
    """Paragraphs and tables as lines of tab-separated cells; needs python-docx."""
    try:
        from docx import Document
    except ImportError as e:
        raise ImportError("reading Word files needs the package python-docx") from e
    doc = Document(io.BytesIO(data))
    parts = [(p.text, "prose", {"style": p.style.name}) for p in doc.paragraphs if p.text.strip()]
    parts += [("\n".join("\t".join(c.text for c in row.cells) for row in t.rows), "prose", {"table": "true"}) for t in doc.tables]
    return _joined(parts, "docx")
