"""One document to its chunks: detection, segmentation, packing and context, without Spark.

Chunks cover the document's bytes without gap or overlap, none is blank unless the document is, and equal inputs give
equal chunks.  A document of white space only, an empty or a null one has no chunks.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

from kerf.functions import detect
from kerf.kernels import code, formats, markup, prose, spans
from kerf.kernels.spans import Index, Span
from kerf.plans.options import Options

PARSERS: dict = {}
_SENTENCE = re.compile(r"\n{2,}|(?<=[!?.])\s+(?=[\[(\"'A-Z])")
_FENCE_TAGS = detect.EXTENSIONS | {"shell": "bash", "golang": "go", "python3": "python", "c++": "cpp"}


def resolve_tokenizer(tokenizer):
    """A function from texts to counts: words, a function, an object with ``encode``, or a tiktoken encoding's name."""
    if tokenizer is None or (callable(tokenizer) and not hasattr(tokenizer, "encode")):
        return tokenizer
    if hasattr(tokenizer, "encode"):
        return lambda t: len(tokenizer.encode(t))
    if not isinstance(tokenizer, str):
        raise TypeError("a tokenizer is a function, an encoder or a name")
    import tiktoken

    encoding = tiktoken.get_encoding(tokenizer)
    return lambda t: len(encoding.encode_ordinary(t))


class _Draft:
    """A chunk before it is numbered.  A document may have many: what they have alike is one object, which nobody changes."""

    __slots__ = ("span", "language", "kind", "context", "crumb")

    def __init__(self, span: Span, language: str, kind: str, context: dict, crumb: list[str] | None = None):
        self.span, self.language, self.kind, self.context, self.crumb = span, language, kind, context, crumb


@lru_cache(1024)
def _told(section_type: str, headings: tuple[str, ...] = ()) -> dict:
    return {"headings": list(headings), "breadcrumb": list(headings), "section_type": section_type}


_NO_ENTITIES = code.Found([])
_PLAIN_CODE = {"section_type": "code"}


def sentence_spans(text: str, splitter=None) -> list[Span]:
    """Where sentences are, which together cover the text; those of a caller's splitter are looked for in order."""
    if splitter is None:
        cuts = [0, *(m.end() for m in _SENTENCE.finditer(text)), len(text)]
        return [(x, y) for x, y in zip(cuts, cuts[1:]) if y > x]
    starts, at = [], 0
    for said in splitter(text):
        k = text.find(said, at) if said else -1
        if k >= 0:
            starts.append(k)
            at = k + len(said)
    cuts = [0, *starts[1:], len(text)]
    return [(x, y) for x, y in zip(cuts, cuts[1:]) if y > x]


def boundaries(sentences: list[str], embed, window: int, threshold: float, least: int) -> list[int]:
    """The sentences behind which a part ends: where the surroundings of neighbours are unlike, or less alike than on both sides."""
    import numpy as np

    half = window // 2
    vectors = np.asarray(embed(["".join(sentences[max(0, i - half) : i + half + 1]) for i in range(len(sentences))]), float)
    if vectors.ndim != 2 or len(vectors) != len(sentences):
        raise ValueError("semantic_embed_fn gives one vector for each text")
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.where(norm == 0, 1, norm)
    near = (unit[:-1] * unit[1:]).sum(1)
    out, last = [], -1
    for k, s in enumerate(near):
        valley = 0 < k < len(near) - 1 and s < near[k - 1] and s < near[k + 1]
        if (s < threshold or valley) and k - last >= least:
            out.append(k)
            last = k
    return out


def _semantic(text: str, span: Span, language: str, o: Options, size) -> list[_Draft]:
    """Parts between semantic boundaries; one that is too large is halved by sentences, and a sentence that is cut."""
    a, b = span
    body = text[a:b]
    found = sentence_spans(body, o.semantic_sentence_splitter)
    ends = boundaries([body[x:y] for x, y in found], o.semantic_embed_fn, o.semantic_window, o.semantic_threshold, max(1, o.semantic_min_sentences)) if len(found) > 1 else []
    pieces: list[Span] = []

    def halve(i: int, j: int) -> None:
        whole = found[i][0], found[j - 1][1]
        if size(body[whole[0] : whole[1]]) <= o.max_chunk_size:
            pieces.append(whole)
        elif j - i > 1:
            middle = (i + j) // 2
            halve(i, middle)
            halve(middle, j)
        else:
            pieces.extend(prose.split_large(body, whole, o.max_chunk_size, size))

    cuts = [0, *(k + 1 for k in ends), len(found)]
    for i, j in zip(cuts, cuts[1:]):
        halve(i, j)
    return [_Draft((a + x, a + y), language, "prose", _told("semantic")) for x, y in spans.join_blank(body, pieces)]


def _prose(text: str, span: Span, language: str, o: Options, size, flat: bool, path: str = "") -> list[_Draft]:
    if o.semantic:
        return _semantic(text, span, language, o, size)
    a, b = span
    body = text[a:b]
    blocks = prose.markdown(body, flat) if language == "markdown" else prose.paragraphs(body)
    found = prose.windows(body, blocks, o.max_chunk_size, size)
    # Front matter and what follows may overlap; a window ends where it ends and begins where the one before ended.
    by_end: dict[int, prose.Block] = {}
    ends: list[Span] = []
    at = 0
    for (x, y), block in found:
        if y > at:
            ends.append((at, y))
            by_end[y] = block
            at = y
    covered = spans.cover(ends, len(body))
    fixed = {s for s in covered if by_end.get(s[1]) and by_end[s[1]].kind == "code_block"}
    covered = spans.merge_small(body, covered, o.min_chunk_size, size, fixed)
    covered = spans.join_blank(body, covered)
    out = []
    marks = sorted(by_end)
    for x, y in covered:
        inside = [by_end[e] for e in marks[bisect.bisect_right(marks, x) : bisect.bisect_right(marks, y)]]
        headings = next((k.headings for k in inside if k.headings), [])
        kind = inside[0].kind if inside else "paragraph"
        if kind == "code_block" and inside[0].language:
            tag = _FENCE_TAGS.get(inside[0].language, inside[0].language)
            inner = _fenced(text, (a + x, a + y), tag, o, size, headings, path)
            if inner:
                out += inner
                continue
        out.append(_Draft((a + x, a + y), language, "prose", _told(kind, tuple(headings))))
    return out


def _fenced(text: str, span: Span, tag: str, o: Options, size, headings: list[str], path: str) -> list[_Draft]:
    """A fence in a known language by that language's engine; its opening line stays with the first, its closing with the last chunk."""
    if tag not in code._C_LIKE and tag != "python" and tag not in detect.MARKUP:
        return []
    a, b = span
    open_ = text.find("\n", a + len(text[a:b]) - len(text[a:b].lstrip())) + 1
    close = text.rfind("\n", a, a + len(text[a:b].rstrip())) + 1
    if not a < open_ < close or not text[open_:close].strip():
        return []
    drafts = _markup(text, (open_, close), tag, o, size) if tag in detect.MARKUP else _code(text, (open_, close), tag, o, size, path)
    told, plain = {"headings": headings, "section_type": "code_block"}, drafts[0].context if tag in detect.MARKUP else None
    drafts[0].span = (a, drafts[0].span[1])
    drafts[-1].span = (drafts[-1].span[0], b)
    for d in drafts:
        d.crumb = [*headings, *(d.crumb or d.context.get("breadcrumb", []))]
        d.context = told if d.context is plain else d.context | told
    return drafts


def _markup(text: str, span: Span, language: str, o: Options, size) -> list[_Draft]:
    a, b = span
    body = text[a:b]
    found = markup.normalise(markup.sections(body, language), len(body))
    merged: list[tuple[Span, list[str]]] = []
    for s, crumb in found:
        if merged and s[1] - merged[-1][0][0] <= o.max_chunk_size:
            merged[-1] = ((merged[-1][0][0], s[1]), merged[-1][1] or crumb)
        else:
            merged.append((s, crumb))
    if o.split_oversize:
        merged = [(p, c) for s, c in merged for p in ([s] if s[1] - s[0] <= o.max_chunk_size else prose.split_large(body, s, o.max_chunk_size, len))]
    by_start = {s[0]: c for s, c in merged}
    covered = spans.merge_small(body, [s for s, _ in merged], o.min_chunk_size, len)
    covered = spans.join_blank(body, covered)
    told = {"section_type": language}
    return [_Draft((a + x, a + y), language, "markup", told, by_start.get(x, [])) for x, y in covered]


def _code(text: str, span: Span, language: str, o: Options, size, path: str) -> list[_Draft]:
    a, b = span
    body = text[a:b]
    entities, imports, tops, errors = code.parse(body, language, PARSERS.get(language), path)
    limit = o.max_chunk_size * 4 if o.size_unit == "tokens" else o.max_chunk_size
    smallest = o.min_chunk_size * 4 if o.size_unit == "tokens" else o.min_chunk_size
    statements = spans.cover(tops, len(body)) if body else []
    covered = spans.cover(code.windows(body, statements, entities, limit, smallest), len(body))
    covered = spans.join_blank(body, covered)
    for e in entities:
        e.start, e.end = e.start + a, e.end + a
    context = {"entities": code.Found(entities), "imports": imports, "errors": errors, "section_type": "code"} if entities or imports or errors else _PLAIN_CODE
    return [_Draft((a + x, a + y), language, "code", context) for x, y in covered]


def _cells(text: str) -> Iterator[tuple[Span, str]]:
    """Percent cells, or docstrings and what is between them."""
    marks = re.compile(detect.CELL + r"[^\n]*")
    if marks.search(text):
        at = 0
        for cut in chain((m.start() for m in marks.finditer(text) if m.start()), [len(text)]):
            if cut > at:
                yield (at, cut), "prose" if re.match(r"# %%[^\n]*\[(?:markdown|md)\]", text[at:cut]) else "code"
            at = cut
        return
    at = 0
    for m in re.finditer(r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'', text):
        if m.start() > at:
            yield (at, m.start()), "code"
        yield (m.start(), m.end()), "prose"
        at = m.end()
    if at < len(text):
        yield (at, len(text)), "code"


def _segments(text: str, segments: Iterable[tuple[Span, str, dict]], language: str, o: Options, size, path: str) -> list[_Draft]:
    """Segments each by its engine; blank ones and gaps go to the chunk before, or after at the start."""
    out: list[_Draft] = []
    for (a, b), kind, meta in segments:
        if not text[a:b].strip():
            continue
        own = meta.get("language") or (language if kind == "code" and language not in ("ipynb", "latex", "plaintext") else "python" if kind == "code" else "markdown" if language in ("ipynb", "python", "markdown") else "plaintext")
        drafts = _prose(text, (a, b), own, o, size, o.flat_headings, path) if kind == "prose" else _code(text, (a, b), own, o, size, path)
        if meta:
            for d in drafts:
                d.context = d.context | {"metadata": {k: str(v) for k, v in meta.items()}}
        out += drafts
    at = 0
    for d in out:
        d.span = (at, d.span[1])
        at = d.span[1]
    if out and at < len(text):
        out[-1].span = (out[-1].span[0], len(text))
    return out


def load(path: str, content: str | bytes) -> formats.Loaded | None:
    """The segments of a format that has them."""
    suffix = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix in ("pdf", "docx"):
        if isinstance(content, str):
            raise ValueError(f"a .{suffix} file is read from bytes")
        return (formats.pdf if suffix == "pdf" else formats.docx)(content)
    if isinstance(content, bytes):
        content = content.decode("utf-8")
    return formats.notebook(content) if suffix == "ipynb" else formats.latex(content) if suffix == "tex" else None


def contextualize(row: dict, o: Options) -> str:
    """Header lines about the chunk, then its text."""
    path = "/".join((row["filepath"] or "").split("/")[-3:])
    after = [s["name"] for s in row["siblings"] if s["position"] == "before"]
    before = [s["name"] for s in row["siblings"] if s["position"] == "after"]
    shown = [e["signature"] if o.sibling_detail == "signatures" and e["signature"] else e["name"] for e in row["entities"][:5]]
    lines = [
        f"# {path}" if path else None, f"# Language: {row['language']}",
        f"# Section: {' > '.join(row['heading_hierarchy'])}" if row["heading_hierarchy"] else None,
        f"# Scope: {' > '.join(row['breadcrumb'])}" if row["breadcrumb"] and not row["heading_hierarchy"] else None,
        f"# Defines: {', '.join(shown)}" if shown else None,
        f"# Uses: {', '.join(i['name'] for i in row['imports'][:10])}" if row["imports"] else None,
        f"# After: {', '.join(after)}" if after else None, f"# Before: {', '.join(before)}" if before else None,
        f"# ParseErrors: {'; '.join(row['parse_errors'][:3])}" if row["parse_errors"] else None,
    ]
    return "\n".join([x for x in lines if x] + ["", row["text"]])


def chunk(path: str, content: str | bytes | None, options: Options | None = None) -> list[dict]:
    """The chunk rows of one document, without doc_id."""
    return list(chunks(path, content, options))


def chunks(path: str, content: str | bytes | None, options: Options | None = None) -> Iterator[dict]:
    """The rows of ``chunk`` one by one, so that only their spans are held together; what may fail is done before the first."""
    o = options or Options()
    rows = _rows(path or "", content, o)
    # A caller's tokenizer may fail at any row, and groups need all of them.
    return iter(_overlapped(list(rows), o) if o.overlap or o.overlap_lines or o.tokenizer is not None else rows)


def _rows(path: str, content: str | bytes | None, o: Options) -> Iterator[dict]:
    if content is None:
        return
    loaded = load(path, content)
    text = loaded.text if loaded else content.decode("utf-8") if isinstance(content, bytes) else content
    text.encode("utf-8")  # lone surrogates are errors
    if not text.strip():
        return
    language = o.language or detect.language(path, text)
    kind = o.content_type or detect.content_type(path, text, language)
    size = spans.counter(o.size_unit, resolve_tokenizer(o.tokenizer))
    if loaded:
        drafts, kind = _segments(text, loaded.segments, language, o, size, path), "hybrid"
    elif kind == "hybrid":
        drafts = _segments(text, ((s, k, {}) for s, k in _cells(text)), language, o, size, path)
    elif kind == "markup":
        drafts = _markup(text, (0, len(text)), language, o, size)
    elif kind == "prose":
        drafts = _prose(text, (0, len(text)), language, o, size, o.flat_headings, path)
    else:
        drafts = _code(text, (0, len(text)), language, o, size, path)
    index = Index(text)
    count = spans.counter("tokens", resolve_tokenizer(o.tokenizer))
    for k, d in enumerate(drafts):
        a, b = d.span
        piece, c = text[a:b], d.context
        found = c.get("entities", _NO_ENTITIES) if o.context_mode != "none" else _NO_ENTITIES
        around = code.scope(found, a, b) if o.context_mode == "full" else []
        own = code.entity_rows([found.all[i] for i in found.meeting(a, b)], a, b, index) if o.context_mode == "full" else []
        near = code.siblings(found, a, b, o.max_siblings) if o.context_mode == "full" and o.sibling_detail != "none" else []
        if o.sibling_detail == "names":
            near = [n | {"signature": ""} for n in near]
        imports = _imports(c.get("imports", []), own, piece, o)
        row = {
            "filepath": path, "language": d.language, "content_type": kind, "index": k, "total_chunks": len(drafts), "byte_start": index.byte(a), "byte_end": index.byte(b),
            "line_start": index.line(a), "line_end": index.line(max(a, b - 1)), "token_count": count(piece), "char_count": len(piece), "nws_count": spans.nws_bytes(piece), "text": piece,
            "section_type": c.get("section_type", ""), "breadcrumb": d.crumb or c.get("breadcrumb") or [e.name for e in reversed(around)], "heading_hierarchy": c.get("headings", []),
            "parse_errors": [*c.get("errors", []), *(loaded.warnings if loaded else [])], "scope": code.entity_rows(around, a, b, index), "entities": own, "siblings": near, "imports": imports,
            "format_metadata": c.get("metadata", {}) | ({"source_format": loaded.format} if loaded else {}),
        }
        row["contextualized_text"] = piece if o.context_mode == "none" else contextualize(row, o)
        yield row


def _overlapped(rows: list[dict], o: Options) -> list[dict]:
    kind = rows[0]["content_type"] if rows else ""
    if o.overlap_lines and kind in ("code", "prose"):
        for before, row in zip(rows, rows[1:]):
            last = "\n".join([x for x in before["text"].split("\n") if x.strip()][-o.overlap_lines :])
            head = row["contextualized_text"][: len(row["contextualized_text"]) - len(row["text"])]
            row["contextualized_text"] = f"{head}{last}\n{row['text']}"
    return overlapped(rows, o) if o.overlap and kind == "code" else rows


def _imports(found: list[dict], own: list[dict], text: str, o: Options) -> list[dict]:
    if not o.include_imports or o.context_mode == "none":
        return []
    unique = list({(i["name"], i["source"]): i for i in found}.values())
    if o.filter_imports:
        said = text + " ".join(e["signature"] for e in own)
        unique = [i for i in unique if re.search(rf"\b{re.escape(i['name'])}\b", said)] or unique[:6]
    return unique[:5] if o.context_mode == "minimal" else unique


def overlapped(rows: list[dict], o: Options) -> list[dict]:
    """Sliding groups of full chunks."""
    from kerf.operators.analytics import overlap_size

    shared = overlap_size(o.overlap, o.max_chunk_size)
    if shared <= 0 or not rows:
        return rows
    unit = max(1, min(shared, o.max_chunk_size - shared))
    stride, width = max(1, (o.max_chunk_size - shared) // unit), max(1, o.max_chunk_size // unit)
    out = []
    for g in range(0, len(rows), stride):
        group = rows[g : g + width]
        row = dict(group[0])
        for key in ("byte_end", "line_end"):
            row[key] = group[-1][key]
        for key in ("token_count", "char_count", "nws_count"):
            row[key] = sum(r[key] for r in group)
        row["text"] = "".join(r["text"] for r in group)
        for key in ("entities", "imports", "siblings"):
            every = [x for r in group for x in r[key]]
            row[key] = [x for i, x in enumerate(every) if x not in every[:i]]
        row["contextualized_text"] = contextualize(row, o)
        out.append(row)
    for k, row in enumerate(out):
        row.update(index=k, total_chunks=len(out))
    return out
