"""Languages and content types from paths and contents."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BY_LANGUAGE = {
    "plaintext": "txt", "rst": "rst", "markdown": "markdown md mdx", "latex": "tex", "ipynb": "ipynb", "html": "htm html", "xml": "svg xml", "json": "jsonl json", "toml": "toml", "yaml": "yml yaml",
    "python": "pyw pyi py", "typescript": "cts mts tsx ts", "javascript": "cjs mjs jsx js", "rust": "rs", "java": "java", "go": "go", "cpp": "hxx hpp cxx cc cpp", "c": "h c", "csharp": "cs",
    "kotlin": "kts kt", "scala": "scala", "swift": "swift", "php": "php", "ruby": "rb", "bash": "bash sh", "sql": "sql",
}
EXTENSIONS = {suffix: name for name, suffixes in _BY_LANGUAGE.items() for suffix in suffixes.split()}
PROSE = frozenset(("markdown", "plaintext", "rst", "latex"))
MARKUP = frozenset(("html", "xml", "json", "yaml", "toml"))
_LADDER = [
    (r"(?m)^#{1,6}\s+\S", "markdown"),
    (r"(?is)^\s*<!doctype html|^\s*<html\b|<(?:div|body|head|section|article)\b[^>]*>", "html"),
    (r"(?s)^\s*[\{\[]", "json"),
    (r"(?m)^\s*(?:async +)?def +\w+ *\(", "python"),
    (r"(?m)^\s*(?:export|interface|type|const|let|function)\s+\w+", "typescript"),
    (r"(?s)^(?=.*\bpackage\s+\w+)(?=.*\bfunc\s+\w+)", "go"),
    (r"(?s)^(?=.*\bfn\s+\w+)(?=.*\b(?:impl|let|pub)\b)", "rust"),
]
CELL = r"(?m)^# %%"


def language(path: str | None, content: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1].lower()
    if name.endswith(".d.ts"):
        return "typescript"
    for suffix in reversed(name.split(".")[1:]):
        if suffix in EXTENSIONS:
            return EXTENSIONS[suffix]
    for pattern, found in _LADDER:
        if re.search(pattern, content or ""):
            return found
    return "plaintext"


def _docstrings(content: str) -> float:
    spans = [m.end() - m.start() for m in re.finditer(r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'', content)]
    return sum(spans) / max(len(content), 1)


def content_type(path: str | None, content: str | None, lang: str | None = None) -> str:
    """code, prose, markup or hybrid; cells marked with ``# %%`` make anything hybrid."""
    content = content or ""
    lang = lang or language(path, content)
    if lang == "ipynb" or (path or "").lower().endswith(".mdx") or re.search(CELL, content):
        return "hybrid"
    if lang in MARKUP:
        return "markup"
    if lang in PROSE:
        return "prose"
    return "hybrid" if lang == "python" and _docstrings(content) > 0.4 else "code"


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def language_column(path: Column | str, content: Column | str) -> Column:
    """``language`` as an expression."""
    name = F.lower(F.element_at(F.split(_col(path), "/"), -1))
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    suffixes = F.reverse(F.slice(F.split(name, r"\."), 2, 64))
    known = F.filter(F.transform(suffixes, lambda s: table[s]), lambda x: x.isNotNull())
    by_name = F.when(F.endswith(name, F.lit(".d.ts")), F.lit("typescript")).otherwise(F.get(known, F.lit(0)))
    text = F.coalesce(_col(content), F.lit(""))
    ladder = F.lit("plaintext")
    for pattern, found in reversed(_LADDER):
        ladder = F.when(text.rlike(pattern), F.lit(found)).otherwise(ladder)
    return F.coalesce(by_name, ladder)


def content_type_column(path: Column | str, content: Column | str, lang: Column | str) -> Column:
    """``content_type`` as an expression."""
    text, lang = F.coalesce(_col(content), F.lit("")), _col(lang)
    rest = F.regexp_replace(text, r'"""(?:.|\n)*?"""|\'\'\'(?:.|\n)*?\'\'\'', "")
    docs = (F.length(text) - F.length(rest)) / F.greatest(F.length(text), F.lit(1))
    return (
        F.when((lang == "ipynb") | F.coalesce(F.lower(_col(path)).like("%.mdx"), F.lit(False)) | text.rlike(CELL), "hybrid")
        .when(lang.isin(*sorted(MARKUP)), "markup")
        .when(lang.isin(*sorted(PROSE)), "prose")
        .when((lang == "python") & (docs > 0.4), "hybrid")
        .otherwise("code")
    )
