"""Top-level sections of JSON, YAML, TOML, HTML and XML."""

from __future__ import annotations

import json
import re

from kerf.kernels.spans import Span

Section = tuple[Span, list[str]]
_YAML = re.compile(r"^([\w\-.]+)\s*:", re.M)
_TOML = re.compile(r"^\[\[?([^\]\n]+)\]\]?[ \t]*(?:#.*)?$", re.M)
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][\w:-]*)[^>]*?(/?)>", re.S | re.I)
KEPT = frozenset(["body", "div", "main", "article", "section", *(f"h{n}" for n in range(1, 7))])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


_OBJECT = object()


def json_sections(text: str) -> list[Section]:
    """The members of a top-level object; keys are found by depth, so a nested key of that name is never taken."""
    try:
        # Objects are checked and not kept.
        if json.loads(text, object_pairs_hook=lambda _: _OBJECT) is not _OBJECT:
            return [((0, len(text)), [])]
    except ValueError:
        return [((0, len(text)), [])]
    out, depth, key_at, name, i = [], 0, None, "", 0
    while i < len(text):
        c = text[i]
        if c == '"':
            j = i + 1
            while text[j] != '"':
                j += 2 if text[j] == "\\" else 1
            if depth == 1 and key_at is None:
                key_at, name = i, json.loads(text[i : j + 1])
            i = j
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0 and key_at is not None:
                out.append(((key_at, i), [name]))
                key_at = None
        elif c == "," and depth == 1:
            out.append(((key_at, i + 1), [name]))
            key_at = None
        i += 1
    return out or [((0, len(text)), [])]


def _by_lines(pattern: re.Pattern, text: str, names) -> list[Section]:
    found = list(pattern.finditer(text))
    ends = [*(m.start() for m in found[1:]), len(text)]
    return [((m.start(), e), names(m[1])) for m, e in zip(found, ends)] or [((0, len(text)), [])]


def yaml_sections(text: str) -> list[Section]:
    return _by_lines(_YAML, text, lambda k: [k])


def toml_sections(text: str) -> list[Section]:
    return _by_lines(_TOML, text, lambda k: [x.strip() for x in k.split(".")])


def html_sections(text: str) -> list[Section]:
    """Structural elements with the names of those that they are in, by a stack of open tags."""
    stack: list[tuple[str, int]] = []
    out: list[Section] = []
    for m in _TAG.finditer(text):
        if not m[3]:
            continue
        name = m[3].lower()
        if m[2]:
            if any(n == name for n, _ in stack):
                while True:
                    n, at = stack.pop()
                    if n in KEPT:
                        out.append(((at, m.end()), [x for x, _ in stack if x in KEPT] + [n]))
                    if n == name:
                        break
        elif not m[4] and name not in VOID:
            stack.append((name, m.start()))
    return sorted(out, key=lambda s: (s[0][0], -s[0][1])) or [((0, len(text)), [])]


def sections(text: str, language: str) -> list[Section]:
    split = {"json": json_sections, "yaml": yaml_sections, "toml": toml_sections, "html": html_sections, "xml": html_sections}.get(language)
    return split(text) if split else [((0, len(text)), [])]


def normalise(found: list[Section], n: int) -> list[Section]:
    """Sections that cover the text: inner ones give way to those that end after what is covered, gaps go to the next."""
    out: list[Section] = []
    at = 0
    for (a, b), crumb in sorted(found, key=lambda s: (s[0][0], s[0][1])):
        if b > at:
            out.append(((at, b), crumb))
            at = b
    if at < n:
        out = [*out[:-1], ((out[-1][0][0], n), out[-1][1])] if out else [((0, n), [])]
    return out
