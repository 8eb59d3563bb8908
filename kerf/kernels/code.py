"""Source code: entities, imports and spans of code that end where statements do.

Python is parsed by the standard library; other languages by patterns for declarations and brackets; a registered
parser goes before both.
"""

from __future__ import annotations

import ast
import bisect
import re
from array import array
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from kerf.kernels.spans import Index, Span, nws_bytes


@dataclass(slots=True)
class Entity:
    name: str
    type: str
    signature: str
    start: int
    end: int
    docstring: str | None = None
    parent: str | None = None


class _Maxima:
    """Places of large values, found in order and without a look at the others."""

    def __init__(self, values: list[int]):
        self.size = 1 << max(0, len(values) - 1).bit_length()
        self.tree = array("q", [-(1 << 62)]) * (2 * self.size)
        self.tree[self.size : self.size + len(values)] = array("q", values)
        for k in range(self.size - 1, 0, -1):
            self.tree[k] = max(self.tree[2 * k], self.tree[2 * k + 1])

    def at_least(self, value: int, before: int | None = None, backward: bool = False) -> Iterator[int]:
        before = self.size if before is None else before
        stack = [(1, 0, self.size)]
        while stack:
            node, first, width = stack.pop()
            if first >= before or self.tree[node] < value:
                continue
            if width == 1:
                yield first
                continue
            width //= 2
            halves = [(2 * node, first, width), (2 * node + 1, first + width, width)]
            stack += halves if backward else halves[::-1]


class Found:
    """A module's entities in their order, and where those that meet, hold or are next to a span are among them."""

    def __init__(self, entities: list[Entity]):
        self.all = entities
        self.order = sorted(range(len(entities)), key=lambda k: entities[k].start)
        self.starts = [entities[k].start for k in self.order]
        self.ends = _Maxima([entities[k].end for k in self.order])
        self.groups: dict[str | None, tuple[list[int], _Maxima, _Maxima]] = {}

    def _reaching(self, before: int, end: int) -> list[int]:
        return sorted(self.order[k] for k in self.ends.at_least(end, before))

    def meeting(self, a: int, b: int) -> list[int]:
        return self._reaching(bisect.bisect_left(self.starts, b), a + 1)

    def holding(self, a: int, b: int) -> list[int]:
        return self._reaching(bisect.bisect_right(self.starts, a), b)

    def nearest(self, a: int) -> int | None:
        """The first of those that begin nearest to ``a``."""
        if not self.all:
            return None
        k = bisect.bisect_right(self.starts, a)
        # Sorting kept the order of equal starts, so the first of a start is the first in the list.
        ends = ([bisect.bisect_left(self.starts, self.starts[k - 1])] if k else []) + ([k] if k < len(self.starts) else [])
        return min((self.order[x] for x in ends), key=lambda x: (abs(self.all[x].start - a), x))

    def beside(self, parent: str | None, a: int, b: int, most: int) -> tuple[list[int], list[int]]:
        """Up to so many of a parent's entities that end before a span, the last ones, and that begin after it, the first ones."""
        if not self.groups:
            members: dict[str | None, list[int]] = {}
            for k, e in enumerate(self.all):
                members.setdefault(e.parent, []).append(k)
            self.groups = {p: (m, _Maxima([-self.all[k].end for k in m]), _Maxima([self.all[k].start for k in m])) for p, m in members.items()}
        group, ends, starts = self.groups[parent]
        before = [group[k] for k, _ in zip(ends.at_least(-a, backward=True), range(most))][::-1]
        return before, [group[k] for k, _ in zip(starts.at_least(b), range(most))]


_C_LIKE = {
    "javascript": r"(?P<class>\bclass\s+(\w+))|(?P<function>\b(?:async\s+)?function\s*\*?\s*(\w+)\s*\()|(?P<arrow>\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>)",
    "rust": r"(?P<struct>\b(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+))|(?P<enum>\benum\s+(\w+))|(?P<trait>\btrait\s+(\w+))|(?P<impl>\bimpl(?:<[^>]*>)?\s+([\w:<>, ]+?)\s*\{)|(?P<function>\b(?:async\s+)?fn\s+(\w+))",
    "go": r"(?P<function>^func\s+(?:\([^)]*\)\s*)?(\w+))|(?P<type>^type\s+(\w+))",
    "java": r"(?P<class>\bclass\s+(\w+))|(?P<interface>\binterface\s+(\w+))|(?P<enum>\benum\s+(\w+))|(?P<method>^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ]+?\s(\w+)\s*\()",
    "c": r"(?P<struct>\bstruct\s+(\w+)\s*\{)|(?P<enum>\benum\s+(\w+)\s*\{)|(?P<function>^[A-Za-z_][\w \t*]*?[ \t*](\w+)\s*\([^;{]*\)\s*\{)",
    "ruby": r"(?P<module>^\s*module\s+(\w+))|(?P<class>^\s*class\s+(\w+))|(?P<method>^\s*def\s+([\w.?!]+))",
    "kotlin": r"(?P<class>\b(?:data\s+|sealed\s+)?class\s+(\w+))|(?P<interface>\binterface\s+(\w+))|(?P<object>\bobject\s+(\w+))|(?P<function>\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\()",
    "swift": r"(?P<class>\bclass\s+(\w+))|(?P<struct>\bstruct\s+(\w+))|(?P<protocol>\bprotocol\s+(\w+))|(?P<function>\bfunc\s+(\w+))",
}
_C_LIKE["typescript"] = _C_LIKE["javascript"] + r"|(?P<interface>\binterface\s+(\w+))|(?P<type>^(?:export\s+)?type\s+(\w+)\s*=)|(?P<enum>\benum\s+(\w+))"
_C_LIKE["cpp"] = _C_LIKE["c"] + r"|(?P<class>\bclass\s+(\w+))|(?P<namespace>\bnamespace\s+(\w+))"
_C_LIKE["csharp"] = _C_LIKE["java"] + r"|(?P<struct>\bstruct\s+(\w+))|(?P<namespace>\bnamespace\s+([\w.]+))"
_C_LIKE["scala"] = _C_LIKE["kotlin"].replace(r"\bfun\s+", r"\bdef\s+") + r"|(?P<trait>\btrait\s+(\w+))"
_C_LIKE["php"] = r"(?P<class>\bclass\s+(\w+))|(?P<interface>\binterface\s+(\w+))|(?P<trait>\btrait\s+(\w+))|(?P<function>\bfunction\s+(\w+)\s*\()"
_IMPORTS = {
    "javascript": r"^\s*import\s+(?:(?P<names>[^'\"\n;]+?)\s+from\s+)?['\"](?P<source>[^'\"]+)['\"]|\b(?:const|let|var)\s+(?P<names2>[\w{},\s]+?)\s*=\s*require\(\s*['\"](?P<source2>[^'\"]+)['\"]",
    "rust": r"^\s*(?:pub\s+)?use\s+(?P<source>[^;]+);",
    "go": r"^\s*(?:import\s+)?(?P<names>[\w.]+\s+)?\"(?P<source>[^\"\n]+)\"\s*$",
    "java": r"^\s*import\s+(?:static\s+)?(?P<source>[\w.*]+)\s*;",
    "c": r"^\s*#\s*include\s+[<\"](?P<source>[^>\"]+)[>\"]",
    "csharp": r"^\s*using\s+(?:static\s+)?(?P<source>[\w.]+)\s*;",
    "ruby": r"^\s*require(?:_relative)?\s+['\"](?P<source>[^'\"]+)['\"]",
    "kotlin": r"^\s*import\s+(?P<source>[\w.*]+)",
    "php": r"^\s*use\s+(?P<source>[\w\\]+)",
    "swift": r"^\s*import\s+(?P<source>[\w.]+)",
}
_IMPORTS |= {"typescript": _IMPORTS["javascript"], "cpp": _IMPORTS["c"], "scala": _IMPORTS["kotlin"]}


def _positions(text: str) -> list[int]:
    out, at = [0], 0
    for line in text.splitlines(keepends=True) if "\r" not in text and "\f" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        at += len(line)
        out.append(at)
    return out


def _signature(text: str, stop: str, cap: int) -> str:
    depth = 0
    for i, c in enumerate(text):
        depth += (c in "([") - (c in ")]")
        if depth == 0 and text.startswith(stop, i):
            text = text[:i]
            break
    return " ".join(text.split())[:cap]


_TOP = re.compile(r"^(?:@|(?:async[ \t]+)?def[ \t]|class[ \t])", re.M)
#: Characters of a module that are parsed at a time, so that its tree is never whole in memory.
PIECE = 1 << 19


def _pieces(text: str) -> list[Span]:
    """Parts of a module that end where a definition begins at the margin, each with complete statements; all of it where that can't be seen."""
    if len(text) <= PIECE or "\r" in text or "\f" in text:
        return [(0, len(text))]
    cuts = [0]
    while m := _TOP.search(text, cuts[-1] + PIECE):
        # A decorator stays with what it decorates: a cut before the first of them.
        cuts.append(m.start())
    return list(zip(cuts, [*cuts[1:], len(text)]))


def _python(text: str) -> tuple[list[Entity], list[dict], list[Span]]:
    entities: list[Entity] = []
    imports: list[dict] = []
    spans: list[Span] = []
    pieces = _pieces(text)
    try:
        for a, b in pieces:
            _python_piece(text[a:b], a, entities, imports, spans)
    except (SyntaxError, ValueError, RecursionError):
        # A cut may lie within a text or between a decorator and its function.
        if len(pieces) == 1:
            raise
        entities, imports, spans = [], [], []
        _python_piece(text, 0, entities, imports, spans)
    return entities, imports, spans


def _python_piece(text: str, offset: int, entities: list[Entity], imports: list[dict], spans: list[Span]) -> None:
    """Adds what a piece of a module has, which begins at ``offset``."""
    tree = ast.parse(text)
    lines = text.split("\n")
    starts = [offset]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def at(line: int, col: int) -> int:
        row = lines[line - 1]
        return starts[line - 1] + (col if row.isascii() else len(row.encode()[:col].decode(errors="ignore")))

    def visit(node, parent):
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                first = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if parent and parent.type == "class" else "function"
                begin, end = at(child.lineno, child.col_offset), at(child.end_lineno, child.end_col_offset)
                e = Entity(child.name, kind, _signature(text[begin - offset : end - offset], ":", 200), starts[first - 1], end, ast.get_docstring(child), parent.name if parent else None)
                entities.append(e)
                visit(child, e)
            else:
                if isinstance(child, ast.Import):
                    imports.extend({"name": a.asname or a.name, "source": a.name, "is_default": False, "is_namespace": True} for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    source = "." * child.level + (child.module or "")
                    imports.extend({"name": a.asname or a.name, "source": source, "is_default": False, "is_namespace": a.name == "*"} for a in child.names)
                visit(child, parent)

    visit(tree, None)
    for child in tree.body:
        first = min([child.lineno, *(d.lineno for d in getattr(child, "decorator_list", []))])
        spans.append((starts[first - 1], at(child.end_lineno, child.end_col_offset)))


def _closing(text: str, start: int) -> int:
    """The end of the block that opens after ``start``, or of the line where none does; strings and comments are passed over."""
    depth, i, n = 0, start, len(text)
    while i < n:
        c = text[i]
        if c in "\"'`":
            j = i + 1
            while j < n and text[j] != c and (c == "`" or text[j] != "\n"):
                j += 2 if text[j] == "\\" else 1
            i = j
        elif text.startswith("//", i) or (c == "#" and text[i - 1 : i] in ("", "\n")):
            i = text.find("\n", i)
            if i < 0:
                return n
        elif text.startswith("/*", i):
            i = text.find("*/", i)
            if i < 0:
                return n
            i += 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return i + 1
        elif c == ";" and depth == 0:
            return i + 1
        i += 1
    return n


def _indented(text: str, start: int) -> int:
    """The end of a Ruby-like block: the line ``end`` with the indent of its first line."""
    line = text[text.rfind("\n", 0, start) + 1 :]
    indent = len(line) - len(line.lstrip())
    m = re.compile(rf"^[ \t]{{{indent}}}end\b", re.M).search(text, start)
    return m.end() if m else len(text)


def _patterns(text: str, language: str) -> tuple[list[Entity], list[dict], list[Span]]:
    entities: list[Entity] = []
    pattern = _C_LIKE.get(language)
    for m in re.finditer(pattern, text, re.M) if pattern else ():
        kind = m.lastgroup or next(k for k, v in m.groupdict().items() if v)
        kind = next(k for k, v in m.groupdict().items() if v)
        name = next(g for g in reversed(m.groups()) if g)
        head = text.rfind("\n", 0, m.start()) + 1
        begin = head if not text[head : m.start()].strip() or re.fullmatch(r"[\w\s@()\[\]<>\",.=]*", text[head : m.start()]) else m.start()
        end = _indented(text, m.start()) if language == "ruby" else _closing(text, m.end() - (m.group().endswith("{")))
        before = re.search(r"((?:^[ \t]*(?:///?|\*|/\*\*?|#).*\n)+)\Z", text[:begin], re.M)
        doc = re.sub(r"^[ \t]*(?:/\*\*?|\*/|\*|///?|#)[ \t]?", "", before[1], flags=re.M).strip() if before else None
        entities.append(Entity(name.strip(), "function" if kind == "arrow" else kind, _signature(text[begin:end], "{", 220), begin, end, doc))
    found = Found(entities)
    for e in entities:
        around = [x for x in scope(found, e.start, e.end) if (x.start, x.end) != (e.start, e.end)]
        if around:
            e.parent = around[0].name
    imports = []
    for m in re.finditer(_IMPORTS[language], text, re.M) if language in _IMPORTS else ():
        groups = m.groupdict()
        source = (groups.get("source") or groups.get("source2") or "").strip()
        names = (groups.get("names") or groups.get("names2") or "").strip()
        if language == "rust":
            imports += [{"name": re.split(r"::|\s+as\s+", p)[-1], "source": p, "is_default": False, "is_namespace": p.endswith("*")} for p in expand_use(source)]
        elif names and language in ("javascript", "typescript"):
            head, _, inner = names.partition("{")
            inner, _, tail = inner.partition("}")
            rest = head + tail
            for x in rest.split(","):
                if x.strip():
                    star = re.match(r"\s*\*\s+as\s+(\w+)", x)
                    imports.append({"name": star[1] if star else x.replace("type ", "").strip(), "source": source, "is_default": not star, "is_namespace": bool(star)})
            for x in inner.split(","):
                if x.strip():
                    imports.append({"name": re.split(r"\s+as\s+", x.strip())[-1], "source": source, "is_default": False, "is_namespace": False})
        else:
            imports.append({"name": names or re.split(r"[./\\]", source)[-1], "source": source, "is_default": False, "is_namespace": source.endswith("*")})
    tops = [e for e in entities if e.parent is None]
    return entities, imports, [(e.start, e.end) for e in tops]


def expand_use(path: str) -> list[str]:
    """The single paths of a path with nested braces."""
    m = re.match(r"([^{]*)\{(.*)\}\s*$", path, re.S)
    if not m:
        return [path.strip()]
    parts, depth, at = [], 0, 0
    for i, c in enumerate(m[2] + ","):
        depth += (c == "{") - (c == "}")
        if c == "," and depth == 0:
            if m[2][at:i].strip():
                parts.append(m[2][at:i].strip())
            at = i + 1
    return [x for p in parts for x in expand_use(m[1].strip() + p)]


def parse(text: str, language: str, parser=None, path: str = "") -> tuple[list[Entity], list[dict], list[Span], list[str]]:
    """(entities, imports, spans of top-level statements, errors)."""
    errors: list[str] = []
    if parser is not None:
        try:
            found = parser(path, text)
            if found is not None:
                return (*found, errors)
        except Exception as e:  # a plugin's error is reported with the chunk and parsing goes on without it
            errors.append(f"{type(e).__name__}: {e}")
    if language == "python":
        try:
            return (*_python(text), errors)
        except (SyntaxError, ValueError, RecursionError) as e:
            errors.append(f"{type(e).__name__}: {e}")
            return (*_python_lines(text), errors)
    return (*_patterns(text, language), errors)


_INDENT = re.compile(r"^([ \t]*)\S", re.M)


def _python_lines(text: str) -> tuple[list[Entity], list[dict], list[Span]]:
    """Definitions by their indent, for text that isn't valid Python."""
    out = []
    for m in re.finditer(r"^([ \t]*)(?:async[ \t]+)?(def|class)[ \t]+(\w+)[^\n]*", text, re.M):
        indent, end = len(m[1]), len(text)
        for line in _INDENT.finditer(text, m.end()):
            if len(line[1]) <= indent and line.start() > m.end():
                end = line.start()
                break
        out.append(Entity(m[3], "class" if m[2] == "class" else "function", _signature(m[0].strip(), ":", 200), m.start(), end))
    found = Found(out)
    for e in out:
        around = [k for k in found.holding(e.start, e.end) if out[k].start < e.start]
        e.parent = out[around[-1]].name if around else None
    imports = [{"name": m[2] or m[1], "source": m[1], "is_default": False, "is_namespace": not m[2]} for m in re.finditer(r"^(?:from[ \t]+([\w.]+)[ \t]+)?import[ \t]+([\w.]+)", text, re.M) if m[1] or m[2]]
    return out, imports, [(e.start, e.end) for e in out if e.parent is None]


def split_lines(text: str, span: Span, limit: int) -> list[Span]:
    """Pieces of a span within a limit of non-white-space bytes: at lines that begin a statement where possible, else at
    lines, else within a line at characters."""
    a, b = span
    ends = [m.end() for m in re.finditer(r"\n", text[a:b])]
    cuts = [a + e for e in ends] + ([b] if not ends or a + ends[-1] < b else [])
    out, at, used, last_statement = [], a, 0, None
    previous = a
    for cut in cuts:
        n = nws_bytes(text[previous:cut])
        if used and used + n > limit:
            end = last_statement if last_statement and last_statement > at else previous
            out.append((at, end))
            at, used, last_statement = end, nws_bytes(text[end:previous]), None
        if n > limit:
            if at < previous:
                out.append((at, previous))
                at = previous
            while nws_bytes(text[at:cut]) > limit:
                lo, hi = at + 1, cut
                while lo < hi:
                    mid = (lo + hi + 1) // 2
                    if nws_bytes(text[at:mid]) <= limit:
                        lo = mid
                    else:
                        hi = mid - 1
                soft = max(text.rfind(c, at + 1, lo) for c in " ,;)")
                out.append((at, soft + 1 if soft > at else lo))
                at = out[-1][1]
            used, last_statement = nws_bytes(text[at:cut]), None
        else:
            used += n
        if cut < b and not text[cut].isspace() and text[cut] not in ")]}":
            last_statement = cut
        previous = cut
    if at < b:
        out.append((at, b))
    return out


def windows(text: str, spans: list[Span], entities: list[Entity], limit: int, smallest: int) -> list[Span]:
    """Spans of code: top-level statements packed greedily, a large one by what is in it, what can't be parted by lines."""
    pieces: list[Span] = []
    known = sorted((e.start, e.end) for e in entities)
    for a, b in spans:
        if nws_bytes(text[a:b]) <= limit:
            pieces.append((a, b))
            continue
        inner = [x for x, y in known[bisect.bisect_right(known, (a, 1 << 62)) : bisect.bisect_right(known, (b, 1 << 62))] if y <= b]
        cuts = [a, *inner, b]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                pieces += [(x, y)] if nws_bytes(text[x:y]) <= limit else split_lines(text, (x, y), limit)
    out: list[Span] = []
    used = 0
    for a, b in pieces:
        n = nws_bytes(text[a:b])
        if out and used + n <= limit:
            out[-1] = (out[-1][0], b)
            used += n
        else:
            out.append((a, b))
            used = n
    k = 0
    while k < len(out) and len(out) > 1:
        if nws_bytes(text[out[k][0] : out[k][1]]) < smallest:
            j = k if k + 1 < len(out) else k - 1
            out[j : j + 2] = [(out[j][0], out[j + 1][1])]
            k = j
            if nws_bytes(text[out[k][0] : out[k][1]]) < smallest and len(out) > 1 and k + 1 < len(out):
                continue
        k += 1
    return out


def siblings(found: Found, a: int, b: int, most: int) -> list[dict]:
    """Up to so many entities before and after a span, of the parent of the first in it."""
    inside = found.meeting(a, b)
    anchor = inside[0] if inside else found.nearest(a)
    if anchor is None:
        return []
    before, after = found.beside(found.all[anchor].parent, a, b, most)
    rows = [("before", len(before) - i, found.all[k]) for i, k in enumerate(before)] + [("after", i + 1, found.all[k]) for i, k in enumerate(after)]
    return [{"name": e.name, "type": e.type, "position": p, "distance": d, "signature": e.signature} for p, d, e in rows]


def entity_rows(entities: list[Entity], a: int, b: int, index: Index) -> list[dict]:
    """Entities, which meet a span, in bytes and lines of the document."""
    out = []
    for e in entities:
        row = asdict(e)
        start, end = row.pop("start"), row.pop("end")
        out.append(row | {"byte_start": index.byte(start), "byte_end": index.byte(end), "line_start": index.line(start), "line_end": index.line(max(start, end - 1)), "is_partial": start < a or end > b})
    return out


def scope(found: Found, a: int, b: int) -> list[Entity]:
    """Entities that contain a span, the innermost first."""
    return sorted((found.all[k] for k in found.holding(a, b)), key=lambda e: e.end - e.start)
