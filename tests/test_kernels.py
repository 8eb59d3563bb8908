"""Invariants of chunking over any text, and literals of single kernels."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kerf.functions import detect
from kerf.kernels import code, engine, formats, markup, prose, spans
from kerf.plans.options import Options

PATHS = ["a.md", "a.txt", "a.py", "a.js", "a.rs", "a.html", "a.json", "a.yaml", "a.toml", "a.tex", "", "a.go"]
texts = st.text(st.characters(exclude_categories=["Cs"]), max_size=600) | st.lists(
    st.sampled_from(["# h\n", "\n\n", "para one. Two! ", "```py\ndef f():\n  pass\n```\n", "<div>", "</div>", "key: v\n", "[t]\n", "{", "}", "def f(x):\n    return x\n", "é", "\t", "---\n", "| a |\n", "- x\n", '"""d"""', "# %%\n", "class A:\n", ";", "x" * 90])
).map("".join)


def check(path, text, **options):
    rows = engine.chunk(path, text, Options(**options))
    data = text.encode()
    if not text.strip():
        assert rows == []
        return rows
    assert rows[0]["byte_start"] == 0 and rows[-1]["byte_end"] == len(data)
    for a, b in zip(rows, rows[1:]):
        assert a["byte_end"] == b["byte_start"]
    for k, r in enumerate(rows):
        assert data[r["byte_start"] : r["byte_end"]].decode() == r["text"] and r["text"].strip()
        assert r["index"] == k and r["total_chunks"] == len(rows)
        assert r["line_start"] == text.encode()[: r["byte_start"]].decode().count("\n") and r["line_end"] >= r["line_start"]
    assert rows == engine.chunk(path, text, Options(**options))
    return rows


@pytest.mark.parametrize("path", PATHS)
@settings(max_examples=60, deadline=None)
@given(text=texts, limit=st.integers(5, 200), unit=st.sampled_from(["chars", "tokens", "nws"]))
def test_chunks_cover_any_text(path, text, limit, unit):
    check(path, text, max_chunk_size=limit, min_chunk_size=min(5, limit), size_unit=unit)


def test_surrogates_are_errors():
    with pytest.raises(UnicodeEncodeError):
        engine.chunk("a.txt", "a \ud800")


def test_headings_stack_and_flat_forgets():
    text = "# A\n\none\n\n## B\n\ntwo\n\n# C\n\nthree\n"
    blocks = [(b.headings, text[b.start : b.end].strip()) for b in prose.markdown(text) if b.kind == "paragraph"]
    assert blocks == [(["A"], "one"), (["A", "B"], "two"), (["C"], "three")]
    assert [b.headings for b in prose.markdown(text, flat=True) if b.kind == "paragraph"] == [["A"], ["B"], ["C"]]


def test_fences_go_to_their_engine():
    rows = check("a.md", "# T\n\n```python\ndef f():\n    return 1\n```\n\nend of it\n", max_chunk_size=40, min_chunk_size=1, size_unit="chars")
    inside = next(r for r in rows if "def f" in r["text"])
    assert inside["language"] == "python" and inside["entities"][0]["name"] == "f" and inside["heading_hierarchy"] == ["T"]


def test_large_pieces_are_within_the_limit():
    text = "word " * 50 + "x" * 100
    pieces = prose.split_large(text, (0, len(text)), 30, len)
    assert all(b - a <= 30 for a, b in pieces) and pieces[-1][1] == len(text)


def test_markup_sections():
    assert [c for _, c in markup.json_sections('{"a": {"b": 1}, "b": [2], "c\\"": 3}')] == [["a"], ["b"], ['c"']]
    assert [c for _, c in markup.yaml_sections("a: 1\nb:\n  c: 2\n")] == [["a"], ["b"]]
    assert [c for _, c in markup.toml_sections("[a.b]\nx=1\n[c]\n")] == [["a", "b"], ["c"]]
    assert [c for _, c in markup.html_sections("<div><p>x</p></div><section>y</section>")] == [["div"], ["section"]]


def test_python_entities_and_bad_python():
    source = 'import os\nfrom a.b import c as d\n\n@deco\nclass K:\n    """Doc."""\n    def m(self, x: int) -> str:\n        return x\n\ndef é(): pass\n'
    entities, imports, tops, errors = code.parse(source, "python")
    assert [(e.name, e.type, e.parent) for e in entities] == [("K", "class", None), ("m", "method", "K"), ("é", "function", None)]
    assert entities[0].docstring == "Doc." and source[entities[0].start :].startswith("@deco") and entities[1].signature == "def m(self, x: int) -> str"
    assert [(i["name"], i["source"]) for i in imports] == [("os", "os"), ("d", "a.b")] and not errors and len(tops) == 4
    entities, _, _, errors = code.parse("def f(:\n  x\nclass B:\n  pass\n", "python")
    assert errors and [e.name for e in entities] == ["f", "B"]


@pytest.mark.parametrize(
    ("language", "source", "names"),
    [
        ("typescript", "import {a, b as c} from 'x';\nexport class K { m() { return '}'; } }\nconst f = (x) => { return x; };\ninterface I { a: string }\n", ["K", "f", "I"]),
        ("rust", "use std::{io::{self, Read}, fmt};\npub struct S { a: u8 }\nimpl S { fn g(&self) -> u8 { 1 } }\n", ["S", "S", "g"]),
        ("go", 'package p\nimport "fmt"\nfunc F(x int) int {\n\treturn x\n}\ntype T struct {\n}\n', ["F", "T"]),
        ("java", "import java.util.List;\npublic class A {\n  public int f(int x) { return x; }\n}\n", ["A", "f"]),
        ("c", '#include <a.h>\nstruct s { int x; };\nint main(void) { return 0; }\n', ["s", "main"]),
        ("ruby", "class A\n  def f\n    1\n  end\nend\n", ["A", "f"]),
    ],
)
def test_other_languages(language, source, names):
    entities, imports, _, _ = code.parse(source, language)
    assert [e.name for e in entities] == names
    assert language == "ruby" or imports
    check(f"x.{ {'typescript': 'ts', 'rust': 'rs', 'go': 'go', 'java': 'java', 'c': 'c', 'ruby': 'rb'}[language]}", source, max_chunk_size=30, min_chunk_size=5, size_unit="chars")


def test_code_context():
    source = "import os\n\n" + "\n\n".join(f"def f{i}(a):\n    return os.sep * {i}" for i in range(6)) + "\n"
    rows = check("m.py", source, max_chunk_size=40, min_chunk_size=5, size_unit="chars")
    middle = next(r for r in rows if "def f3" in r["text"])
    assert {s["position"] for s in middle["siblings"]} == {"before", "after"} and middle["imports"][0]["name"] == "os"
    assert "# Defines: def f" in middle["contextualized_text"]
    assert engine.chunk("m.py", source, Options(context_mode="none"))[0]["contextualized_text"] == engine.chunk("m.py", source, Options(context_mode="none"))[0]["text"]
    grouped = engine.chunk("m.py", source, Options(max_chunk_size=40, min_chunk_size=5, size_unit="chars", overlap=0.35))
    assert max(r["byte_end"] for r in grouped) == len(source.encode())


def test_options_reject_what_they_do_not_know():
    with pytest.raises(TypeError):
        Options.of(max_size=3)
    with pytest.raises(ValueError):
        Options(size_unit="lines")


def test_detection():
    assert [detect.language(p, c) for p, c in (("a.d.ts", ""), ("x.py.bak", ""), ("x", "# T\n"), ("x", "<html>"), ("x", '{"a":1}'), ("x", "def f():"), ("x", ""))] == ["typescript", "python", "markdown", "html", "json", "python", "plaintext"]
    assert detect.content_type("a.py", '"""long docstring here"""\nx=1\n') == "hybrid"
    assert detect.content_type("a.txt", "# %% cell\nx") == "hybrid" and detect.content_type("n.ipynb", "{}") == "hybrid"


def test_notebooks_and_latex():
    nb = json.dumps({"metadata": {"kernelspec": {"language": "python"}}, "cells": [{"cell_type": "markdown", "source": ["# T\n", "text"]}, {"cell_type": "code", "source": "x = 1", "outputs": [{"text": ["1\n"]}]}, {"cell_type": "odd"}]})
    loaded = formats.notebook(nb)
    assert loaded.text == "# T\ntext\n\nx = 1\n\n1\n" and [k for _, k, _ in loaded.segments] == ["prose", "code", "prose"] and loaded.warnings
    rows = engine.chunk("n.ipynb", nb)
    assert "".join(r["text"] for r in rows) == loaded.text and rows[0]["format_metadata"]["source_format"] == "ipynb"
    assert formats.notebook("{bad").warnings
    tex = "\\section{A}\nText.\n\\begin{lstlisting}\nx=1\n\\end{lstlisting}\n\\section{B}\nMore \\begin{verbatim}.\n"
    loaded = formats.latex(tex)
    assert "".join(tex[a:b] for (a, b), _, _ in loaded.segments) == tex and loaded.warnings == ["unbalanced verbatim"]
    check("a.tex", tex, max_chunk_size=10)
    with pytest.raises(ValueError):
        engine.chunk("a.pdf", "text")


def test_span_rules():
    assert spans.cover([(2, 4), (0, 3), (5, 6)], 8) == [(0, 3), (3, 4), (4, 8)]
    assert spans.greedy([(0, 1), (1, 2), (2, 9), (9, 10)], [1, 1, 7, 1], 3) == [(0, 2), (2, 9), (9, 10)]
    assert spans.join_blank("  a \n b", [(0, 2), (2, 4), (4, 6), (6, 7)]) == [(0, 6), (6, 7)]
    assert spans.nws_bytes("é a\t\u2003") == 6
