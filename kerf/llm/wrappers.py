"""HTML extraction by wrappers: union-free regular expressions inferred from pages of one host.

A page is a stream of tags and texts in which every tag that is opened is closed.  Siblings that are alike follow one another as
a repeated group, whose inside covers each of them, so pages with more or fewer items have one form.  The different forms of a host
are aligned with its wrapper, element by element: where they differ, what only one has becomes an optional group, and a
stretch that the other repeats becomes a repeated group.  Groups never cut through an element.  Texts are slots of the
wrapper.  What a slot says on most of its host's different pages belongs to the template, as do navigation, forms and
texts that are nothing but links outside of headings; the other texts, in order, are a page's text.

Only the different forms of pages, with their counts, are brought together by host, never the pages: first those of a part of a
host, by their digests, and then what these parts have in common, so no task gets all forms of a large host.  Wrappers are
sent to all executors behind a check of their size in bytes and joined by shuffle beyond it.

Defined cases: a null html gives a null text, an empty one or one without texts an empty text; a null or odd url has the host '';
tags that are never closed end with what they are in, and ends of tags that were never opened are passed over; of a host's single
page all is text but navigation; repeated rows count as one page in that; tags of elements nested more than DEEPEST levels are passed
over, their texts are kept, and elements beyond DEEP levels are aligned as they are; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import difflib
import hashlib
import html as html_entities
import json
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm import vec
from kerf.plans.session import checkpoint

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][\w:-]*)([^>]*)>|<[^>]*>|([^<]+|<)", re.S | re.I)
#: Tags within a text; links are told apart by what they hold.
_INLINE = frozenset("a b i em strong u br span font small sub sup mark code wbr abbr cite q s tt img label".split())
_ASIDE = frozenset("nav footer aside button select option title form".split())
_VOID = frozenset("area base col embed hr input link meta param source track".split())
_HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
_BLOCKS = _HEADINGS | frozenset("address article aside blockquote div dl fieldset footer form header main nav ol p pre section table ul".split())
#: What an opening tag ends if it is open: elements whose end tags may be left out.
_ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}} | {
    k: {"thead", "tbody", "tfoot", "colgroup", "tr", "td", "th", "p"} for k in ("thead", "tbody", "tfoot")
} | {k: {"p"} for k in _BLOCKS}
_CLASS = re.compile(r"""\bclass\s*=\s*["']?([\w-]+)""", re.I)
#: What a slot says on more than this part of its host's different pages belongs to the template.
MOST = 0.5
#: Siblings with the same tag are alike if so much of them is the same.
ALIKE = 0.5
#: Bytes of wrappers and slots that are sent to every executor; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Parts into which the forms of a host are divided, and levels of elements that are aligned one by one.
PARTS, DEEP = 16, 100
#: Levels of elements that a stream has.
DEEPEST = 256
TEXT = "#"

Form = tuple  # of tokens, TEXT, and groups: ("+", form) or ("?", form)


def tokens(html: str) -> tuple[list[str], list[str], list[bool]]:
    """(tags and TEXT, the texts, whether each is nothing but links): every tag but void ones is closed; attributes are dropped but for a class."""
    out: list[str] = []
    texts: list[str] = []
    links: list[bool] = []
    opened: list[str] = []
    deeper: Counter = Counter()
    joined, in_link = False, 0

    def close(n: int) -> None:
        for name in reversed(opened[n:]):
            out.append(f"</{name}>")
        del opened[n:]

    for m in _TOKEN.finditer(html):
        if m[5] is not None:
            text = " ".join(html_entities.unescape(m[5]).split())
            if text:
                linked = in_link > 0 and not any(x in _HEADINGS for x in opened)
                if joined:
                    texts[-1] += " " + text
                    links[-1] &= linked
                else:
                    out.append(TEXT)
                    texts.append(text)
                    links.append(linked)
                joined = True
        elif m[3] is not None:
            name = m[3].lower()
            if name in _INLINE:
                if name == "a":
                    in_link = 0 if m[2] else 1
                continue
            joined, in_link = False, 0
            if m[2]:
                if deeper[name]:
                    deeper[name] -= 1
                elif name in opened:
                    close(len(opened) - 1 - opened[::-1].index(name))
                continue
            ends = _ENDS.get(name, ())
            while opened and opened[-1] in ends:
                close(len(opened) - 1)
            c = _CLASS.search(m[4])
            sign = f"{name}.{c[1]}" if c else name
            if name in _VOID:
                out.append(f"<{sign}/>")
            elif len(opened) < DEEPEST:
                out.append(f"<{sign}>")
                opened.append(name)
            else:
                deeper[name] += 1
    close(0)
    return out, texts, links


def _open(item) -> bool:
    return isinstance(item, str) and item[0] == "<" and item[1] != "/" and item[-2] != "/"


def _units(form) -> list[Form]:
    """A form's elements, texts, void tags and groups, each as the items that it is made of."""
    out, start, depth = [], 0, 0
    for i, item in enumerate(form):
        if _open(item):
            depth += 1
        elif isinstance(item, str) and item[:2] == "</":
            depth -= 1
        if depth == 0:
            out.append(tuple(form[start : i + 1]))
            start = i + 1
    return out


def _laid_open(unit: Form) -> tuple[Form, bool, bool]:
    """(what is in a unit's groups, whether it repeats, whether it may be absent)."""
    plus = optional = False
    while len(unit) == 1 and isinstance(unit[0], tuple):
        plus, optional = plus or unit[0][0] == "+", optional or unit[0][0] == "?"
        unit = unit[0][1]
    return unit, plus, optional


def _label(unit: Form):
    """What units must share to be aligned: the tag, or the tags of a group of several units."""
    inner, plus, _ = _laid_open(unit)
    found = _units(inner) if len(inner) > 1 and not _open(inner[0]) or len(inner) == 1 and isinstance(inner[0], tuple) else [inner]
    if len(found) > 1:
        return tuple(map(_label, found))
    if inner and _open(inner[0]) and len(_units(inner)) > 1:
        return tuple(map(_label, _units(inner)))
    return inner[0] if inner else ""


def _wrapped(form: Form, plus: bool, optional: bool) -> Form:
    if plus:
        form = (("+", form),)
    return (("?", form),) if optional else form


def _gathered(units: list[Form], others: list[Form]) -> list[Form]:
    """``units`` with each stretch that is a repeated group of several units among ``others`` as one."""
    for other in others:
        inner, plus, _ = _laid_open(other)
        labels = _label(other)
        if not plus or not isinstance(labels, tuple) or any(_label(u) == labels for u in units):
            continue
        n, i, own = len(labels), 0, [_label(u) for u in units]
        while i + n <= len(own):
            if tuple(own[i : i + n]) == labels:
                units = [*units[:i], (("+", tuple(x for u in units[i : i + n] for x in u)),), *units[i + n :]]
                own[i : i + n] = [labels]
            i += 1
    return units


def _pairs(left: list[Form], right: list[Form]):
    """Stretches of units that are alike by label and those that aren't."""
    return difflib.SequenceMatcher(None, [_label(u) for u in left], [_label(u) for u in right], autojunk=False).get_opcodes()


def align(wrapper: Form, form: Form, depth: int = 0) -> Form:
    """The least union-free expression, by this alignment, that covers ``wrapper`` and ``form``."""
    if wrapper == form:
        return wrapper
    left, right = _units(wrapper), _units(form)
    left, right = _gathered(left, right), _gathered(right, left)
    out: list = []
    for op, a, b, x, y in _pairs(left, right):
        if op == "equal":
            for u, v in zip(left[a:b], right[x:y]):
                out += _merged(u, v, depth)
        else:
            for u in [*left[a:b], *right[x:y]]:
                inner, plus, _ = _laid_open(u)
                out += _wrapped(inner, plus, True)
    return tuple(out)


def _merged(u: Form, v: Form, depth: int) -> Form:
    """Two units of one label as one."""
    if u == v:
        return u
    (a, plus_a, optional_a), (b, plus_b, optional_b) = _laid_open(u), _laid_open(v)
    if a == b:
        body = a
    elif depth >= DEEP:
        return (("?", a), ("?", b))
    elif len(a) > 1 and len(b) > 1 and len(_units(a)) == len(_units(b)) == 1:
        body = (a[0], *align(a[1:-1], b[1:-1], depth + 1), a[-1])
    else:
        body = align(a, b, depth + 1)
    return _wrapped(body, plus_a or plus_b, optional_a or optional_b)


def _size(form: Form) -> int:
    return sum(_size(x[1]) if isinstance(x, tuple) else 1 for x in form)


def _common(a: Form, b: Form) -> float:
    """How much of two units is the same: twice what their alignment needs of both, of all that they hold."""
    if a == b:
        return 1.0
    shared = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return shared.ratio()


def _slots(form: Form) -> int:
    return sum(x == TEXT if isinstance(x, str) else _slots(x[1]) for x in form)


def _alike(a: Form, b: Form) -> bool:
    x, y = _laid_open(a)[0], _laid_open(b)[0]
    return x == y or (len(x) > 1 and _common(x, y) >= ALIKE)


def _fold_siblings(units: list[tuple]) -> list[tuple]:
    """Units with their texts by slot; neighbours that are alike, one by one or in stretches, are one repeated group."""
    period, ids = 1, None
    while 2 * period <= len(units):
        if ids is None:
            number = {x: i for i, x in enumerate(dict.fromkeys(u[0] for u in units))}
            ids = np.array([number[u[0]] for u in units])
        same = ids[:-period] == ids[period:]
        if same.sum() < period:
            period += 1
            continue
        out, i, n = [], 0, len(units)
        while i < n:
            j = i + period
            if j + period <= n and same[i : i + period].all():
                group = _together(units[i:j])
                while j + period <= n and same[j - period : j].all() and (grown := _joined(group, _together(units[j : j + period]))):
                    group = grown
                    j += period
                if j > i + period:
                    out.append(group)
                    i = j
                    continue
            out.append(units[i])
            i += 1
        if len(out) == len(units):
            period += 1
        else:
            units, ids = out, None
    return units


def _together(units: list[tuple]) -> tuple:
    if len(units) == 1:
        return units[0]
    return tuple(u[0] for u in units), tuple(x for u in units for x in u[1]), [s for u in units for s in u[2]]


def _joined(group: tuple, other: tuple) -> tuple | None:
    """A group that covers both, or None where they aren't alike."""
    label, items, held = group
    if label == TEXT or not _alike(items, other[1]):
        return None
    inner = _laid_open(items)[0]
    body = _laid_open(_merged(items, other[1], 0))[0] if items != other[1] else inner
    # Texts follow their slots into the new body.
    new: list[list[int]] = [[] for _ in range(_slots(body))]
    for old, texts in ((inner, held), (_laid_open(other[1])[0], other[2])):
        to = place(body, old) if old != body else range(len(texts))
        if any(t is None for t in to):
            return None
        for t, x in zip(to, texts):
            new[t] += x
    return label, (("+", body),), new


def fold(stream: list[str]) -> tuple[Form, list[int]]:
    """(form, number of the form's slot of each text)."""
    frames: list[tuple[str, list[tuple]]] = [("", [])]
    k = 0
    for t in stream:
        if t == TEXT:
            frames[-1][1].append((TEXT, (TEXT,), [[k]]))
            k += 1
        elif t[:2] == "</":
            name, units = frames.pop()
            units = _fold_siblings(units)
            frames[-1][1].append((name, (name, *(x for u in units for x in u[1]), t), [s for u in units for s in u[2]]))
        elif t[-2] == "/":
            frames[-1][1].append((t, (t,), []))
        else:
            frames.append((t, []))
    units = _fold_siblings(frames[0][1])
    slot_of = [0] * k
    for s, texts in enumerate(s for u in units for s in u[2]):
        for t in texts:
            slot_of[t] = s
    return tuple(x for u in units for x in u[1]), slot_of


def place(wrapper: Form, form: Form, depth: int = 0) -> list[int | None]:
    """For each slot of ``form`` that of the wrapper that it is an instance of."""
    if wrapper == form:
        return list(range(_slots(form)))
    left, right = _units(wrapper), _units(form)
    right = _gathered(right, left)
    left = _gathered(left, right)
    starts = np.cumsum([0, *map(_slots, left)]).tolist()
    out: list[int | None] = []
    for op, a, b, x, y in _pairs(left, right):
        if op != "equal":
            out += [None] * sum(map(_slots, right[x:y]))
            continue
        for i, v in zip(range(a, b), right[x:y]):
            u, w = _laid_open(left[i])[0], _laid_open(v)[0]
            if u == w:
                inner = range(_slots(w))
            elif depth >= DEEP:
                inner = [None] * _slots(w)
            elif len(u) > 1 and len(w) > 1 and len(_units(u)) == len(_units(w)) == 1:
                inner = place(u[1:-1], w[1:-1], depth + 1)
            else:
                inner = place(u, w, depth + 1)
            out += [None if k is None else starts[i] + k for k in inner]
    return out


def leaves(form: Form, path: tuple = ()) -> list[tuple]:
    """The slots of a form in order, each with the tags that are open around it."""
    out: list[tuple] = []
    opened = list(path)
    for item in form:
        if item == TEXT:
            out.append(tuple(opened))
        elif isinstance(item, tuple):
            out += leaves(item[1], tuple(opened))
        elif item[:2] == "</":
            opened.pop()
        elif _open(item):
            opened.append(re.split(r"[.>]", item[1:])[0])
    return out


def show(form: Form) -> str:
    """A form as a regular expression over tags and texts."""
    return "".join(x if isinstance(x, str) else f"({show(x[1])}){x[0]}" for x in form)


def infer(forms: list[tuple[Form, int]]) -> Form:
    """The wrapper of forms with their counts: most frequent first, ties by their text."""
    ordered = sorted(forms, key=lambda f: (-f[1], show(f[0])))
    wrapper = ordered[0][0]
    for form, _ in ordered[1:]:
        wrapper = align(wrapper, form)
    return wrapper


def _host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


def _packed(form: Form) -> bytes:
    return zlib.compress(json.dumps(form, ensure_ascii=False, separators=(",", ":")).encode(), 1)


def _unpacked(data: bytes) -> Form:
    def tuples(x):
        return tuple(map(tuples, x)) if isinstance(x, list) else x

    return tuples(json.loads(zlib.decompress(data)))


_PARSED = "page_id bigint, host string, digest binary, form binary, slots array<int>, links array<boolean>, texts array<string>"


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, host, digest and form, slot of each text, whether it is a link, texts) of every page; a null html has no digest.

    A task writes a host's form with the first page that has it, and null with the others."""

    def run(batches):
        written: set = set()
        for batch in batches:
            for a, b in vec.slices(batch.column(2)):
                part = batch.slice(a, b - a)
                rows = []
                for url, html in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    stream, texts, links = tokens(html or "")
                    form, slots = fold(stream)
                    packed = _packed(form) if html is not None else None
                    key = (_host(url), packed and hashlib.md5(packed).digest())
                    rows.append((*key, None if key in written else packed, slots, links, texts))
                    written.add(key)
                kinds = (pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.string()))
                yield pa.record_batch([part.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["page_id", "host", "digest", "form", "slots", "links", "texts"])

    return pages.select("page_id", "url", "html").mapInArrow(run, _PARSED)


def learn(parsed: DataFrame, parts: int = PARTS) -> DataFrame:
    """(host, wrapper): each host's wrapper, of the wrappers of parts of its different forms."""

    def together(key, pdf: pd.DataFrame) -> pd.DataFrame:
        wrapper = infer([(_unpacked(f), n) for f, n in zip(pdf["form"], pdf["n"])])
        return pd.DataFrame({"host": [key[0]], "form": [_packed(wrapper)], "n": [int(pdf["n"].sum())]})

    counted = parsed.where("digest is not null").groupBy("host", "digest").agg(F.max("form").alias("form"), F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("digest"), F.lit(parts))
    kind = "host string, form binary, n bigint"
    return counted.groupBy("host", part).applyInPandas(together, kind).groupBy("host").applyInPandas(together, kind).select("host", F.col("form").alias("wrapper"))


def _bytes(df: DataFrame, *columns: str) -> int:
    return df.agg(F.sum(sum((F.octet_length(c) for c in columns), F.lit(64)))).first()[0] or 0


def placed(parsed: DataFrame, learned: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, digest, wrapper, n_slots, to, aside): where a form's slots are in its host's wrapper, and whether each is in navigation."""

    def run(batches):
        for batch in batches:
            rows = []
            for host, digest, form, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
                form, wrapper = _unpacked(form), _unpacked(wrapper)
                to = [-1 if t is None else t for t in place(wrapper, form)]
                rows.append((host, digest, show(wrapper), _slots(wrapper), to, [bool(_ASIDE & set(p)) for p in leaves(form)]))
            kinds = (pa.string(), pa.binary(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["host", "digest", "wrapper", "n_slots", "to", "aside"])

    forms = parsed.where("digest is not null").groupBy("host", "digest").agg(F.max("form").alias("form"))
    small = _bytes(learned, "host", "wrapper") <= broadcast_bytes
    rows = forms.join(F.broadcast(learned) if small else learned, "host").select("host", "digest", "form", "wrapper")
    return rows.mapInArrow(run, "host string, digest binary, wrapper string, n_slots int, to array<int>, aside array<boolean>")


def extract(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(page_id, host, wrapper, n_slots, n_texts, text) of every page. Pages are parsed once, and written to the shared folder as texts and packed forms."""
    parsed = checkpoint(parse(pages))
    learned = checkpoint(learn(parsed))
    forms = checkpoint(placed(parsed, learned, broadcast_bytes)).withColumnsRenamed({"host": "h", "digest": "f"})
    small = forms.agg(F.sum(F.octet_length("wrapper") + 5 * F.size("to") + 64)).first()[0] or 0
    joined = parsed.drop("form").join(F.broadcast(forms) if small <= broadcast_bytes else forms, (F.col("host") == F.col("h")) & (F.col("digest") == F.col("f")), "left")
    slot = "transform(arrays_zip(slots, links), x -> named_struct('to', coalesce(get(to, x.slots), -1), 'aside', x.links or coalesce(get(aside, x.slots), false)))"
    rows = joined.select("page_id", "host", "wrapper", "n_slots", F.col("digest").isNull().alias("missing"), "texts", F.expr(slot).alias("at"))
    # Copies of a page are one page; only hashes of its texts are shuffled.
    hashed = "transform(filter(arrays_zip(at.to, texts), x -> x.to >= 0), x -> named_struct('slot', x.to, 't', xxhash64(x.texts)))"
    different = rows.where("not missing").select("host", F.xxhash64("at.to", "texts").alias("page"), F.expr(hashed).alias("said")).dropDuplicates(["host", "page"])
    n_pages = different.groupBy(F.col("host").alias("h")).agg(F.count("*").alias("n_pages"))
    said = different.select("host", "page", F.explode("said").alias("x")).select("host", "page", "x.slot", "x.t").distinct()
    often = said.groupBy("host", "slot", "t").agg(F.count("*").alias("n")).where("n > 1")
    fixed = often.join(n_pages, F.col("host") == F.col("h")).where(F.col("n") > F.col("n_pages") * F.lit(MOST)).groupBy("h").agg(F.collect_set(F.struct("slot", "t")).alias("fixed"))
    fixed = checkpoint(fixed)
    few = (fixed.agg(F.sum(16 * F.size("fixed") + 64)).first()[0] or 0) <= broadcast_bytes
    rows = rows.join(F.broadcast(fixed) if few else fixed, F.col("host") == F.col("h"), "left")
    none = "cast(array() as array<struct<slot:int,t:bigint>>)"
    keep = f"filter(arrays_zip(at.to, at.aside, texts), x -> not x.aside and not array_contains(coalesce(fixed, {none}), named_struct('slot', x.to, 't', xxhash64(x.texts))))"
    kept = rows.withColumn("kept", F.expr(keep))
    text = F.when(F.col("missing"), F.lit(None)).otherwise(F.expr("array_join(transform(kept, x -> x.texts), '\\n')"))
    return kept.select("page_id", "host", "wrapper", "n_slots", F.size("texts").alias("n_texts"), text.alias("text"))
