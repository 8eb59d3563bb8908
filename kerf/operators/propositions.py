"""Propositions: claims that sentences make, by patterns or by a caller's model."""

from __future__ import annotations

import json
import re
import warnings

import pyarrow as pa
from pyspark.sql import DataFrame

from kerf.operators.sentences import BREAK

#: A subject that is something, a term with what follows its colon, a number with a bound, and a year with a preposition.
PATTERNS = (
    ("copula_is", 0.72, re.compile(r"\b[A-Z][a-z]+(?:\s+[a-z]+){0,6}\s+is\s+[^.!?]+(?:\.|$)", re.M)),
    ("defined_as", 0.65, re.compile(r"\b[A-Z][^\n:]{1,64}\s*:\s*[^\n]+", re.M)),
    ("numeric_claim", 0.58, re.compile(r"\b(?:at least|about|approximately|over|under|less than|more than)\s+[\d,]+(?:\.\d+)?%?\b[^.!?]*[.!?]", re.I)),
    ("year_claim", 0.55, re.compile(r"\b(?:after|before|in|since|until)\s+(?:the\s+)?(?:year\s+)?\d{4}\b[^.!?]*[.!?]")),
)
_BREAK = re.compile(BREAK)


def spans(text: str):
    at = 0
    for m in _BREAK.finditer(text):
        yield at, m.end()
        at = m.end()
    yield at, len(text)


def heuristic(text: str | None) -> list[tuple]:
    """(start, end, text, kind, confidence) in characters of each match in a sentence; a span is listed once, by the first pattern that it has."""
    out: list[tuple] = []
    seen: set[tuple[int, int]] = set()
    text = text or ""
    for a, b in spans(text):
        for kind, base, pattern in PATTERNS:
            for m in pattern.finditer(text[a:b]):
                span = a + m.start(), a + m.end()
                said = m.group().strip()
                if span not in seen and said:
                    seen.add(span)
                    out.append((*span, said, kind, round(min(base + 0.03 * min(len(said), 120) / 120, 0.95), 4)))
    return sorted(out, key=lambda x: x[:3])


def by_model(text: str, answer) -> list[tuple]:
    """Claims of a model's JSON answer that are in the text word for word; others, and answers that can't be read, are warned of and left out."""
    try:
        claims = json.loads(answer(text))
    except (TypeError, ValueError) as e:
        warnings.warn(f"an answer can't be read: {e}", stacklevel=2)
        return []
    out = []
    for c in claims if isinstance(claims, list) else []:
        said = c.get("text") if isinstance(c, dict) else c
        at = text.find(said) if isinstance(said, str) and said else -1
        if at < 0:
            warnings.warn(f"a claim isn't in the text: {said!r:.80}", stacklevel=2)
            continue
        try:
            confidence = float(c.get("confidence", 0.5)) if isinstance(c, dict) else 0.5
        except (TypeError, ValueError):
            confidence = 0.5
        out.append((at, at + len(said), said, "model", confidence))
    return out


def extract(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model=None) -> DataFrame:
    """(id, byte_start, byte_end, text, kind, confidence); ``model`` is a function from a text to JSON. The range is that of the match, whose text is without white space at its ends."""

    def run(batches):
        for batch in batches:
            rows = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = done = 0
                for a, b, said, kind, confidence in sorted(by_model(t, model) if model and t else heuristic(t)):
                    done += len(t[at:a].encode()) if a >= at else -len(t[a:at].encode())
                    at = a
                    rows.append((key, done, done + len(t[a:b].encode()), said, kind, confidence))
            kinds = (batch.column(0).type, pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=[id_col, "byte_start", "byte_end", "text", "kind", "confidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {kind}, byte_start int, byte_end int, text string, kind string, confidence double")
