"""Sizes, offsets and identifiers of texts, as expressions that stay in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TERM = "[a-z][a-z0-9]*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_chars(text: Column | str) -> Column:
    return F.length(_col(text))


def n_bytes(text: Column | str) -> Column:
    return F.octet_length(_col(text))


def nws_bytes(text: Column | str) -> Column:
    """UTF-8 bytes that aren't ASCII white space."""
    return F.octet_length(F.regexp_replace(_col(text), r"[\t\n\x0B\f\r ]", ""))


def nws_chars(text: Column | str) -> Column:
    """Characters that aren't white space of any script."""
    return F.length(F.regexp_replace(_col(text), r"(?U)\s", ""))


def n_words(text: Column | str) -> Column:
    """Stretches without white space; the default token count."""
    return F.size(F.filter(F.split(_col(text), r"\s+"), lambda w: w != ""))


def size_of(text: Column | str, unit: str) -> Column:
    try:
        return {"chars": n_chars, "tokens": n_words, "nws": nws_chars, "nws_bytes": nws_bytes}[unit](text)
    except KeyError:
        raise ValueError(f"unknown size unit: {unit}") from None


def code_limit(max_size: int, unit: str) -> int:
    """A code chunk's limit in non-white-space bytes: four for a token, otherwise the number as it is."""
    return max_size * 4 if unit == "tokens" else max_size


def words(text: Column | str) -> Column:
    """Lower-case words of any script."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(WORD), F.lit(0))


def terms(text: Column | str) -> Column:
    """Lower-case ASCII terms that begin with a letter."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TERM), F.lit(0))


def stable_id(path: Column | str, index: Column | str, start: Column | str, end: Column | str) -> Column:
    """SHA-256 of path, index and byte range; the text isn't part of it."""
    zero = F.lit("\0")
    parts = [_col(path), *(_col(c).cast("string") for c in (index, start, end))]
    return F.sha2(F.concat(parts[0], zero, parts[1], zero, parts[2], zero, parts[3]).cast("binary"), 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; 0 where one of them is all zeros."""
    a, b = _col(a), _col(b)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def mock_embedding(text: Column | str) -> Column:
    """A deterministic vector from the number of bytes, for tests and demonstrations."""
    n = n_bytes(text)
    return F.array((n % 97).cast("double"), (F.floor(n / 97) % 97).cast("double"), F.lit(0.0))
