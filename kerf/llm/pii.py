"""Format-preserving pseudonyms of personal data by keyed Feistel permutations.

Values are found by pattern and then validated: card numbers by Luhn's check, IPv4 octets,
calendar dates, IBANs by their check digits, phone and social security numbers by their ranges.
A valid value is permuted within its format: the number that its free characters stand for is put
through a balanced Feistel network of keyed BLAKE2b rounds, walking the cycle until it is a value that is valid in the same
way again.  The permutation depends on the key and the format only, so equal values stay equal in all documents
and different ones stay different; with the key it can be inverted.  Separators and letter case stay,
check digits are computed anew.  Access keys and passwords are permuted within their classes of characters, and so
are the local part and, apart, the domain of an e-mail address, whose last label stays.

Defined cases: null texts stay null, empty ones empty; values that fail validation stay as they are, digits of card length
without a valid check digit too; digits are ASCII digits, others are no part of any value; what begins within a candidate that failed is searched again,
a card may be some of its candidate's groups and an IBAN may end before its candidate does; overlapping candidates are taken from the left; repeated rows get equal results; extra columns are ignored by ``redact``; empty tables
give none; very long texts are processed whole.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerf.llm import vec

#: An example; production passes its own.
KEY = b"kerf pseudonyms"
ROUNDS = 8
_FIRST_DAY, _DAYS = dt.date(1900, 1, 1).toordinal(), 73_049

_SEP = r"[ \-./]?"
FINDERS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[opsu]_[A-Za-z0-9]{20,}\b|\bsk-[A-Za-z0-9]{20,}\b",
    "secret": r"(?i:\b(?:password|passwd|secret|token|api_?key)\s?[=:]\s?\"?)(?P<secret_value>[A-Za-z0-9]{8,})",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[./\-][0-9]{2}[./\-][0-9]{4})\b",
    "ip": r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9\-])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9\-])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9\w])(?:\+[0-9]{1,3}[ .\-]?)?\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}(?![0-9\-])|(?<![0-9\w])\+[0-9](?:[ .\-]?[0-9]){7,14}(?![0-9])",
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p in FINDERS.items()))
#: A text without any of these holds no candidate.
SIGN = "[0-9@]|AKIA|ASIA|gh[opsu]_|sk-|(?i)(password|passwd|secret|token|api_?key)"


@functools.lru_cache(1 << 18)
def permute(value: int, size: int, domain: str, key: bytes, inverse: bool = False) -> int:
    """A keyed permutation of range(size): a Feistel network on the next even number of bits, with cycle walking."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ _round(left, r, half, domain, key), left
            else:
                left, right = right, left ^ _round(right, r, half, domain, key)
        value = left << half | right
        if value < size:
            return value


def _round(x: int, r: int, half: int, domain: str, key: bytes) -> int:
    h = hashlib.blake2b(f"{domain}|{half}|{r}|{x}".encode(), key=key[:64], digest_size=32).digest()
    return int.from_bytes(h, "big") & ((1 << half) - 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _refill(shape: str, chars: str) -> str:
    """``shape`` with its letters and digits replaced in order."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _number(s: str, domain: str, key: bytes, inverse: bool) -> str:
    return str(permute(int(s), 10 ** len(s), f"{domain}{len(s)}", key, inverse)).zfill(len(s)) if s else s


def luhn(s: str) -> int:
    """The check digit that follows ``s``."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(s)))
    return -total % 10


def _card(v: str, key: bytes, inverse: bool) -> str | None:
    d = _digits(v)
    if luhn(d[:-1]) != int(d[-1]):
        return None
    body = d[0] + _number(d[1:-1], "card" + d[0], key, inverse)
    return _refill(v, body + str(luhn(body)))


def _ip(v: str, key: bytes, inverse: bool) -> str | None:
    octets = [int(x) for x in v.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in v.split(".")):
        return None
    n = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip", key, inverse)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(v: str, key: bytes, inverse: bool) -> str | None:
    sep = v[4] if not v[4].isdigit() else v[2]
    a, b, c = v.split(sep) if v.count(sep) == 2 else ("", "", "")
    orders = [("ymd", (a, b, c))] if len(a) == 4 else [("dmy", (c, b, a)), ("mdy", (c, a, b))]
    for form, (y, m, d) in orders:
        try:
            day = dt.date(int(y), int(m), int(d)).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            continue
        # Day-first and month-first dates are permuted among those that read the same way, so that they can be inverted.
        while True:
            day = permute(day, _DAYS, form, key, inverse)
            new = dt.date.fromordinal(day + _FIRST_DAY)
            if form != "mdy" or new.day > 12:
                break
        return new.strftime({"ymd": f"%Y{sep}%m{sep}%d", "dmy": f"%d{sep}%m{sep}%Y", "mdy": f"%m{sep}%d{sep}%Y"}[form])
    return None


def _iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02d}"


def _iban(v: str, key: bytes, inverse: bool) -> str | None:
    s = v.replace(" ", "")
    if not 15 <= len(s) <= 34 or _iban_check(s[:2], s[4:]) != s[2:4]:
        return None
    body = _classes(s[4:], "iban", key, inverse)
    return _refill(v, s[:2] + _iban_check(s[:2], body) + body)


def _classes(v: str, domain: str, key: bytes, inverse: bool) -> str:
    """Permutes all ASCII letters and digits together, each within its class: one number in mixed base."""
    kinds = [("0123456789" if c in "0123456789" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if "A" <= c <= "Z" else None) for c in v]
    n, size = 0, 1
    for c, k in zip(v, kinds):
        if k:
            n, size = n * len(k) + k.index(c), size * len(k)
    n = permute(n, size, domain + "".join(k[0] if k else c for c, k in zip(v, kinds)), key, inverse)
    out = []
    for c, k in zip(reversed(v), reversed(kinds)):
        if k:
            n, i = divmod(n, len(k))
            out.append(k[i])
        else:
            out.append(c)
    return "".join(reversed(out))


def _hex(v: str, domain: str, key: bytes, inverse: bool) -> str:
    if re.fullmatch("[0-9a-f]+", v):
        return f"{permute(int(v, 16), 16 ** len(v), f'{domain}hex{len(v)}', key, inverse):0{len(v)}x}"
    while True:
        v = _classes(v, domain, key, inverse)
        if not re.fullmatch("[0-9a-f]+", v):
            return v


def _ssn(v: str, key: bytes, inverse: bool) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = _digits(v)
    if not valid(d):
        return None
    while True:
        d = _number(d, "ssn", key, inverse)
        if valid(d):
            return _refill(v, d)


def _phone(v: str, key: bytes, inverse: bool) -> str | None:
    """A country code that is set apart stays; North American area codes and exchanges stay within 2 to 9 in front, and other numbers stay others."""
    head = re.match(r"\+[0-9]{1,3}(?=[ .\-(])", v)
    lead = head.group() if head else ""
    rest = v[len(lead) :]
    d = _digits(rest)
    if not 7 <= len(d) <= 15:
        return None
    def north(d: str) -> bool:
        return len(d) == 10 and d[0] > "1" and d[3] > "1"

    kind = north(d)
    while True:
        d = _number(d, "phone" + lead, key, inverse)
        if north(d) == kind:
            return lead + _refill(rest, d)


def _email(v: str, key: bytes, inverse: bool) -> str:
    local, _, domain = v.rpartition("@")
    name, _, last = domain.rpartition(".")
    return _classes(local, "email", key, inverse) + "@" + _classes(name, "domain", key, inverse) + "." + last


def _swap(m: re.Match, key: bytes, inverse: bool) -> tuple[str, str] | None:
    """(kind, replacement) of a match, or None if its value isn't valid."""
    kind, v = m.lastgroup, m.group()
    if m["secret"] is not None:
        value = m["secret_value"]
        return "secret", v[: len(v) - len(value)] + _hex(value, "secret", key, inverse)
    if kind == "access_key":
        head = 4 if v[0].isupper() or v[2] == "_" else 3
        return kind, v[:head] + _classes(v[head:], kind, key, inverse)
    new = {"email": _email, "iban": _iban, "date": _date, "ip": _ip, "card": _card, "ssn": _ssn, "phone": _phone}[kind](v, key, inverse)
    return None if new is None else (kind, new)


def redact_text(text: str | None, key: bytes = KEY, inverse: bool = False) -> tuple[str | None, int]:
    """(text with pseudonyms, number of values); ``inverse`` undoes it."""
    if not text:
        return text, 0
    out, done, at, n = [], 0, 0, 0
    while m := PATTERN.search(text, at):
        start, end = m.span()
        if m.lastgroup == "card" and not _valid_card(m.group()):
            # Digits that only look like a card stay, but not a card among them.
            new, start, end = _inner_card(text, start, end, key, inverse)
        else:
            new = _swap(m, key, inverse)
            if new is None and m.lastgroup == "iban":
                new, end = _shorter_iban(text, start, end, key, inverse)
        if new is None:
            at = m.start() + 1
            continue
        out += text[done:start], new[1]
        done = at = end
        n += 1
    return "".join(out) + text[done:], n


def _valid_card(v: str) -> bool:
    d = _digits(v)
    return luhn(d[:-1]) == int(d[-1])


def _inner_card(text: str, start: int, end: int, key: bytes, inverse: bool) -> tuple[tuple[str, str] | None, int, int]:
    """The longest run of whole groups of digits that is a card, and its range."""
    groups = [x.span() for x in re.finditer("[0-9]+", text[start:end])]
    runs = sorted(((a, b) for i, (a, _) in enumerate(groups) for _, b in groups[i:]), key=lambda r: (r[0] - r[1], r[0]))
    for a, b in runs:
        v = text[start + a : start + b]
        if 13 <= len(_digits(v)) <= 19 and _valid_card(v):
            return ("card", _card(v, key, inverse)), start + a, start + b
    return None, start, end


def _shorter_iban(text: str, start: int, end: int, key: bytes, inverse: bool) -> tuple[tuple[str, str] | None, int]:
    """The longest valid IBAN of whole words of an invalid match, and its end."""
    while (end := text.rfind(" ", start, end)) > start:
        new = _iban(text[start:end], key, inverse)
        if new is not None:
            return ("iban", new), end
    return None, end


def redact(docs: DataFrame, key: bytes = KEY, inverse: bool = False) -> DataFrame:
    """(doc_id, text, n_values) of every row. Texts without a digit, an @, a key's prefix or a secret's name never leave the JVM's rows unread by Python's patterns."""
    if not key:
        raise ValueError("a key is needed")

    def run(batches):
        for batch in batches:
            for a, b in vec.slices(batch.column(1)):
                part = batch.slice(a, b - a)
                texts, counts = [], []
                for t, maybe in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    new, n = redact_text(t, key, inverse) if maybe else (t, 0)
                    texts.append(new)
                    counts.append(n)
                yield pa.record_batch([part.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["doc_id", "text", "n_values"])

    marked = docs.select("doc_id", "text", F.coalesce(F.col("text").rlike(SIGN), F.lit(False)).alias("maybe"))
    return marked.mapInArrow(run, "doc_id bigint, text string, n_values int")
