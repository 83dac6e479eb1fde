"""Secrets in text that leaves the engine: detection by form and by improbability, redaction of nested results."""

from __future__ import annotations

import json
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of so many letters and digits with so many bits a character look random.
LEAST_LENGTH, LEAST_BITS = 16, 3.6

# Forms of secrets and contact data in order; an earlier form takes the text before a later one.
FORMS = (
    ("email", re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b")),
    ("aws_key", re.compile(r"\bAKIA[0-9A-Z]{16}\b")),
    ("slack_token", re.compile(r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b")),
    ("private_key", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)),
    ("jwt", re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("url_login", re.compile(r"(?<=://)[^\s/:@]+:[^\s/@]+(?=@)")),
    ("assignment", re.compile(r"(?i)(?<=\b)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key)\b\s*(?:=|:|\bis\b)\s*[\"']?(?P<value>[^\s\"',;]{6,})")),
    ("phone", re.compile(r"(?<!\w)(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s])\d{3}[-.\s]\d{4}(?!\w)")),
    ("hex", re.compile(r"\b[0-9a-f]{32,}\b")),
)
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST_LENGTH)


def bits(s: str) -> float:
    """Shannon entropy of the characters, in bits each."""
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def looks_random(s: str) -> bool:
    return len(s) >= LEAST_LENGTH and bool(re.search(r"\d", s)) and bool(re.search(r"[A-Za-z]", s)) and bits(s) >= LEAST_BITS and not re.fullmatch(r"[a-z0-9]+(?:[-_][a-z0-9]+)+", s)


def find_sensitive(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) without overlaps, in order."""
    taken: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if all(b <= x or a >= y for _, x, y in taken):
            taken.append((kind, a, b))

    for kind, rx in FORMS:
        for m in rx.finditer(text):
            add(kind, *(m.span("value") if kind == "assignment" else m.span()))
    for m in _RUN.finditer(text):
        if looks_random(m[0]):
            add("random", *m.span())
    return sorted(taken, key=lambda t: t[1])


def redact(text: str | None) -> str | None:
    """Each find becomes ``[REDACTED:<kind>]``; what is redacted already stays."""
    if not text:
        return text
    out, last = [], 0
    for kind, a, b in find_sensitive(text):
        out += [text[last:a], f"[REDACTED:{kind}]"]
        last = b
    return "".join([*out, text[last:]])


def redact_nested(value):
    """Redacts every text in nested lists and mappings."""
    if isinstance(value, str):
        return redact(value)
    if isinstance(value, dict):
        return {k: redact_nested(v) for k, v in value.items()}
    return [redact_nested(v) for v in value] if isinstance(value, list) else value


def _mapped(f, kind: str):
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f(x))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def redact_text(c: Column) -> Column:
    return _mapped(redact, "string")(c)


def redact_json(c: Column) -> Column:
    """Redacts the texts within a JSON value, for instance of ``to_json(struct(...))``."""
    return _mapped(lambda x: json.dumps(redact_nested(json.loads(x)), ensure_ascii=False), "string")(c)


def leaks(c: Column) -> Column:
    """How many finds a text still holds."""
    return _mapped(lambda x: len(find_sensitive(x)), "int")(c)
