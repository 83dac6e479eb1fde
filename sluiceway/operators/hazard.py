"""Scans of drafts and documents: planted tokens, contact data and secrets, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions import text as X
from sluiceway.session import broadcast_if_small

# Forms of contact data and secrets, and phrases that ask for a contact.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?:\+?1[-.\s])?(?:\(\d{3}\)\s?|\b\d{3}[-.\s])\d{3}[-.\s]\d{4}\b",
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "slack_token": r"\bxox[baprs]-[0-9A-Za-z-]{10,}\b",
}
SECRETS = ("aws_key", "slack_token")


def values(c: Column, kind: str) -> Column:
    return F.regexp_extract_all(c, F.lit(f"({PATTERNS[kind]})"), 1)


def detect(c: Column) -> Column:
    """An array of structs (kind, value), by kind and place."""
    none = F.array().cast("array<struct<kind:string,value:string>>")

    def of_kind(kind: str) -> Column:
        return F.transform(values(c, kind), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    parts = [of_kind(k) for k in PATTERNS]
    return F.coalesce(F.concat(*parts), none)


def mask(c: Column) -> Column:
    """The text with each value masked: first letter and domain, last four digits, or the prefix of a secret."""
    c = F.regexp_replace(c, r"\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", "$1***@$2")
    c = F.regexp_replace(c, r"(?:\+?1[-.\s])?(?:\(\d{3}\)\s?|\b\d{3}[-.\s])\d{3}[-.\s](\d{4})\b", "***-***-$1")
    c = F.regexp_replace(c, PATTERNS["aws_key"], "AKIA****************")
    return F.regexp_replace(c, r"\b(xox[baprs])-[0-9A-Za-z-]{10,}\b", "$1-********")


def authorizes_contact(query: Column, phrases: tuple[str, ...]) -> Column:
    """Whether the query, normalised, holds one of the phrases between blanks."""
    q = F.concat(F.lit(" "), X.normalize_text(query), F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out = out | q.contains(f" {p} ")
    return out


def action(text: Column, query: Column, phrases: tuple[str, ...]) -> Column:
    """``pass`` without hits; ``redact`` for contact data that the query asks for; ``refuse`` otherwise, secrets always."""
    found = detect(text)
    secret = F.exists(found, lambda h: h["kind"].isin(*SECRETS))
    return F.when(F.size(found) == 0, "pass").when(secret | ~authorizes_contact(query, phrases), "refuse").otherwise("redact")


def canary_scan(texts: DataFrame, registry: DataFrame, key: str, text: str, query: str, pattern: str) -> DataFrame:
    """Planted tokens in each text: ``key``, ``token``, ``leaked`` (not literally in the raw query).

    Candidates are cut out by the tokens' common ``pattern`` and joined with the registry."""
    cand = texts.select(key, query, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1))).alias("token"))
    known = registry.select("token").where("token <> ''").distinct()
    return cand.join(broadcast_if_small(known), "token").select(key, "token", (~F.coalesce(F.col(query).contains(F.col("token")), F.lit(False))).alias("leaked"))
