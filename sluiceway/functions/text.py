"""Text normalisation, tokens and sentences as native column expressions.

Everything here stays inside whole-stage code generation. Accents, full-width and other
compatible forms are folded by a ``translate`` table made by rule from the Unicode
database (Latin letters and full-width forms); ``normalize_text_exact`` covers all of
Unicode with an Arrow function where that matters. Each ``*_sql`` function gives the same
step for the SQL counterparts.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content, and the filler of polite questions.
STOPWORDS = tuple(
    """
    a an and are as at be by do for from how i in is it of on or our the to was we what when where which who will with
    you your this that these those current currently please me my now right does did should can about into many much
    some any also just still running run configured using used get got tell show give need needs recommend recommended
    recommends setting settings enabled am been being were has have had its they them their there here if then than so
    too very may might must shall would could why whom whose us
    """.split()
)
FILLER_WORDS = tuple(
    """
    hey hi hello team folks all sorry bother bothering but wondering wonder curious quick question kindly thanks thank
    pls plz chance mind know let like want wanted ask asking help appreciate anyone someone somebody happen possibly
    maybe actually basically okay ok
    """.split()
)
WH_WORDS = ("what", "which", "who", "whom", "whose", "when", "where", "why", "how")
_IS_WORDS = ("what", "where", "who", "how", "when", "why", "which", "that", "there", "here", "it")
# Groups of words of one meaning in operations; the first is the corpus's own.
SYNONYM_GROUPS = (
    ("restart",), ("replicas", "instances", "pods"), ("utilization", "usage"), ("qps", "rps", "throughput"), ("incident", "outage"), ("mitigation", "remediation"), ("runbook", "playbook"),
    ("procedure", "process"), ("rollback", "revert"), ("target", "goal"), ("deploy", "deployment", "release"), ("production", "prod"), ("flag", "toggle"), ("endpoint", "url"), ("token", "secret"),
)

_JOINERS = r"\-_./:@"


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """From and to texts for ``translate``: one letter for one letter, then what is dropped."""
    pairs: dict[str, str] = {}
    for code in (*range(0xA0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF01, 0xFF5F), 0x3000):
        c = chr(code)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and len(plain) == 1:
            pairs[c] = plain
    typographic = {"‘": "'", "’": "'", "‛": "'", "′": "'", "“": '"', "”": '"', "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": " ", "−": "-", " ": " "}
    pairs.update(typographic)
    dropped = [chr(c) for c in (0x200B, *range(0x300, 0x370))]
    return "".join(pairs) + "".join(dropped), "".join(pairs.values())


def _steps() -> list[tuple[str, str]]:
    """Regex steps after folding and lower-casing; free of look-around, so that other engines run them too."""
    return [
        (rf"\b({'|'.join(_IS_WORDS)})'s\b", "$1 is"),
        (r"'s\b", ""),
        (r"'", ""),
        (rf"[^a-z0-9{_JOINERS}\s]+", " "),
        (rf"[{_JOINERS}]{{2,}}", " "),
        (rf"(^|\s)[{_JOINERS}]", " "),
        (rf"[{_JOINERS}](\s|$)", " "),
        (r"\s+", " "),
        (r"^ | $", ""),
    ]


def normalize_text(c: Column) -> Column:
    """The canonical matching form: lower case, no accents, no loose punctuation; joiners only between letters or digits.

    Steps that a text can't need are branches not taken: folding of plain ASCII, contractions
    without an apostrophe. Look-around takes three passes of ``_steps`` in one.
    """
    a, b = fold_table()
    t = F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, a, b)).otherwise(c))
    short = t
    for rx, to in _steps()[:3]:
        short = F.regexp_replace(short, rx, to)
    t = F.when(t.contains("'"), short).otherwise(t)
    t = F.regexp_replace(t, rf"[^a-z0-9{_JOINERS}\s]+", " ")
    t = F.regexp_replace(t, rf"(?<![a-z0-9])[{_JOINERS}]+|[{_JOINERS}]+(?![a-z0-9])", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def normalize_sql(expr: str) -> str:
    a, b = fold_table()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    t = f"lower(translate({expr}, {q(a)}, {q(b)}))"
    for rx, to in _steps():
        t = f"regexp_replace({t}, {q(rx)}, {q(to.replace('$1', chr(92) + '1'))}, 'g')"
    return t


_PLAIN_IS = re.compile(rf"\b({'|'.join(_IS_WORDS)})'s\b")


def normalize_python(text: str) -> str:
    """The same for all of Unicode, in Python."""
    if not text:
        return ""
    a, b = fold_table()
    fixed = {ord(x): (b[i] if i < len(b) else None) for i, x in enumerate(a)}
    t = unicodedata.normalize("NFKD", text.translate(fixed))
    t = unicodedata.normalize("NFKC", "".join(x for x in t if not unicodedata.combining(x))).lower()
    for rx, to in _steps():
        t = re.sub(rx, to.replace("$1", r"\1"), t, flags=re.ASCII if "s+" not in rx and r"\s" not in rx else 0)
    return t


def normalize_text_exact(c: Column) -> Column:
    """``normalize_text`` for all of Unicode, as an Arrow function."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else normalize_python(x))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(c)


TOKEN = r"[a-z0-9][a-z0-9_\-]+"


def tokens(normal: Column) -> Column:
    """Words of two letters or more of a normalised text, in order, with repeats."""
    return F.regexp_extract_all(normal, F.lit(f"({TOKEN})"), 1)


def tokens_sql(normal: str) -> str:
    return f"regexp_extract_all({normal}, '{TOKEN}')"


def content_tokens(toks: Column) -> Column:
    stop = F.split(F.lit(" ".join((*STOPWORDS, *FILLER_WORDS))), " ")  # folded to a constant by the optimiser
    return F.filter(toks, lambda t: ~F.array_contains(stop, t))


def stop_sql() -> str:
    return "[" + ", ".join(f"'{w}'" for w in (*STOPWORDS, *FILLER_WORDS)) + "]"


def is_identifier(tok: Column) -> Column:
    """Tokens with a digit, hyphen, underscore or dot match exactly or not at all."""
    return tok.rlike(r"[0-9\-_.]")


def fold_token(tok: Column) -> Column:
    """A light plural fold."""
    return F.when((F.length(tok) > 4) & tok.rlike("s$") & ~tok.rlike("(ss|us|is)$"), F.substring(tok, F.lit(1), F.length(tok) - 1)).otherwise(tok)


def fold_sql(tok: str) -> str:
    return f"CASE WHEN length({tok}) > 4 AND {tok} LIKE '%s' AND NOT regexp_matches({tok}, '(ss|us|is)$') THEN substr({tok}, 1, length({tok}) - 1) ELSE {tok} END"


def synonyms(tok: Column) -> Column:
    """The other words of the group of a token or of its singular; null if there is none, or it holds a digit."""
    entries = ";".join(f"{w}:{','.join(o for o in g if o != w)}" for g in SYNONYM_GROUPS if len(g) > 1 for w in g)
    members = F.str_to_map(F.lit(entries), F.lit(";"), F.lit(":"))
    found = F.coalesce(F.try_element_at(members, tok), F.try_element_at(members, fold_token(tok)))
    return F.when(~tok.rlike("[0-9]"), F.split(found, ","))


def match_forms(toks: Column) -> Column:
    """All spellings under which the tokens count as matched: themselves, their folded form, a plural, and without hyphens."""
    folded = F.transform(toks, fold_token)
    plural = F.transform(F.filter(toks, lambda t: fold_token(t) == t), lambda t: F.concat(t, F.lit("s")))
    joined = F.transform(F.filter(toks, lambda t: t.contains("-") & ~t.rlike("[0-9]")), lambda t: F.replace(t, F.lit("-"), F.lit("")))
    return F.array_distinct(F.concat(toks, folded, plural, joined))


def split_sentences(c: Column) -> Column:
    """Sentences of a text: parts after ``.``, ``!`` or ``?`` and white space; the whole text if there is no such place."""
    marked = F.regexp_replace(F.regexp_replace(c, r"([.!?])\s+", "$1\u0001"), r"^\s+|\s+$", "")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def sentences_sql(expr: str) -> str:
    marked = f"regexp_replace(regexp_replace({expr}, '([.!?])\\s+', '\\1' || chr(1), 'g'), '^\\s+|\\s+$', '', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


#: A blank line, with whatever line ends.
PARAGRAPH = r"(\r\n|\r|\n)[ \t]*(\r\n|\r|\n)\s*"


def paragraphs(c: Column) -> Column:
    marked = F.regexp_replace(c, PARAGRAPH, "\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def paragraphs_sql(expr: str) -> str:
    marked = f"regexp_replace({expr}, '{PARAGRAPH}', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


def char_ngrams(c: Column, n: int = 3) -> Column:
    """Padded character grams of a word."""
    p = F.concat(F.lit(" " * 1), c, F.lit(" " * 1))
    return F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))).otherwise(F.array(p))


def dice(a: Column, b: Column) -> Column:
    """Dice similarity of two arrays of distinct grams."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(a, b)) / total).otherwise(0.0)


def clean_markdown(c: Column) -> Column:
    """Prose without fenced and inline code, links, addresses, tags and entities."""
    for rx, to in (
        (r"(?s)```.*?```", " "), (r"(?m)^(?: {4}|\t).*$", " "), (r"`[^`]*`", " "), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"https?://\S+", " "), (r"<[^>]+>", " "), (r"&[a-zA-Z]+;|&#\d+;", " "), (r"\s+", " "),
    ):
        c = F.regexp_replace(c, rx, to)
    return F.trim(c)
