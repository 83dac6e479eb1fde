"""Template residue, filler, error pages and script notices instead of content (problem 8).

Method: normalised lines are counted by host, recurrent boilerplate is subtracted, and a
record is excluded when its residual lines hold evidence of an error page, an unfilled
placeholder, filler or a notice that scripts are required.

A line is boilerplate on its host when many of the host's records hold it amid other
text: prose that reports, explains or quotes such things recurs so, whereas an error page
that recurs stands (nearly) alone and stays in the residual. Records whose lines free of
evidence are the same count once, so copies of one residue page don't vouch for each other.

What is evidence: an unfilled placeholder by the syntax of the template that left it; error
messages, filler and script notices by a classifier of lines (``residue_model``).

Scale: the texts are read once and only lines with evidence leave the scan; recurrence is
counted over these, since a line that is evidence here is so elsewhere. Hashes are shuffled,
folded within each task first, and keyed by the text as well, so a host with a third of all
rows is no hot key. Beside that the texts of each host are counted by their hash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.llm import residue_model
from sluiceway.session import cut

#: A line is recurrent when at least this share of its host's distinct texts, and at least so many, hold it.
RECURRENT_SHARE = 1 / 500
RECURRENT_ROWS = 5
#: ... and they have on average at least so many distinct lines, itself and those free of evidence.
COMPANY = 8.0

# --- lines

_BREAKS = re.compile(r"[\r\n\u2028\u2029]+|<br\s*/?>|</(?:p|div|h[1-6]|li|tr|title)>", re.I)
_MARKUP = re.compile(r"</?(?:html|head|body|title|h[1-6]|p|div|span|b|i|em|strong|ul|ol|li|a|table|tr|td|th|br|hr|pre|center|font)(?:\s[^<>]*)?/?>|<!doctype[^<>]*>|<!--.*?-->", re.I)
_LEAD = re.compile(r"^(?:\s|[-*•>|#]+(?=\s)|\d{1,4}[.)](?=\s)|\[\d{1,2}:\d{2}(?::\d{2})?\](?:\s*[\w.\-]{1,40}:(?=\s))?)+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)]*\s+")
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"\b(?=\w*\d)[0-9a-f]{6,}\b|\d+(?:[.,:]\d+)*")
_NAME = re.compile(r"\b\w+(?:[-_]\w+)+\b")


def lines_of(text: str) -> list[str]:
    """The lines of a text, and the sentences of each, without list marks, chat stamps and page markup."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).translate(_DROP_FORMAT)
    out = []
    for raw in _BREAKS.split(text):
        if "<" in raw:
            raw = _MARKUP.sub(" ", raw)
        raw = _LEAD.sub("", raw)
        for s in _SENTENCE.split(raw):
            if s := s.strip():
                out.append(_SPACE.sub(" ", s))
    return out


class _NoFormat(dict):
    def __missing__(self, code: int) -> int | None:
        self[code] = kept = None if unicodedata.category(chr(code)) == "Cf" else code
        return kept


_DROP_FORMAT = _NoFormat()


def normal_form(line: str) -> str:
    """What recurs: the line without case, numbers and the names of things."""
    return _NAME.sub("@", _NUMBER.sub("9", line.casefold()))


def line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(normal_form(line).encode("utf-8", "replace")) - (1 << 63)


# --- evidence

_QUOTED = re.compile(r"```.*?(?:```|$)|`[^`]*`|\"[^\"]{0,200}\"|“[^”]{0,200}”|«[^»]{0,200}»|„[^“”]{0,200}[“”]|(?<!\w)'[^']{1,80}'(?!\w)", re.S)
_FIELD = r"[A-Za-z_][\w.\- ]{0,40}"
#: Unfilled placeholders, by the syntax of the template that left them.
_PLACEHOLDER = re.compile(
    "|".join((
        r"\{\{[#/^&>{]?[^{}\n]{0,60}\}\}", r"\{%[^%\n]{0,60}%\}", r"<%[=\-]?[^%\n]{0,60}%>", rf"\$\{{{_FIELD}\}}", rf"#\{{{_FIELD}\}}",
        rf"\[\[{_FIELD}\]\](?!\()", rf"<<{_FIELD}>>", r"(?<![\w$])\{(?:\d{1,2}|[A-Za-z_][\w.\-]{0,40})\}", r"(?<![\d%])%[A-Za-z_][\w\-]{1,40}%", rf"%\({_FIELD}\)[sdif]\b",
        r"(?<!\w)__[A-Za-z][A-Za-z0-9_\-]{1,40}?__(?!\w)", r"(?<!\w)@@[\w\-]{1,40}@@", r"(?<!\w)#[A-Z][A-Z_]{2,40}#", r"\?\?[\w\-]{1,40}\?\?", r"(?<!\w)X{2,4}[-/]X{2,4}(?:[-/]X{2,4})?(?!\w)",
        r"<(?:insert|your|enter|add|fill in|placeholder|todo|tbd)\b[^<>\n]{0,40}>",
        r"\[(?:insert|your|enter|add|todo|tbd|fill in|placeholder|replace|describe|name (?:of|des|der|del|du)|hier|nom |nombre )\b[^\[\]\n]{0,60}\](?!\()",
        r"\[[^\[\]\n]{0,50}\b(?:here|eintragen|ausfüllen|einfügen|completar|rellenar|compléter|remplir|à compléter)\](?!\()",
        r"\([^()\n]{0,50}\b(?:to be (?:filled|added|completed|defined|confirmed)|fill in)\b[^()\n]{0,20}\)",
        r"\bTODO(?:\([\w\-]{1,40}\)|:)",
    )),
    re.I,
)
#: Bracketed bare words: a placeholder unless it is a closed HTML element, an e-mail or a link text.
_ANGLE = re.compile(r"<([A-Za-z][A-Za-z_\-]{1,40})>")
_SQUARE = re.compile(r"(?<![\w\]!])\[([A-Za-z][A-Za-z_\-]{2,40})\](?![(\[:\w])")
_STAMPED = re.compile(r"(?<!\bthe )(?<!\bour )(?<!\ball )\b(?:TBD|T\.B\.D\.|TBC|FIXME)\b(?!\s+(?:items?|entries|entry|list|notes?|marks?|fields?|labels?|tags?|rows?)\b)", re.I)

#: Variables of the environment that prose and commands name, and parts of files in square brackets: no slots to be filled.
# Names of such variables.
_ENVIRONMENT = "HOME|PATH|USER|PWD|SHELL|LANG|TMPDIR|TEMP|TMP|HOSTNAME|JAVA_HOME|PYTHONPATH|APPDATA|USERPROFILE|EDITOR|TERM"
_NAMED = re.compile(rf"\$\{{(?:{_ENVIRONMENT})\}}|%(?:{_ENVIRONMENT})%|\[[\w\-]+\](?= (?:section|stanza|header|table|block)\b| in the \w*\s?(?:ini|toml|conf|config|file)\b)")
_COMMAND = re.compile(r"^[$#>]?\s*[a-z][\w.\-/]*(?: [\w./:=\-]+)*? --?[a-z]")
#: A line is evidence if the classifier gives content less than the rest.
LEAST = 0.6


def evidence_of(line: str, closed: set[str]) -> str | None:
    """The kind of evidence in a line, quoted parts left aside; ``closed``: names of elements that the text closes."""
    bare = _QUOTED.sub(" ", line) if _QUOTE_MARK.search(line) else line
    if _SIGN.search(bare) and not _COMMAND.match(bare):
        slots = _NAMED.sub(" ", bare)
        if _PLACEHOLDER.search(slots) or _STAMPED.search(slots) or _SQUARE.search(slots):
            return "placeholder"
        if any(m[1].casefold() not in closed for m in _ANGLE.finditer(slots)):
            return "placeholder"
    kind, chance = residue_model.judge(bare)
    return kind if chance >= LEAST else None


# What a line must hold at all for the patterns above to be worth a look.
_QUOTE_MARK = re.compile("[`\"'“«„]")
_SIGN = re.compile(r"[{<\[%]|__|@@|\?\?|#[A-Z{]|[Xx]{2}[-/]|\b(?:TODO|TBD|T\.B\.D|TBC|FIXME|to be|fill in)", re.I)
_CLOSED = re.compile(r"</([A-Za-z][A-Za-z0-9_\-]*)>")


def scan_lines(df: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """One row per distinct line with evidence of each record: ``key``, ``host``, ``line`` (hash), ``kind`` of evidence, ``rest`` (hash of the
    record's distinct lines free of evidence) and ``n_lines`` (how many these are, with the line itself)."""
    import pyarrow as pa
    import xxhash

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            for k, h, s in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if not s:
                    continue
                closed = {x.casefold() for x in _CLOSED.findall(s)} if "</" in s else set()
                kinds = {line: evidence_of(line, closed) for line in dict.fromkeys(lines_of(s))}
                if not any(kinds.values()):
                    continue
                seen: dict[int, str | None] = {}
                for line, kind in kinds.items():
                    form = line_hash(line)
                    seen[form] = seen.get(form) or kind
                free = {form for form, kind in seen.items() if not kind}
                rest = xxhash.xxh3_64_intdigest(b"".join(x.to_bytes(8, "big", signed=True) for x in sorted(free))) - (1 << 63)
                for line, kind in seen.items():
                    if kind:
                        for col, v in zip(cols, (k, h, line, kind, rest, len(free) + 1)):
                            col.append(v)
            types = (batch.schema.field(0).type, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["key", "host", "line", "kind", "rest", "n_lines"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(host).cast("string"), text).mapInArrow(scan, f"key {kind}, host string, line bigint, kind string, rest bigint, n_lines int")


def boilerplate(marked: DataFrame, df: DataFrame, host: str, text: str, share: float = RECURRENT_SHARE, rows: int = RECURRENT_ROWS, company: float = COMPANY) -> DataFrame:
    """The recurrent lines of each host, of those ``marked`` by ``scan_lines``: ``host``, ``line`` (hash), ``records``.

    Copies count once: a line's ``records`` are the different sets of lines free of evidence that it stands amid, a host's
    records its different texts."""
    present = df.where(F.col(text).isNotNull())
    per_host = present.groupBy(F.col(host).cast("string").alias("host")).agg(F.countDistinct(F.xxhash64(text)).alias("host_records"))
    counts = (
        marked.groupBy("host", "line", "rest").agg(F.max("n_lines").alias("n_lines"))
        .groupBy("host", "line").agg(F.count("*").alias("records"), F.sum("n_lines").alias("company"))
        .where((F.col("records") >= rows) & (F.col("company") >= company * F.col("records")))
    )
    return counts.join(per_host, counts["host"].eqNullSafe(per_host["host"])).where(F.col("records") >= share * F.col("host_records")).select(counts["host"], "line", "records")


def find_residue(
    df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", share: float = RECURRENT_SHARE, rows: int = RECURRENT_ROWS, company: float = COMPANY
) -> DataFrame:
    """One row per record with evidence in its residual lines: ``key`` and ``kinds`` (sorted array of
    ``error``, ``filler``, ``placeholder``, ``script``).

    Null and blank texts hold no evidence; a null host is a host of its own; repeated rows
    of one key give one row; an empty table gives none; other columns are not read.
    """
    marked = cut(scan_lines(df, key, host, text))
    known = boilerplate(marked, df, host, text, share, rows, company).select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "line")
    marked = marked.select("key", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "line", "kind")
    left = marked.join(known, ["host", "no_host", "line"], "left_anti")
    return left.groupBy(F.col("key").alias(key)).agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
