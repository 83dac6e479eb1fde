"""Cutting oversized texts at natural boundaries (problem 2).

Method: balanced targets. The least number of pieces is computed from the limit and the
overlap, equal-length targets are placed, each is snapped to the strongest boundary
nearby, and a piece is added and all is placed anew while any piece exceeds the limit.
A text is handled by one row-local function, so nothing is shuffled and the work follows
the bytes read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1200
OVERLAP = 100
#: How far a piece may repeat less than the overlap, so as to begin at a word.
SLACK = 30

# Boundaries from the strongest: the cut lies at the end of the match.
BOUNDARIES = (
    ("paragraph", re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")),
    ("line", re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*")),
    ("sentence", re.compile(r"[.!?…。！？][\"'”’)\]]*\s+|[。！？]")),
    ("clause", re.compile(r"[;:,]\s+")),
    ("word", re.compile(r"\s+")),
)
_SOLID = re.compile(r"\S+")
_SPACE = re.compile(r"\s+")
#: A character that belongs to the one before it: never cut in front of it.
_JOINED = re.compile(r"[̀-ͯ‍︀-️\U0001f3fb-\U0001f3ff⃐-⃿]")


def longest_solid_run(text: str) -> int:
    return max((m.end() - m.start() for m in _SOLID.finditer(text)), default=0)


def _marks(text: str) -> list[tuple[str, list[int]]]:
    return [(name, [m.end() for m in rx.finditer(text) if 0 < m.end() < len(text)]) for name, rx in BOUNDARIES]


def _closest(at: list[int], target: int, low: int, high: int) -> int | None:
    i = bisect_left(at, target)
    return min((p for p in at[max(0, i - 1) : i + 1] if low <= p <= high), key=lambda p: (abs(p - target), p), default=None)


def _snap(marks: list[tuple[str, list[int]]], target: int, low: int, high: int, reach: int) -> tuple[int, str]:
    """The strongest boundary within ``reach`` of ``target`` and in [low, high]; failing that the nearest of any
    strength in [low, high]; failing that the target itself."""
    for name, at in marks:
        if (p := _closest(at, target, max(low, target - reach), min(high, target + reach))) is not None:
            return p, name
    far = [(abs(p - target), i, p) for i, (_, at) in enumerate(marks) if (p := _closest(at, target, low, high)) is not None]
    if far:
        _, i, p = min(far)
        return p, marks[i][0]
    return target, "forced"


def _overlap_start(text: str, cut: int, overlap: int, slack: int) -> int:
    """Where the piece after the cut begins: ``overlap`` back, or up to ``slack`` later at a word's beginning."""
    start = max(0, cut - overlap)
    if start and not text[start - 1].isspace() and (m := _SPACE.search(text, start, min(cut, start + slack))):
        if m.end() < cut and m.end() <= start + slack:
            return m.end()
    return start


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK) -> list[tuple[int, int, str]]:
    """Pieces of ``text`` as (start, end, boundary at the end), each at most ``limit`` long, together covering it all."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    marks = _marks(text)
    step = limit - overlap
    count = 1 + -(-(n - limit) // step)
    while True:
        pieces, start, cut = [], 0, 0
        for k in range(1, count):
            # what is left, shared evenly by the pieces that are left, and never more than they can hold
            low, high = max(cut + 1, n - (count - k) * step), min(start + limit, n - 1)
            if low > high:
                break
            target = min(max(cut + round((n - cut) / (count - k + 1)), low), high)
            end, name = _snap(marks, target, low, high, reach=max(1, step // 8))
            if name == "forced":
                while end > low and _JOINED.match(text[end]):
                    end -= 1
            pieces.append((start, end, name))
            cut, start = end, max(start, _overlap_start(text, end, overlap, slack))
        if n - start <= limit:
            return [*pieces, (start, n, "end")]
        count += 1


def split_oversized(
    df: DataFrame, text: str = "body", limit: int = LIMIT, overlap: int = OVERLAP, slack: int = SLACK
) -> DataFrame:
    """The rows of ``df`` with ``pieces`` (array of structs piece, start, end, boundary, text), ``n_chars`` and
    ``longest_run`` (longest run without white space, computed for oversized texts only).

    Positions are code points. A text within the limit, also an empty one, is one piece; a
    null text has no pieces (empty array). ``overlap`` must be smaller than ``limit``.
    Columns of these names in ``df`` are replaced.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    kind = "struct<longest_run:int,pieces:array<struct<piece:int,start:int,end:int,boundary:string,text:string>>>"

    @F.pandas_udf(kind)
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            runs, all_pieces = [], []
            for s in batch:
                if s is None or len(s) <= limit:  # not oversized: handled without Python's help
                    runs.append(None)
                    all_pieces.append(None)
                    continue
                runs.append(longest_solid_run(s))
                all_pieces.append(
                    [{"piece": i, "start": a, "end": b, "boundary": name, "text": s[a:b]} for i, (a, b, name) in enumerate(split_text(s, limit, overlap, slack))]
                )
            yield pd.DataFrame({"longest_run": pd.array(runs, dtype="Int32"), "pieces": all_pieces})

    n = F.length(text)
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.lit(0).alias("start"), n.alias("end"), F.lit("end").alias("boundary"), F.col(text).alias("text")))
    keep = [c for c in df.columns if c not in ("pieces", "n_chars", "longest_run")]
    # marked so that a later filter on the pieces doesn't run the function a second time
    big = df.withColumn("__cut", cut.asNondeterministic()(F.when(n > limit, F.col(text))))
    pieces = F.when(n > limit, F.col("__cut.pieces")).when(n.isNotNull(), whole).otherwise(F.array().cast("array<struct<piece:int,start:int,end:int,boundary:string,text:string>>"))
    return big.select(*keep, n.alias("n_chars"), F.col("__cut.longest_run").alias("longest_run"), pieces.alias("pieces"))
