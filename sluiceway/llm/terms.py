"""Frequency of every term of a text collection (problem 4).

Method: last-seen counters. Each map task walks its records in order and keeps, per
term, ``[occurrences, records, last record]``: a term's record count grows only when its
last record is another one, so no set of records is ever held. The partial counters are
hash-partitioned on the term and summed; that is exact because a record is read by one
task as a whole, and it sends each task's copy of a term once, however hot the term is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A task hands on its counters, at the end of a record, when it holds so many terms. It bounds memory, not results.
FLUSH_TERMS = 500_000

_ASCII_WORD = re.compile(r"[a-z0-9]+")


class _LettersAndDigits(dict):
    """For ``str.translate``: what is neither a letter nor a number becomes a blank; filled as characters come up."""

    def __missing__(self, code: int) -> int:
        self[code] = kept = code if unicodedata.category(chr(code))[0] in "LN" else 32
        return kept


class _NoFormat(dict):
    def __missing__(self, code: int) -> int | None:
        self[code] = kept = None if unicodedata.category(chr(code)) == "Cf" else code
        return kept


_TO_WORDS, _DROP_FORMAT = _LettersAndDigits(), _NoFormat()


def terms_of(text: str) -> list[str]:
    """Longest runs of letters and digits, after dropping format characters, NFKC and lower case."""
    if text.isascii():
        return _ASCII_WORD.findall(text.lower())
    return unicodedata.normalize("NFKC", text.translate(_DROP_FORMAT)).lower().translate(_TO_WORDS).split()


def count_terms(df: DataFrame, text: str, flush_terms: int = FLUSH_TERMS) -> DataFrame:
    """One row per term of ``df[text]``: ``term``, ``occurrences``, ``records``.

    Null and blank texts hold no term; repeated rows count as records of their own; an
    empty table gives no rows. Only ``text`` is read, so other columns can't clash.
    """
    import pyarrow as pa

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}

        def out() -> pa.RecordBatch:
            rows = seen.values()
            return pa.RecordBatch.from_arrays(
                [pa.array(seen.keys(), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())],
                names=["term", "occurrences", "records"],
            )

        record = 0
        for batch in batches:
            for value in batch.column(0):
                s = value.as_py()
                record += 1
                if s is None:
                    continue
                for term in terms_of(s):
                    entry = seen.get(term)
                    if entry is None:
                        seen[term] = [1, 1, record]
                    else:
                        entry[0] += 1
                        if entry[2] != record:
                            entry[1] += 1
                            entry[2] = record
                if len(seen) >= flush_terms:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    parts = df.select(F.col(text)).mapInArrow(partial, "term string, occurrences bigint, records bigint")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(counts: DataFrame, df: DataFrame, text: str, common_above: float = 0.2, rare_at_most: int = 1) -> DataFrame:
    """Adds ``n_rows`` (non-null rows of ``df[text]``) and ``mark``: ``common`` if more than the share
    ``common_above`` of them hold the term, else ``rare`` if at most ``rare_at_most`` rows do, else null."""
    total = df.agg(F.count(text).alias("n_rows"))  # one row, whatever the input
    mark = F.when(F.col("records") > F.col("n_rows") * common_above, "common").when(F.col("records") <= rare_at_most, "rare")
    return counts.join(F.broadcast(total)).withColumn("mark", mark)
