"""Splits that depend on keys alone: the same row falls in the same part wherever it is computed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unit(salt: str, *keys: str | Column) -> Column:
    """A number from 0 to 1 from a salted SHA-1 of the keys."""
    text = F.concat_ws("|", F.lit(salt), *[F.col(k).cast("string") if isinstance(k, str) else k for k in keys])
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("double") / 4294967295.0


def hash_split(salt: str, parts: dict[str, float], *keys: str) -> Column:
    """The name of a part; shares add up to one or less, the last part takes the rest."""
    u, total, names = unit(salt, *keys), 0.0, list(parts)
    out = F.lit(names[-1])
    for name in reversed(names[:-1]):
        total = sum(parts[n] for n in names[: names.index(name) + 1])
        out = F.when(u < total, name).otherwise(out)
    return out


def group_split(rows: DataFrame, group: str, label: str, salt: str, halves: tuple[str, str] = ("tune", "confirm")) -> DataFrame:
    """Whole groups in two halves of like size for each label: ``rows`` with ``half``.

    Groups of a label go in order of their salted hash to the half that a running sum
    says is behind, decided by the parity of the middle of each group's place: one window
    for each label instead of a loop on the driver.
    """
    sizes = rows.groupBy(group, label).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(label).orderBy(unit(salt, group), group)
    total = Window.partitionBy(label)
    before = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = sizes.withColumn("half", F.when(F.coalesce(before, F.lit(0)) + F.col("__n") / 2 <= F.sum("__n").over(total) / 2, halves[0]).otherwise(halves[1]))
    return rows.join(placed.select(group, label, "half"), [group, label])
