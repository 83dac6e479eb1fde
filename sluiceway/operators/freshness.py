"""Ages and per-source limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.session import broadcast_if_small


def source_key(c: F.Column) -> F.Column:
    return F.lower(F.trim(c))


def age_hours(ts: F.Column, now: F.Column) -> F.Column:
    """Hours from ``ts`` to ``now`` by microseconds."""
    return (F.unix_micros(now) - F.unix_micros(ts)) / 3.6e9


def with_limit(df: DataFrame, sources: DataFrame, source: str = "source_system", default: float = 48.0) -> DataFrame:
    """Adds ``max_age_hours``: that of the row's source, or ``default``. A negative limit fails the job when it is read."""
    s = sources.groupBy(source_key(F.col("source_system")).alias("__s")).agg(F.max("max_age_hours").alias("__m"))
    x = df.withColumn("__k", source_key(F.col(source))).join(broadcast_if_small(s), F.col("__k") == F.col("__s"), "left")
    limit = F.coalesce(F.nanvl("__m", F.lit(None).cast("double")), F.lit(default))
    return x.withColumn("max_age_hours", F.when(limit < 0, F.raise_error(F.lit("a limit must not be negative")).cast("double")).otherwise(limit)).drop("__k", "__s", "__m")


def check(df: DataFrame) -> DataFrame:
    """Adds ``fresh``: the age is at most the limit; a row without an age is not fresh."""
    return df.withColumn("fresh", F.coalesce(F.col("age_hours") <= F.col("max_age_hours"), F.lit(False)))
