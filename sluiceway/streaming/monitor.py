"""Streams of requests: windowed counts, and session costs as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

WATERMARK = "10 minutes"


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling(events: DataFrame, ts: str, by: str, width: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Counts per window; partial counts are combined before the shuffle, so a hot ``by`` value costs one row a task."""
    return (
        events.withWatermark(ts, watermark).groupBy(F.window(ts, width), by).agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "events")
    )


def sliding(events: DataFrame, ts: str, by: str, width: str = "1 hour", slide: str = "10 minutes", watermark: str = WATERMARK) -> DataFrame:
    return (
        events.withWatermark(ts, watermark).groupBy(F.window(ts, width, slide), by).agg(F.count("*").alias("events"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "events")
    )


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", watermark: str = WATERMARK) -> DataFrame:
    return (
        events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("events"))
        .select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "events")
    )


def running_budget(requests: DataFrame, session: str, ts: str, seq: str, cost: str, limit: float, watermark: str = WATERMARK) -> DataFrame:
    """Each request with ``projected`` cost of its session and ``over_budget``; what a session has spent is keyed state.

    Costs are kept in thousandths. Requests of a batch are charged in order of time and
    sequence; a session's state is one number and goes an hour after its last request.
    """
    kind = requests.schema[session].dataType.simpleString()
    seq_kind = requests.schema[seq].dataType.simpleString()

    def charge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        spent = state.get[0] if state.exists else 0
        g = pd.concat(list(frames)).sort_values([ts, seq], kind="stable")
        total = spent + (g[cost] * 1000).round().astype("int64").cumsum()
        yield pd.DataFrame({session: key[0], seq: g[seq].to_numpy(), "projected": (total / 1000.0).to_numpy(), "over_budget": (total > round(limit * 1000)).to_numpy()})
        state.update((int(total.iloc[-1]),))
        state.setTimeoutTimestamp(max(int(g[ts].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + 3_600_000)

    return (
        requests.withWatermark(ts, watermark).groupBy(session)
        .applyInPandasWithState(charge, f"{session} {kind}, {seq} {seq_kind}, projected double, over_budget boolean", "spent long", "append", GroupStateTimeout.EventTimeTimeout)
    )
