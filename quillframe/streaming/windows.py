"""Event-time windows. The same functions serve a stream and a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(df: DataFrame, time: str, period: str, aggs: Sequence[Column], every: str | None = None, by: Sequence[str] = (), late: str | None = None) -> DataFrame:
    """Aggregates of the windows (``start``, ``end``) of a period, every so often; ``late``: how long late rows are waited for."""
    source = df.withWatermark(time, late) if late else df
    out = source.groupBy(F.window(time, period, every or period), *by).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def session_counts(df: DataFrame, time: str, gap: str, by: Sequence[str], aggs: Sequence[Column], late: str | None = None) -> DataFrame:
    """Aggregates of sessions: rows of a key that follow each other within the gap."""
    source = df.withWatermark(time, late) if late else df
    out = source.groupBy(F.session_window(time, gap), *by).agg(*aggs)
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in out.columns if c != "session_window"])


def deduplicated(stream: DataFrame, keys: Sequence[str], time: str, late: str) -> DataFrame:
    """Each key once, its state kept as long as late rows are waited for."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
