"""Grouping by time: windows, resampling, trailing windows, regular grids."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.temporal import ORIGIN_DAYS, from_micros, micros
from ..functions.types import numeric_columns
from .agg import agg, aggregate, order_key, result

_DAY = 86_400 * 10**6


def window_start(ts: Column, every: int, right_closed: bool = False) -> Column:
    """The start of the window of a length (nanoseconds) that an instant lies in, counted from the first day of year 1."""
    us = every // 1_000
    shifted = micros(ts) - (1 if right_closed else 0)
    return from_micros(shifted - F.pmod(shifted + F.lit(ORIGIN_DAYS * _DAY), F.lit(us)))


@dataclass(frozen=True)
class Dynamic:
    """Groups of rows by windows of a ``period`` that start ``every`` so often (nanoseconds).

    A row counts in the latest window that starts up to it, and in none if the period is over
    by then; ``overlapping`` counts it in every window it lies in.
    """

    df: DataFrame
    time: str
    period: int
    every: int = 0
    closed_side: str = "left"
    label_side: str = "left"
    keys: tuple[str, ...] = field(default=())
    overlapping: bool = False

    def closed(self, side: str) -> Dynamic:
        return replace(self, closed_side=side)

    def label(self, side: str) -> Dynamic:
        return replace(self, label_side=side)

    def by(self, *columns: str) -> Dynamic:
        return replace(self, keys=columns)

    def agg(self, aggs, order_by: Sequence[str] = ()) -> DataFrame:
        """``{time}``, the keys and ``{column}_{function}`` for each window with rows; null times are left out."""
        every = self.every or self.period
        right = self.closed_side == "right"
        start = window_start(F.col(self.time), every, right)
        rows = self.df.where(F.col(self.time).isNotNull()).withColumn("__start", start)
        if self.overlapping and self.period > every:
            n = -(-self.period // every)
            rows = rows.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in range(n)]))).withColumn("__start", from_micros(micros(F.col("__start")) - F.col("__k") * (every // 1_000)))
        since = micros(F.col(self.time)) - micros(F.col("__start"))
        rows = rows.where((since <= self.period // 1_000) if right else (since < self.period // 1_000))
        shown = F.col("__start") if self.label_side == "left" else from_micros(micros(F.col("__start")) + self.period // 1_000)
        out = agg(rows.withColumn("__window", shown), ["__window", *self.keys], aggs, order_by or (self.time,))
        return out.withColumnRenamed("__window", self.time) if self.time not in out.columns else out

    def info(self) -> str:
        return f"Dynamic(time={self.time}, period={self.period}ns, every={self.every or self.period}ns, closed={self.closed_side}, label={self.label_side}, by={list(self.keys)})"


def group_by_dynamic(df: DataFrame, time: str, period: int, every: int = 0) -> Dynamic:
    return Dynamic(df, time, period, every)


RESAMPLE = ("sum", "mean", "min", "max", "first", "last", "count")


@dataclass(frozen=True)
class ResampleRule:
    """How to resample: every so often (nanoseconds), by which function, and which ends belong to and name a window."""

    every: int
    fn: str = "mean"
    closed: str = "left"
    label: str = "left"

    def apply(self, df: DataFrame, time: str, order_by: Sequence[str] = ()) -> DataFrame:
        return resample(df, time, self.every, self.fn, order_by, self.closed, self.label)


def resample(df: DataFrame, time: str, every: int, fn: str, order_by: Sequence[str] = (), closed: str = "left", label: str = "left") -> DataFrame:
    """One row for each window with rows: numeric columns by the function (0 without values), others by their first value."""
    if fn not in RESAMPLE:
        raise ValueError(f"resample function must be one of {RESAMPLE}")
    order = tuple(order_by) or (time,)
    start = window_start(F.col(time), every, closed == "right")
    shown = start if label == "left" else from_micros(micros(start) + every // 1_000)
    numeric = [c for c in numeric_columns(df.schema) if c != time]
    others = [c for c in df.columns if c not in numeric and c != time]
    cells = [F.coalesce(aggregate(fn, F.col(c).cast("double"), order).cast("double"), F.lit(0.0)).alias(c) for c in numeric]
    cells += [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order_key(order))).alias(c) for c in others]
    out = df.where(F.col(time).isNotNull()).withColumn("__window", shown).groupBy("__window").agg(*cells)
    return out.select(F.col("__window").alias(time), *[c for c in df.columns if c != time])


def rolling_time(df: DataFrame, time: str, period: int, by: Sequence[str], column: str, fn: str, name: str = "rolling_result") -> DataFrame:
    """Add the aggregate over the rows of the group whose time lies in [t - period, t]; rows of the same time count."""
    # a range frame needs whole numbers: microseconds
    spec = Window.partitionBy(*by).orderBy("__us").rangeBetween(-(period // 1_000), 0)
    x = F.col(column).cast("double")
    if fn == "nunique":
        value: Column = F.size(F.collect_set(x).over(spec))
    elif fn in ("first", "last"):
        value = (F.first if fn == "first" else F.last)(x, True).over(spec)
    else:
        value = aggregate(fn, x).over(spec)
    return df.withColumn("__us", micros(F.col(time))).withColumn(name, value.cast("double")).drop("__us")


def date_range(spark: SparkSession, start: dt.datetime, periods: int, freq: int, name: str = "ts") -> DataFrame:
    """``periods`` times from ``start``, ``freq`` nanoseconds apart."""
    first = int((start.replace(tzinfo=None) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1))
    return spark.range(periods).select(from_micros(F.lit(first) + F.col("id") * (freq // 1_000)).alias(name))


def date_range_end(spark: SparkSession, start: dt.datetime, end: dt.datetime, freq: int, name: str = "ts") -> DataFrame:
    """The times from ``start`` up to ``end``, both included, ``freq`` nanoseconds apart."""
    span = int((end - start) / dt.timedelta(microseconds=1))
    return date_range(spark, start, span // (freq // 1_000) + 1 if span >= 0 else 0, freq, name)


def as_freq(df: DataFrame, column: str, freq: int, fill: float = float("nan")) -> DataFrame:
    """A regular grid from the smallest to the largest value of a number column; what isn't there is ``fill``, or null for NaN."""
    ends = df.agg(F.min(column).cast("long").alias("low"), F.max(column).cast("long").alias("high")).first()
    kind = T.DoubleType()
    if ends["low"] is None:
        return df.select(F.col(column).cast("long").alias("at"), F.col(column).cast(kind).alias(column)).limit(0)
    grid = df.sparkSession.range(ends["low"], ends["high"] + 1, freq).withColumnRenamed("id", "at")
    own = df.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("__v")).distinct()
    other = F.lit(None).cast(kind) if fill != fill else F.lit(float(fill))
    return grid.join(own, F.col("at") == F.col("__v"), "left").select("at", F.when(F.col("__v").isNotNull(), F.col("__v").cast(kind)).otherwise(other).alias(column))


def bucket_result(df: DataFrame, key: Column, name: str, column: str, fn: str, order_by: Sequence[str] = ()) -> DataFrame:
    """One aggregate by any key expression."""
    return df.groupBy(key.alias(name)).agg(result(fn, column, df.schema[column].dataType, order_by).alias(f"{column}_{fn}"))
