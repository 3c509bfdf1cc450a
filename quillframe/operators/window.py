"""Rolling, expanding, cumulative and exponentially weighted columns, shifts and ranks.

Every function takes the frame, the column, the order keys and optional partition keys, and
gives the frame with a new column. Without partition keys, windows of a bounded reach work on
blocks of rows and running ones on buckets (see :mod:`.order`), so no task gets all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .agg import aggregate
from .order import BUCKET, BUCKET_ROWS, INDEX, indexed, plus, reaching, running, window, with_halo

ROLLING = ("mean", "sum", "std", "var", "min", "max", "count", "median")


def rolling_column(fn: str, column: str, size: int, min_periods: int | None = None) -> Callable:
    """A function from a window to the rolling aggregate over ``size`` rows.

    Below ``min_periods`` values (``size`` if None) it is null, and for std and var below 2.
    """
    if fn not in ROLLING:
        raise ValueError(f"rolling aggregate must be one of {ROLLING}")
    least = size if min_periods is None else min_periods
    if fn in ("std", "var"):
        least = max(least, 2)
    x = F.col(column).cast("double")

    def over(spec) -> Column:
        frame = spec.rowsBetween(-(size - 1), 0)
        values = F.count(column).over(frame)
        got = aggregate(fn, x, ()).over(frame).cast("double")
        if fn == "sum":
            got = F.coalesce(got, F.lit(0.0))
        return F.when(values >= least, got)

    return over


def rolling(df: DataFrame, column: str, fn: str, size: int, order_by: Sequence[str], partition_by: Sequence[str] = (), min_periods: int | None = None, name: str | None = None, block: int = BUCKET_ROWS) -> DataFrame:
    return reaching(df, order_by, {name or f"{column}_rolling_{fn}": rolling_column(fn, column, size, min_periods)}, size - 1, 0, partition_by, block)


def rolling_apply(df: DataFrame, column: str, fn: Callable[[Column], Column], size: int, order_by: Sequence[str], partition_by: Sequence[str] = (), min_periods: int | None = None, name: str | None = None) -> DataFrame:
    """``fn`` from the array of a window's values, without nulls, to a column."""
    least = size if min_periods is None else min_periods

    def over(spec) -> Column:
        frame = spec.rowsBetween(-(size - 1), 0)
        values = F.collect_list(F.col(column).cast("double")).over(frame)
        return F.when(F.size(values) >= least, fn(values))

    return reaching(df, order_by, {name or f"{column}_rolling_apply": over}, size - 1, 0, partition_by)


def group_rolling(df: DataFrame, group: str, column: str, size: int, fn: str, order_by: Sequence[str]) -> DataFrame:
    """``group`` and ``{column}_rolling``: any aggregate over up to ``size`` rows of the group so far."""
    spec = window(order_by, [group]).rowsBetween(-(size - 1), 0)
    x = F.col(column).cast("double")
    if fn in ("first", "last"):
        value = F.first(x, True).over(spec) if fn == "first" else F.last(x, True).over(spec)
    elif fn == "nunique":
        value = F.size(F.collect_set(x).over(spec))
    else:
        value = aggregate(fn, x).over(spec)
    return df.select(group, value.cast("double").alias(f"{column}_rolling"), *[k for k in order_by if k != group])


EXPANDING = ("mean", "sum", "min", "max", "std")


def expanding(df: DataFrame, column: str, fn: str, order_by: Sequence[str], partition_by: Sequence[str] = (), min_periods: int = 1, name: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The aggregate over all rows so far; null below ``min_periods`` values, for std NaN below 2.

    It is made of running counts, sums, sums of squares and extremes, which buckets can pass on.
    """
    if fn not in EXPANDING:
        raise ValueError(f"expanding aggregate must be one of {EXPANDING}")
    x = F.col(column).cast("double")
    parts: dict[str, tuple] = {"__n": (F.count(x), F.sum, plus)}
    if fn in ("mean", "sum"):
        parts["__s"] = (F.sum(x), F.sum, plus)
    if fn == "std":
        parts["__m"] = (F.stddev_pop(x), F.sum, plus)  # only within partitions
    if fn in ("min", "max"):
        parts["__e"] = (F.min(x), F.min, F.least) if fn == "min" else (F.max(x), F.max, F.greatest)
    if fn == "std" and not partition_by:
        return _expanding_std(df, column, order_by, min_periods, name or f"{column}_expanding_std", bucket_rows)
    out = running(df, order_by, parts, partition_by, bucket_rows=bucket_rows)
    n = F.col("__n")
    value = {"mean": lambda: F.col("__s") / F.when(n > 0, n), "sum": lambda: F.coalesce("__s", F.lit(0.0)), "min": lambda: F.col("__e"), "max": lambda: F.col("__e"), "std": lambda: F.when(n >= 2, F.col("__m")).otherwise(float("nan"))}[fn]()
    return out.withColumn(name or f"{column}_expanding_{fn}", F.when(n >= min_periods, value)).drop(*parts)


def _expanding_std(df: DataFrame, column: str, order_by: Sequence[str], min_periods: int, name: str, bucket_rows: int) -> DataFrame:
    x = F.col(column).cast("double")
    # squares are taken around a value of the column, so that they don't drown in a large mean
    middle = df.agg(F.avg(x)).first()[0] or 0.0
    d = x - F.lit(middle)
    out = running(df, order_by, {"__n": (F.count(x), F.sum, plus), "__s": (F.sum(d), F.sum, plus), "__q": (F.sum(d * d), F.sum, plus)}, bucket_rows=bucket_rows)
    n = F.col("__n")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("__q") / n - (F.col("__s") / n) * (F.col("__s") / n)))
    return out.withColumn(name, F.when(n >= min_periods, F.when(n >= 2, spread).otherwise(float("nan")))).drop("__n", "__s", "__q")


def shift(df: DataFrame, column: str, n: int, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """The value ``n`` rows before, or, if negative, behind."""
    make = (lambda spec: F.lag(column, n).over(spec)) if n >= 0 else (lambda spec: F.lead(column, -n).over(spec))
    return reaching(df, order_by, {name or f"{column}_shift": make}, max(n, 0), max(-n, 0), partition_by)


def diff(df: DataFrame, column: str, periods: int, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """The value less the one ``periods`` rows before."""
    x = F.col(column).cast("double")
    back = lambda spec: F.lag(x, periods).over(spec) if periods >= 0 else F.lead(x, -periods).over(spec)
    return reaching(df, order_by, {name or f"{column}_diff": lambda spec: x - back(spec)}, max(periods, 0), max(-periods, 0), partition_by)


def pct_change(df: DataFrame, column: str, periods: int, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """The relative change over ``periods`` rows; null where the earlier value is 0 or null."""
    x = F.col(column).cast("double")
    back = lambda spec: F.lag(x, periods).over(spec) if periods >= 0 else F.lead(x, -periods).over(spec)
    return reaching(df, order_by, {name or f"{column}_pct_change": lambda spec: F.try_divide(x - back(spec), back(spec))}, max(periods, 0), max(-periods, 0), partition_by)


CUMULATIVE = ("sum", "prod", "max", "min")


def cumulative(df: DataFrame, column: str, fn: str, order_by: Sequence[str], partition_by: Sequence[str] = (), name: str | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The running sum, product, maximum or minimum; a null stays null and is passed over."""
    x = F.col(column).cast("double")
    known = {"sum": (F.sum(x), F.sum, plus), "prod": (F.product(x), F.product, lambda a, b: F.coalesce(a * b, a, b)), "max": (F.max(x), F.max, F.greatest), "min": (F.min(x), F.min, F.least)}
    if fn not in known:
        raise ValueError(f"cumulative aggregate must be one of {CUMULATIVE}")
    out = running(df, order_by, {"__cum": known[fn]}, partition_by, bucket_rows=bucket_rows)
    return out.withColumn(name or f"{column}_cum{fn}", F.when(F.col(column).isNotNull(), F.col("__cum"))).drop("__cum")


def ewm_mean(df: DataFrame, column: str, order_by: Sequence[str], alpha: float | None = None, span: int | None = None, partition_by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """The exponentially weighted mean ``e = alpha v + (1 - alpha) e``, which starts anew after a null.

    Rows stream through a pandas function in the order of their partition, which passes on the
    last mean, so a partition may be of any size. Without partition keys blocks of rows are the
    partitions; a block starts from the rows before it whose weight still counts in a double.
    """
    if (alpha is None) == (span is None):
        raise ValueError("either alpha or span is wanted")
    alpha = alpha if alpha is not None else 2.0 / (span + 1)
    name = name or f"{column}_ewm"
    if partition_by:
        return _swept(df, column, list(partition_by), list(order_by), alpha, name)
    reach = 0 if alpha >= 1 else math.ceil(math.log(1e-18) / math.log(1 - alpha))
    halo = with_halo(indexed(df, order_by), reach)
    return _swept(halo, column, [BUCKET], [INDEX], alpha, name).where("not __halo").drop("__halo", BUCKET, INDEX)


def _swept(df: DataFrame, column: str, keys: list[str], order: list[str], alpha: float, name: str) -> DataFrame:
    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, mean = None, math.nan
        for pdf in batches:
            pdf = pdf.reset_index(drop=True)
            if not len(pdf):
                continue
            key = pd.util.hash_pandas_object(pdf[keys], index=False)
            values = pdf[column].astype("float64")
            runs = (values.isna() | (key != key.shift())).cumsum()
            out = values.groupby(runs).ewm(alpha=alpha, adjust=False).mean().droplevel(0).reindex(pdf.index).where(values.notna())
            if key[0] == last_key and mean == mean and values.notna()[0]:  # the first run goes on
                first = int((runs == runs[0]).sum())
                out[:first] += (1 - alpha) ** np.arange(1, first + 1) * (mean - values[0])
            last_key, mean = key.iloc[-1], out.iloc[-1]
            pdf[name] = out
            yield pdf

    dealt = df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(k).asc_nulls_first() for k in order])
    return dealt.mapInPandas(sweep, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


RANKS = ("average", "min", "max", "first", "dense")


def rank(df: DataFrame, column: str, method: str = "average", order_by: Sequence[str] = (), partition_by: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """The rank of each value as a double, from 1, dense ranks from 0; null for null.

    Ranks come from the counts of the distinct values, so that ties and large groups cost a join
    and no window over all rows: the running count of the smaller values is worked out on the
    distinct values in buckets. ``first`` breaks ties by the order keys.
    """
    if method not in RANKS:
        raise ValueError(f"rank method must be one of {RANKS}")
    name = name or f"{column}_rank"
    keys = list(partition_by)
    known = df.where(F.col(column).isNotNull())
    if method == "first":
        if not order_by:
            raise ValueError("rank by first appearance needs order keys")
        if keys:
            ranked = known.withColumn(name, F.row_number().over(window([column, *order_by], keys)).cast("double"))
        else:
            ranked = indexed(known, [column, *order_by], name, 1).withColumn(name, F.col(name).cast("double"))
        return ranked.unionByName(df.where(F.col(column).isNull()).withColumn(name, F.lit(None).cast("double")))
    counts = known.groupBy(*keys, column).agg(F.count("*").alias("__n"))
    sums = running(counts, [column], {"__upto": (F.sum("__n"), F.sum, plus), "__distinct": (F.count("__n"), F.sum, plus)}, keys)
    upto, n = F.col("__upto"), F.col("__n")
    value = {"average": upto - (n - 1) / F.lit(2.0), "min": upto - n + 1, "max": upto, "dense": F.col("__distinct") - 1}[method].cast("double")
    table = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(column).alias("__v"), value.alias(name))
    on = F.col(column) == F.col("__v")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(table, on, "left").drop("__v", *[f"__k_{k}" for k in keys])
