"""Descriptive statistics. All are those of the population; quantiles interpolate."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import numeric_columns
from .order import keys_of

DESCRIBE = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def _nan(c: Column) -> Column:
    return F.coalesce(c.cast("double"), F.lit(float("nan")))


def describe(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``statistic`` and one column for each numeric column; quantiles as by :func:`quantiles`."""
    names = list(columns) or numeric_columns(df.schema)
    found = quantiles(df, {c: [0.25, 0.5, 0.75] for c in names})
    aggs = []
    for c in names:
        x = F.col(c).cast("double")
        q = [F.lit(v) for v in found[c]]
        parts = [F.count(x).cast("double"), _nan(F.avg(x)), _nan(F.stddev_pop(x)), _nan(F.min(x)), *q, _nan(F.max(x))]
        aggs.append(F.array(*parts).alias(c))
    row = df.agg(*aggs)
    zipped = row.select(F.posexplode(F.arrays_zip(F.array(*map(F.lit, DESCRIBE)).alias("statistic"), *names)).alias("pos", "r"))
    return zipped.orderBy("pos").select("r.statistic", *[f"r.{c}" for c in names])


#: Relative accuracy of the sketches that narrow a quantile down, and values of which one task takes its pick.
ACCURACY, PICKED = 2000, 1 << 16


def quantiles(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float]]:
    """The exact interpolated quantiles of each column; NaN without values.

    A sketch of bounded size gives values below and above each wanted rank, between which a share
    of about 2 / ``ACCURACY`` of all values lies; this is repeated within them until so few are
    left that one task can pick. So no task ever holds all distinct values.
    """
    if not wanted:
        return {}
    x = {c: F.col(c).cast("double") for c in wanted}
    sizes = df.agg(*[F.count(v).alias(c) for c, v in x.items()]).first()
    targets: list[tuple[str, int]] = []  # column and rank
    for c, ps in wanted.items():
        for p in ps:
            rank = p * (sizes[c] - 1)
            targets += [(c, k) for k in {math.floor(rank), math.ceil(rank)} if sizes[c] and (c, k) not in targets]
    bound: dict[tuple[str, int], tuple[float | None, float | None, int, int]] = {t: (None, None, 0, sizes[t[0]]) for t in targets}  # above low, up to high; values below, values within
    value: dict[tuple[str, int], float] = {}

    def within(t: tuple[str, int]) -> Column:
        low, high, _, _ = bound[t]
        inside = x[t[0]].isNotNull()
        if low is not None:
            inside = inside & (x[t[0]] > F.lit(low))
        return inside & (x[t[0]] <= F.lit(high)) if high is not None else inside

    while open_ := [t for t in targets if t not in value]:
        few = [t for t in open_ if bound[t][3] <= PICKED]
        many = [t for t in open_ if bound[t][3] > PICKED]
        ranges = list(dict.fromkeys((t[0], bound[t]) for t in few))  # several ranks may lie in one
        asked = [F.sort_array(F.collect_list(F.when(within(next(t for t in few if (t[0], bound[t]) == r)), x[r[0]]))) for r in ranges]
        for t in many:
            middle, size = (t[1] - bound[t][2] + 0.5) / bound[t][3], 1.0 / ACCURACY
            asked.append(F.percentile_approx(F.when(within(t), x[t[0]]), [max(0.0, middle - 2 * size), min(1.0, middle + 2 * size)], 2 * ACCURACY))
        got = list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(asked)]).first())
        for t in few:
            value[t] = got[ranges.index((t[0], bound[t]))][t[1] - bound[t][2]]
        if not many:
            break
        counts = []
        for t, (low, high) in zip(many, got[len(ranges) :]):
            inside = within(t)
            counts += [F.count(F.when(inside & (x[t[0]] <= F.lit(low)), 1)), F.count(F.when(inside & (x[t[0]] <= F.lit(high)), 1)), F.count(F.when(inside & (x[t[0]] == F.lit(low)), 1))]
        seen = list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(counts)]).first())
        for i, (t, (low, high)) in enumerate(zip(many, got[len(ranges) :])):
            upto_low, upto_high, at_low = seen[3 * i : 3 * i + 3]
            above, top, below, size = bound[t]
            rank = t[1] - below
            if upto_low - at_low <= rank < upto_low:
                value[t] = low
            elif rank >= upto_high:
                bound[t] = (high, top, below + upto_high, size - upto_high)
            elif rank < upto_low:
                bound[t] = (above, low, below, upto_low)
            else:
                bound[t] = (low, high, below + upto_low, upto_high - upto_low)
                if upto_high - upto_low == size:  # nothing but copies of the upper value is left
                    value[t] = high
    out = {}
    for c, ps in wanted.items():
        out[c] = []
        for p in ps:
            rank = p * (sizes[c] - 1)
            if not sizes[c]:
                out[c].append(float("nan"))
                continue
            low, high, part = value[c, math.floor(rank)], value[c, math.ceil(rank)], rank - math.floor(rank)
            out[c].append(low if low == high else low * (1 - part) + high * part)
    return out


def quantile(df: DataFrame, column: str, p: float) -> float:
    """The exact quantile; NaN without values."""
    return quantiles(df, {column: [p]})[column][0]


def skew_of(column: Column) -> Column:
    """Skewness as an aggregate; NaN below 3 values or without spread."""
    x = column.cast("double")
    return F.when((F.count(x) >= 3) & (F.stddev_pop(x) > 0), F.skewness(x)).otherwise(float("nan"))


def kurt_of(column: Column) -> Column:
    """Excess kurtosis as an aggregate; NaN below 4 values or without spread."""
    x = column.cast("double")
    return F.when((F.count(x) >= 4) & (F.stddev_pop(x) > 0), F.kurtosis(x)).otherwise(float("nan"))


def cov_of(a: Column, b: Column) -> Column:
    """Covariance over the rows that have both; NaN below 2."""
    x, y = a.cast("double"), b.cast("double")
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    return F.when(both >= 2, F.covar_pop(x, y)).otherwise(float("nan"))


def corr_of(a: Column, b: Column) -> Column:
    """Pearson's correlation: the covariance of the pairs by the deviations of each column; NaN without spread."""
    x, y = a.cast("double"), b.cast("double")
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 0, cov_of(a, b) / F.when(spread > 0, spread)).otherwise(float("nan"))


def corr_matrix(df: DataFrame, columns: Sequence[str] = ()) -> DataFrame:
    """``column`` and one column for each numeric one, from one aggregation."""
    names = list(columns) or numeric_columns(df.schema)
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    row = df.agg(*[(F.lit(1.0) if i == j else corr_of(F.col(names[i]), F.col(names[j]))).alias(f"{i}_{j}") for i, j in pairs if True] or [F.lit(0).alias("none")])
    at = lambda i, j: F.col(f"{min(i, j)}_{max(i, j)}")
    rows = F.array(*[F.struct(F.lit(n).alias("column"), *[at(i, j).alias(m) for j, m in enumerate(names)]) for i, n in enumerate(names)])
    return row.select(F.explode(rows).alias("r")).select("r.*")


def mode(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """All most frequent values but null, by first appearance."""
    order = F.struct(*[F.col(k) for k in keys_of(order_by)])
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"), F.min(order).alias("__first"))
    most = counts.agg(F.max("__n").alias("__most"))  # one row
    return counts.join(F.broadcast(most), F.col("__n") == F.col("__most")).orderBy("__first").select(column)


def info(df: DataFrame) -> DataFrame:
    """``column, dtype, non_null`` for each column, from one aggregation."""
    row = df.agg(*[F.count(c).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f.name).alias("non_null")) for f in df.schema.fields])
    return row.select(F.explode(rows).alias("r")).select("r.*")


#: Bytes of a value; what isn't named counts 32.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "string": 32}


def memory_usage(df: DataFrame) -> dict[str, int]:
    """Estimated bytes of each column: its width times the rows, and a bit a row where it has nulls."""
    row = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(c).alias(c) for c in df.columns]).first()
    rows = row["__rows"]
    return {f.name: rows * WIDTHS.get(f.dataType.simpleString(), 32) + (-(-rows // 8) if row[f.name] < rows else 0) for f in df.schema.fields}
