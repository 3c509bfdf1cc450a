"""The aggregate registry and grouped aggregation.

Aggregates skip nulls and give doubles named ``{column}_{function}``; standard deviation and
variance are those of the population, median and quantiles interpolate. Grouped medians come
from the counts of the values, sorted within their group, and from no reducer's map of them. A group without values
gives NaN for every function. Order, minimum, maximum and distinct counts of columns that are no
numbers are native and not their value as a number.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stats import quantiles

AGGREGATES = ("sum", "mean", "median", "min", "max", "count", "std", "var", "first", "last", "nunique")
_NUMERIC_ONLY = frozenset(("sum", "mean", "median", "std", "var"))


def order_key(order_by: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in order_by])


def aggregate(fn: str, column: Column, order_by: Sequence[str] = ()) -> Column:
    """The bare aggregate of a column, null without values."""
    if fn in ("first", "last"):
        if not order_by:
            return F.first(column, ignorenulls=True) if fn == "first" else F.last(column, ignorenulls=True)
        key = F.when(column.isNotNull(), order_key(order_by))
        return F.min_by(column, key) if fn == "first" else F.max_by(column, key)
    known: dict[str, Callable[[Column], Column]] = {
        "sum": F.sum,
        "mean": F.avg,
        "median": lambda c: F.percentile(c, F.lit(0.5)),
        "min": F.min,
        "max": F.max,
        "count": F.count,
        "std": F.stddev_pop,
        "var": F.var_pop,
        "nunique": F.count_distinct,
    }
    try:
        return known[fn](column)
    except KeyError:
        raise ValueError(f"unknown aggregate {fn!r}; known: {', '.join(AGGREGATES)}") from None


def result(fn: str, name: str, kind: T.DataType, order_by: Sequence[str] = ()) -> Column:
    """The aggregate as the groups show it: a double, NaN without values; for columns that are no numbers their own type."""
    column = F.col(name)
    numeric = isinstance(kind, (T.NumericType, T.BooleanType))
    if not numeric:
        if fn in _NUMERIC_ONLY:
            raise TypeError(f"{fn} needs numbers; {name} is {kind.simpleString()}")
        if fn not in ("count", "nunique"):
            return aggregate(fn, column, order_by)
    else:
        column = column.cast("double") if not isinstance(kind, T.BooleanType) else column.cast("int").cast("double")
    value = aggregate(fn, column, order_by)
    if fn in ("count", "nunique"):
        value = F.when(value > 0, value)
    return F.coalesce(value.cast("double"), F.lit(float("nan")))


def pairs(aggs: Mapping[str, str | Sequence[str]] | Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """(column, function) pairs of a mapping, whose values may be several functions, or of a list."""
    if isinstance(aggs, Mapping):
        return [(c, f) for c, fs in aggs.items() for f in ([fs] if isinstance(fs, str) else fs)]
    return list(aggs)


def agg(df: DataFrame, keys: Sequence[str], aggs, order_by: Sequence[str] = ()) -> DataFrame:
    """Group by the keys (nulls are a key) and aggregate; one group of all rows without keys."""
    wanted = pairs(aggs)
    medians = list(dict.fromkeys(c for c, f in wanted if f == "median" and isinstance(df.schema[c].dataType, T.NumericType)))
    columns = [result(f, c, df.schema[c].dataType, order_by).alias(f"{c}_{f}") for c, f in wanted if not (f == "median" and c in medians)]
    out = df.groupBy(*keys).agg(*columns or [F.count(F.lit(1)).alias("__rows")])
    for c in medians:
        if not keys:
            out = out.withColumn(f"{c}_median", F.lit(quantiles(df, {c: [0.5]})[c][0]))
            continue
        found = group_quantiles(df, keys, c, [0.5]).select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("q")[0].alias("__median"))
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        out = out.join(found, on, "left").withColumn(f"{c}_median", F.coalesce("__median", F.lit(float("nan")))).drop("__median", *[f"__k_{k}" for k in keys])
    return out.select(*keys, *[f"{c}_{f}" for c, f in wanted])


def group_quantiles(df: DataFrame, keys: Sequence[str], column: str, at: Sequence[float]) -> DataFrame:
    """The keys and ``q``, the exact interpolated quantiles of each group that has values.

    Equal values are counted first; a running count in the order of the values, which spills as
    any sort, then finds the ranks around each quantile.
    """
    x = F.col(column).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*keys, x.alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy(*keys).orderBy("__v")
    n = F.sum("__n")
    ranked = counts.select(*keys, "__v", n.over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("__upto"), n.over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    parts = []
    for i, p in enumerate(at):
        rank = F.lit(float(p)) * (F.col("__all") - 1)
        parts += [F.min(F.when(F.col("__upto") > F.floor(rank), F.col("__v"))).alias(f"__l{i}"), F.min(F.when(F.col("__upto") > F.ceil(rank), F.col("__v"))).alias(f"__h{i}"), F.first(rank - F.floor(rank)).alias(f"__f{i}")]
    found = ranked.groupBy(*keys).agg(*parts)
    between = [F.when(F.col(f"__l{i}") == F.col(f"__h{i}"), F.col(f"__l{i}")).otherwise(F.col(f"__l{i}") * (1 - F.col(f"__f{i}")) + F.col(f"__h{i}") * F.col(f"__f{i}")) for i in range(len(at))]
    return found.select(*keys, F.array(*between).alias("q"))


def groups(df: DataFrame, keys: Sequence[str], index: str) -> DataFrame:
    """Each group's row positions, in order. A group is one row, so this is for groups of a bounded size."""
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(index)).alias("rows"))


def transform(df: DataFrame, keys: Sequence[str], target: str, fn: Callable | Column, order_by: Sequence[str] = (), aggregates: Mapping[str, Column] | None = None) -> DataFrame:
    """Add ``{target}_transformed``.

    ``fn`` is one of three: a column over the names of ``aggregates`` and the row's own, such as
    ``F.col("x") - F.col("mean")`` with ``{"mean": F.avg("x")}``, for which each group is
    aggregated in parts and joined back; a function from a window specification to a column, for
    what depends on the order in the group; or one from a numpy vector to a vector (marked by
    :func:`vector`), which runs in pandas on whole groups, so these must fit a task; nulls count
    as 0 there.
    """
    name = f"{target}_transformed"
    if isinstance(fn, Column):
        table = df.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(*[a.alias(n) for n, a in (aggregates or {}).items()])
        on = F.lit(True)
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        return df.join(table, on, "left").withColumn(name, fn).drop(*[f"__k_{k}" for k in keys], *(aggregates or {}))
    if not getattr(fn, "vector", False):
        return df.withColumn(name, fn(Window.partitionBy(*keys)))
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(pdf):
        if order_by:
            pdf = pdf.sort_values(list(order_by), kind="stable")
        return pdf.assign(**{name: fn(pdf[target].fillna(0).to_numpy(float))})

    return df.groupBy(*keys).applyInPandas(run, schema)


def vector(fn: Callable) -> Callable:
    """Mark a function of a whole group's vector for :func:`transform`."""
    fn.vector = True
    return fn


def filter_groups(df: DataFrame, keys: Sequence[str], predicate: Column | Callable) -> DataFrame:
    """The rows of the groups that satisfy the predicate.

    A column is an aggregate condition, such as ``F.avg("x") > 85``: the groups that fulfil it are
    worked out with partial sums and joined back, so a large group isn't brought together. A
    function gets each group as a pandas frame.
    """
    if isinstance(predicate, Column):
        chosen = df.groupBy(*keys).agg(predicate.alias("__keep")).where("__keep").drop("__keep")
        renamed = chosen.select(*[F.col(k).alias(f"__{k}") for k in keys])
        on = [df[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
        return df.join(renamed, on, "left_semi")

    def run(pdf):
        return pdf if predicate(pdf) else pdf.iloc[:0]

    return df.groupBy(*keys).applyInPandas(run, df.schema)


def apply_groups(df: DataFrame, keys: Sequence[str], fn: Callable, schema) -> DataFrame:
    """``fn`` from each group's pandas frame to a frame of ``schema``."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
