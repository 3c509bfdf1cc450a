"""Projection, row selection, duplicates and small predicates."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import is_in
from .order import indexed, keys_of, window


def _sorted(df: DataFrame, order_by: Sequence[str], descending: bool = False) -> DataFrame:
    return df.orderBy(*[F.col(k).desc_nulls_last() if descending else F.col(k).asc_nulls_first() for k in keys_of(order_by)])


def drop(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def head(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows in order (a top-n, no full sort)."""
    return _sorted(df, order_by).limit(max(n, 0))


def tail(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The last ``n`` rows, in order."""
    return _sorted(_sorted(df, order_by, descending=True).limit(max(n, 0)), order_by)


def slice_rows(df: DataFrame, start: int, stop: int, order_by: Sequence[str]) -> DataFrame:
    """The rows at positions [start, stop), by the position of each row, so that no task gets all before ``stop``."""
    at = F.col("__idx")
    return _sorted(indexed(df, order_by, "__idx").where((at >= max(start, 0)) & (at < stop)), ["__idx"]).drop("__idx")


def take(df: DataFrame, positions: Sequence[int], order_by: Sequence[str], place: str | None = None) -> DataFrame:
    """The rows at the given positions, repeats included, in the order given.

    The positions are a list and so bounded; they are joined by broadcast.
    """
    spark: SparkSession = df.sparkSession
    wanted = spark.createDataFrame([(int(p), i) for i, p in enumerate(positions)], "__at long, __place long")
    found = indexed(df, order_by, "__idx").join(F.broadcast(wanted), F.col("__idx") == F.col("__at")).drop("__idx", "__at").orderBy("__place")
    return found.withColumnRenamed("__place", place) if place else found.drop("__place")


def filter_rows(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


_QUERY = re.compile(r"^\s*(.+?)\s*(>=|<=|!=|==|>|<)\s*(.+?)\s*$", re.S)


def parse_query(df: DataFrame, text: str) -> Column | None:
    """A condition ``column op value``; None if it can't be read or names no column."""
    found = _QUERY.match(text)
    if not found or found[1] not in df.columns:
        return None
    name, op, raw = found[1], found[2], found[3]
    bare = raw[1:-1] if len(raw) >= 2 and raw[0] == raw[-1] and raw[0] in "'\"" else None
    value: Any = bare
    if bare is None:
        try:
            value = float(raw) if not raw.lstrip("+-").isdigit() else int(raw)
        except ValueError:
            value = {"true": True, "false": False}.get(raw.lower(), raw)
    column = F.col(f"`{name}`")
    return {">=": column >= value, "<=": column <= value, "!=": column != value, "==": column == value, ">": column > value, "<": column < value}[op]


def query(df: DataFrame, text: str) -> DataFrame:
    """Rows that fulfil one condition ``column op value``; all rows if it can't be read."""
    condition = parse_query(df, text)
    return df if condition is None else df.where(condition)


def is_in_columns(df: DataFrame, values: Mapping[str, list]) -> DataFrame:
    """Membership for each column; columns without a list are false."""
    return df.select(*[(is_in(F.col(c), values[c]) if c in values else F.lit(False)).alias(c) for c in df.columns])


KEEP = ("first", "last", "none")


def duplicated(df: DataFrame, subset: Sequence[str], keep: str, order_by: Sequence[str], name: str = "duplicated", nulls_are_values: bool = True) -> DataFrame:
    """Add whether a row repeats another in the columns of ``subset``.

    ``keep``: which of a group of equal rows isn't marked. With ``nulls_are_values`` false, as for
    a single column, rows with a null in the subset are never marked. The row that is kept is
    found by an aggregation with partial results, so a frequent value isn't sorted in one task.
    """
    if keep not in KEEP:
        raise ValueError(f"keep must be one of {KEEP}")
    order = F.struct(*[F.col(k) for k in keys_of(order_by)])
    pick = {"first": F.min(order), "last": F.max(order), "none": F.min(order)}[keep]
    groups = df.groupBy(*[F.col(c).alias(f"__g_{c}") for c in subset]).agg(pick.alias("__kept"), F.count("*").alias("__size"))
    on = F.lit(True)
    for c in subset:
        on = on & F.col(c).eqNullSafe(F.col(f"__g_{c}"))
    mark = F.col("__size") > 1
    if keep != "none":
        mark = mark & ~order.eqNullSafe(F.col("__kept"))
    if not nulls_are_values:
        for c in subset:
            mark = mark & F.col(c).isNotNull()
    return df.join(groups, on, "left").withColumn(name, F.coalesce(mark, F.lit(False))).drop("__kept", "__size", *[f"__g_{c}" for c in subset])


def drop_duplicates(df: DataFrame, subset: Sequence[str], keep: str, order_by: Sequence[str], nulls_are_values: bool = True) -> DataFrame:
    return duplicated(df, subset, keep, order_by, "__dup", nulls_are_values).where("not __dup").drop("__dup")


def unique(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """Distinct values but null, by first appearance."""
    order = F.struct(*[F.col(k) for k in keys_of(order_by)])
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias("__first")).orderBy("__first").drop("__first")


def value_counts(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """``column, count`` by first appearance; nulls aren't counted."""
    order = F.struct(*[F.col(k) for k in keys_of(order_by)])
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("count"), F.min(order).alias("__first")).orderBy("__first").drop("__first")


def factorize(df: DataFrame, column: str, order_by: Sequence[str], name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The frame with codes by first appearance (null for null), and the table of codes and values."""
    name = name or f"{column}_code"
    values = indexed(unique_with_first(df, column, order_by), "__first_key", name).select(name, column)
    coded = values.select(F.col(name), F.col(column).alias("__value"))
    return df.join(coded, F.col(column) == F.col("__value"), "left").drop("__value"), values


def unique_with_first(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """Distinct values with the order key of their first row (the first key is enough where it is unique)."""
    keys = keys_of(order_by)
    first = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(F.struct(*keys)).alias("__k"))
    return first.select(column, F.col(f"__k.{keys[0]}").alias("__first_key"))


def sort_by(df: DataFrame, names: Sequence[str], ascending: Sequence[bool] = (), order_by: Sequence[str] = ()) -> DataFrame:
    """Sort with nulls as the smallest values; a missing flag is ascending. ``order_by`` settles ties, for a stable sort."""
    flags = [*ascending, *[True] * (len(names) - len(ascending))]
    keys = [F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, up in zip(names, flags)]
    return df.orderBy(*keys, *[F.col(k).asc_nulls_first() for k in order_by])


def nlargest(df: DataFrame, column: str, n: int) -> DataFrame:
    """The ``n`` largest values but null, as a top-n."""
    return df.select(column).where(F.col(column).isNotNull()).orderBy(F.desc(column)).limit(n)


def nsmallest(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.select(column).where(F.col(column).isNotNull()).orderBy(F.asc(column)).limit(n)


def top_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group, in order."""
    return df.withColumn("__k", F.row_number().over(window(order_by, keys))).where(F.col("__k") <= n).drop("__k")


def row_number(df: DataFrame, order_by: Sequence[str], partition_by: Sequence[str], name: str = "row_number") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition_by).orderBy(*order_by)))
