"""Dropping and filling nulls. NaN is a value and stays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import fill
from .order import indexed, running


def drop_na(df: DataFrame) -> DataFrame:
    """Rows without a null."""
    return df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in df.columns])) if df.columns else df


def fill_na(df: DataFrame, value: Any) -> DataFrame:
    """Nulls become ``value`` where the column's type can hold it, and stay null elsewhere."""
    return df.select(*[fill(F.col(f.name), value, f.dataType).alias(f.name) if _fits(value, f.dataType) else F.col(f.name) for f in df.schema.fields])


def _fits(value: Any, kind: T.DataType) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, (T.BooleanType, T.StringType))
    if isinstance(value, (int, float)):
        return isinstance(kind, (T.NumericType, T.StringType))
    return isinstance(kind, (T.StringType, T.NumericType, T.BooleanType, T.TimestampType, T.TimestampNTZType, T.DateType))


#: How buckets pass on the nearest value, and how it joins one of their own.
_NEAREST = (lambda c: F.last(c, ignorenulls=True), lambda past, own: F.coalesce(own, past))


def fill_forward(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Nulls become the last value before them."""
    new = {f"__f{i}": (_edge(c, order_by, last=True), *_NEAREST, F.last(c, ignorenulls=True)) for i, c in enumerate(columns)}
    return _replaced(running(df, order_by, new, partition_by), columns, "__f")


def fill_backward(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Nulls become the next value after them."""
    new = {f"__f{i}": (_edge(c, order_by, last=False), *_NEAREST, F.last(c, ignorenulls=True)) for i, c in enumerate(columns)}
    return _replaced(running(df, order_by, new, partition_by, backwards=True), columns, "__f")


def _edge(column: str, order_by: Sequence[str], last: bool):
    """The last or first value by the order keys, as an aggregate of rows in no order."""
    key = F.when(F.col(column).isNotNull(), F.struct(*order_by))
    return F.max_by(column, key) if last else F.min_by(column, key)


def _replaced(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
    names = {c: f"{prefix}{i}" for i, c in enumerate(columns)}
    return df.select(*[F.coalesce(F.col(c), F.col(names[c])).alias(c) if c in names else F.col(c) for c in df.columns if c not in names.values()])


def interpolate(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Nulls of numeric columns become linear in their position between the values around them.

    Before the first and after the last value the nearest one is taken; columns that are no
    numbers are filled forward.
    """
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    other = [c for c in columns if c not in numeric]
    if partition_by:
        from .order import window

        at = df.withColumn("__pos", F.row_number().over(window(order_by, partition_by)).cast("long"))
    else:
        at = indexed(df, order_by, "__pos")
    made = {}
    for i, c in enumerate(numeric):
        at = at.withColumn(f"__p{i}", F.when(F.col(c).isNotNull(), F.struct(F.col("__pos").alias("at"), F.col(c).cast("double").alias("v"))))
        made[i] = c
    marks = [f"__p{i}" for i in made]
    back = {f"__a{i}": (F.max_by(m, F.when(F.col(m).isNotNull(), F.col("__pos"))), *_NEAREST, F.last(m, ignorenulls=True)) for i, m in zip(made, marks)}
    ahead = {f"__b{i}": (F.min_by(m, F.when(F.col(m).isNotNull(), F.col("__pos"))), *_NEAREST, F.last(m, ignorenulls=True)) for i, m in zip(made, marks)}
    out = at
    if made:
        out = running(running(out, ["__pos"], back, partition_by), ["__pos"], ahead, partition_by, backwards=True)
    cols = []
    for c in df.columns:
        if c in numeric:
            i = numeric.index(c)
            a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
            part = (F.col("__pos") - a["at"]) / F.when(b["at"] != a["at"], (b["at"] - a["at"]).cast("double"))
            line = a["v"] + (b["v"] - a["v"]) * part
            cols.append(F.coalesce(F.col(c).cast("double"), line, a["v"], b["v"]).alias(c))
        else:
            cols.append(F.col(c))
    out = out.select(*cols)
    return fill_forward(out, other, order_by, partition_by) if other else out


def fill_method(df: DataFrame, method: str, order_by: Sequence[str], partition_by: Sequence[str] = ()) -> DataFrame:
    """Fill all columns but the order and partition keys by ffill, bfill or interpolate; others leave the frame as it is."""
    columns = [c for c in df.columns if c not in (*order_by, *partition_by)]
    known = {"ffill": fill_forward, "bfill": fill_backward, "interpolate": interpolate}
    return known[method](df, columns, order_by, partition_by) if method in known else df
