"""Element-wise arithmetic, comparison and logic, as functions from columns to columns.

Arithmetic is in doubles and passes nulls on; dividing by zero gives NaN. Logic is null where
either side is, unlike SQL's.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import to_spark


def nan() -> Column:
    return F.lit(float("nan"))


def value(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def num(x: Any) -> Column:
    return value(x).cast("double")


def add(a: Any, b: Any) -> Column:
    return num(a) + num(b)


def sub(a: Any, b: Any) -> Column:
    return num(a) - num(b)


def mul(a: Any, b: Any) -> Column:
    return num(a) * num(b)


def div(a: Any, b: Any) -> Column:
    return F.when(num(b) == 0, F.when(num(a).isNotNull(), nan())).otherwise(num(a) / num(b))


def mod(a: Any, b: Any) -> Column:
    """The remainder with the sign of ``a``."""
    return F.when(num(b) == 0, F.when(num(a).isNotNull(), nan())).otherwise(num(a) % num(b))


def neg(a: Any) -> Column:
    return -num(a)


def absolute(a: Any) -> Column:
    return F.abs(num(a))


def clip(a: Any, low: float, high: float) -> Column:
    """Values below ``low`` become it, those above ``high`` become it; null stays null."""
    x = num(a)
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))


def eq(a: Any, b: Any) -> Column:
    return value(a) == value(b)


def ne(a: Any, b: Any) -> Column:
    return value(a) != value(b)


def lt(a: Any, b: Any) -> Column:
    return value(a) < value(b)


def le(a: Any, b: Any) -> Column:
    return value(a) <= value(b)


def gt(a: Any, b: Any) -> Column:
    return value(a) > value(b)


def ge(a: Any, b: Any) -> Column:
    return value(a) >= value(b)


def both(a: Any, b: Any) -> Column:
    a, b = value(a), value(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a & b)


def either(a: Any, b: Any) -> Column:
    a, b = value(a), value(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("boolean")).otherwise(a | b)


def negate(a: Any) -> Column:
    return ~value(a)


def as_type(a: Column, kind: str) -> Column:
    """Cast to bool, int64, float64 or string; a text that can't be read becomes False or 0, null stays null."""
    if kind not in ("bool", "int64", "float64", "string"):
        return a
    if kind == "string":
        return a.cast("string")
    if kind == "int64":
        # through double, as integers are cut off and not rounded
        read = F.coalesce(a.try_cast("bigint"), a.try_cast("double").try_cast("bigint"))
    else:
        read = a.try_cast(to_spark(kind))
    zero = F.lit(False) if kind == "bool" else F.lit(0)
    return F.when(a.isNotNull(), F.coalesce(read, zero.cast(to_spark(kind))))


def to_numeric(a: Column) -> Column:
    """Text as double; null where it can't be read."""
    return a.try_cast("double")


def where(a: Column, condition: Column, other: Any) -> Column:
    """``a`` where the condition is true, else ``other``; a null condition counts as false."""
    return F.when(condition, a).otherwise(value(other))


def mask(a: Column, condition: Column, other: Any) -> Column:
    """``other`` where the condition is true, else ``a``."""
    return F.when(condition, value(other)).otherwise(a)


def is_in(a: Column, values: list) -> Column:
    """Membership; null where ``a`` is null."""
    known = [v for v in values if v is not None]
    return F.when(a.isNotNull(), a.isin(known) if known else F.lit(False))


def fill(a: Column, replacement: Any, kind: Any) -> Column:
    """Nulls (not NaN) become ``replacement`` if the column's type can hold it."""
    return F.coalesce(a, F.lit(replacement).try_cast(kind))
