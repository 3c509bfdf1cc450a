"""Joins. Null keys match each other; a right column whose name is taken gets ``_right``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import BUCKET, BUCKET_ROWS, bucketed

HOW = ("inner", "left", "right", "outer", "cross")


def _names(taken: Sequence[str], names: Sequence[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    used = set(taken)
    for n in names:
        new = n
        while new in used:
            new += "_right"
        used.add(new)
        out[n] = new
    return out


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _sided(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, Column]:
    """The right side with its keys renamed, and the condition."""
    keys = {k: f"__r_{k}" for k in on}
    side = right.withColumnsRenamed(keys)
    return side, _all([left[k].eqNullSafe(side[keys[k]]) for k in on])


def merge_on(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of the same names: the keys, the rest of the left, the rest of the right."""
    if how == "cross":
        return cross(left, right)
    if how not in HOW:
        raise ValueError(f"how must be one of {HOW}")
    side, condition = _sided(left, right, on)
    rest = [c for c in right.columns if c not in on]
    names = _names(left.columns, rest)
    joined = left.join(side, condition, {"outer": "full"}.get(how, how))
    key = {"inner": lambda k: left[k], "left": lambda k: left[k], "right": lambda k: side[f"__r_{k}"], "outer": lambda k: F.coalesce(left[k], side[f"__r_{k}"])}[how]
    return joined.select(*[key(k).alias(k) for k in on], *[left[c] for c in left.columns if c not in on], *[side[c].alias(names[c]) for c in rest])


def semi(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows with a match, each once."""
    side, condition = _sided(left, right.select(*on), on)
    return left.join(side, condition, "left_semi")


def anti(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left rows without a match."""
    side, condition = _sided(left, right.select(*on), on)
    return left.join(side, condition, "left_anti")


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every left row with every right row."""
    names = _names(left.columns, right.columns)
    return left.crossJoin(right.withColumnsRenamed({k: v for k, v in names.items() if k != v}))


def join_index(left: DataFrame, right: DataFrame, index: str, how: str = "inner", order_by: Sequence[str] = ()) -> DataFrame:
    """Join on an index column compared as text, with one right row at most for each left row: the last in order.

    ``how``: inner or left, and right or outer as a matter of course.
    """
    last = F.max_by(F.struct(*[c for c in right.columns if c != index]), F.struct(*order_by) if order_by else F.struct(*[c for c in right.columns if c != index]))
    unique = right.groupBy(F.col(index).cast("string").alias(index)).agg(last.alias("__row")).select(index, "__row.*")
    return merge_on(left.withColumn(index, F.col(index).cast("string")), unique, [index], how)


def asof(left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each left row with the latest right row whose ``on`` isn't later, among rows with equal ``by``.

    All left rows stay; without a match, and for a null ``on``, the right columns are null. The
    right ``on`` is dropped. Of right rows with equal ``on`` and ``by`` the greatest in its other
    columns counts.

    Both sides are stacked and swept in order, so nothing grows beyond their sum. Time is cut into
    buckets, as a group may be large; a group's last right row of each bucket is handed to those
    of its later buckets that hold rows.
    """
    rest = [c for c in right.columns if c != on and c not in by]
    names = _names(left.columns, rest)
    row = F.struct(*[F.col(c).alias(names[c]) for c in rest])
    l = left.select(*[F.col(c) for c in left.columns], F.lit(1).alias("__side"), F.lit(None).cast(right.select(row.alias("r")).schema["r"].dataType).alias("__row"))
    r = right.where(F.col(on).isNotNull()).select(*[(F.col(c).cast(left.schema[c].dataType) if c == on or c in by else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in left.columns], F.lit(0).alias("__side"), row.alias("__row"))
    both = bucketed(l.unionByName(r), [on], bucket_rows)
    group = [*by, BUCKET]
    spec = Window.partitionBy(*group).orderBy(F.col(on).asc_nulls_first(), "__side", F.col("__row").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("__found", F.last("__row", ignorenulls=True).over(spec)).where("__side = 1")
    # one row for each group and bucket that hold rows; a group has as many as there are buckets at most
    last = both.groupBy(*group).agg(F.max_by("__row", F.when(F.col("__side") == 0, F.struct(on, "__row"))).alias("__last"))
    earlier = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    handed = last.select(*[F.col(k).alias(f"__b_{k}") for k in group], F.last("__last", ignorenulls=True).over(earlier).alias("__last"))
    swept = swept.join(handed, _all([F.col(k).eqNullSafe(F.col(f"__b_{k}")) for k in group]), "left")
    found = F.when(F.col(on).isNotNull(), F.coalesce("__found", "__last"))
    return swept.select(*left.columns, *[found[names[c]].alias(names[c]) for c in rest])
