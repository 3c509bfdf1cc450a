"""Expressions: a name and a column, with the element-wise rules of :mod:`quillframe.functions`."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions import strings as S
from ..operators import agg as A


class Expr:
    """An expression over the columns of a frame.

    ``build`` makes the Spark column from the order keys of the frame that it meets; ``name`` is
    its default name there.
    """

    def __init__(self, build: Callable[[tuple[str, ...]], Column], name: str, is_aggregate: bool = False, text: str | None = None):
        self._build, self.name, self.is_aggregate, self.text = build, name, is_aggregate, text or name

    def column(self, order_by: tuple[str, ...] = ()) -> Column:
        return self._build(order_by)

    def alias(self, name: str) -> Expr:
        return Expr(self._build, name, self.is_aggregate, f"{self.text} as {name}")

    def _one(self, fn: Callable[[Column], Column], text: str, name: str | None = None) -> Expr:
        return Expr(lambda o: fn(self._build(o)), name or self.name, self.is_aggregate, text.format(self.text))

    def _two(self, other: Any, fn: Callable[[Any, Any], Column], sign: str) -> Expr:
        that = other if isinstance(other, Expr) else lit(other)
        return Expr(lambda o: fn(self._build(o), that._build(o)), f"{self.name}_{that.name}" if that.name != "_lit" else self.name, self.is_aggregate or that.is_aggregate, f"({self.text} {sign} {that.text})")

    def __add__(self, other: Any) -> Expr:
        return self._two(other, N.add, "+")

    def __sub__(self, other: Any) -> Expr:
        return self._two(other, N.sub, "-")

    def __mul__(self, other: Any) -> Expr:
        return self._two(other, N.mul, "*")

    def __truediv__(self, other: Any) -> Expr:
        return self._two(other, N.div, "/")

    def __mod__(self, other: Any) -> Expr:
        return self._two(other, N.mod, "%")

    def __neg__(self) -> Expr:
        return self._one(N.neg, "-{}")

    def abs(self) -> Expr:
        return self._one(N.absolute, "abs({})")

    def __eq__(self, other: Any) -> Expr:  # type: ignore[override]
        return self._two(other, N.eq, "==")

    def __ne__(self, other: Any) -> Expr:  # type: ignore[override]
        return self._two(other, N.ne, "!=")

    def __lt__(self, other: Any) -> Expr:
        return self._two(other, N.lt, "<")

    def __le__(self, other: Any) -> Expr:
        return self._two(other, N.le, "<=")

    def __gt__(self, other: Any) -> Expr:
        return self._two(other, N.gt, ">")

    def __ge__(self, other: Any) -> Expr:
        return self._two(other, N.ge, ">=")

    __hash__ = None  # type: ignore[assignment]

    def __and__(self, other: Any) -> Expr:
        return self._two(other, N.both, "and")

    def __or__(self, other: Any) -> Expr:
        return self._two(other, N.either, "or")

    def __invert__(self) -> Expr:
        return self._one(N.negate, "not {}")

    def is_null(self) -> Expr:
        return self._one(lambda c: c.isNull(), "{} is null")

    def is_not_null(self) -> Expr:
        return self._one(lambda c: c.isNotNull(), "{} is not null")

    def fill_na(self, value: Any) -> Expr:
        return self._one(lambda c: F.coalesce(c.cast("double") if isinstance(value, (int, float)) else c, F.lit(value)), "fill({})")

    def apply(self, fn: Callable[[Column], Column]) -> Expr:
        """``fn`` from column to column; a Python function goes through a vectorised UDF first."""
        return self._one(fn, "apply({})")

    def cast(self, kind: str) -> Expr:
        return self._one(lambda c: N.as_type(c, kind), "cast({})")

    def clip(self, low: float, high: float) -> Expr:
        return self._one(lambda c: N.clip(c, low, high), "clip({})")

    def _agg(self, fn: str) -> Expr:
        return Expr(lambda o: A.aggregate(fn, self._build(o), o), f"{self.name}_{fn}", True, f"{fn}({self.text})")

    def sum(self) -> Expr:
        return self._agg("sum")

    def mean(self) -> Expr:
        return self._agg("mean")

    def min(self) -> Expr:
        return self._agg("min")

    def max(self) -> Expr:
        return self._agg("max")

    def count(self) -> Expr:
        return self._agg("count")

    def std(self) -> Expr:
        return self._agg("std")

    def median(self) -> Expr:
        return self._agg("median")

    def first(self) -> Expr:
        return self._agg("first")

    def last(self) -> Expr:
        return self._agg("last")

    def nunique(self) -> Expr:
        return self._agg("nunique")

    def str_contains(self, pattern: str) -> Expr:
        return self._one(lambda c: S.contains(c, pattern), "contains({})")

    def str_replace(self, old: str, new: str) -> Expr:
        return self._one(lambda c: S.replace(c, old, new), "replace({})")

    def str_upper(self) -> Expr:
        return self._one(S.upper, "upper({})")

    def str_lower(self) -> Expr:
        return self._one(S.lower, "lower({})")

    def __repr__(self) -> str:
        return self.text


def col(name: str) -> Expr:
    return Expr(lambda o: F.col(f"`{name}`"), name)


def lit(value: Any) -> Expr:
    return Expr(lambda o: F.lit(value), "_lit", False, repr(value))
