"""A lazy frame: expressions over Spark's own lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators import agg as A
from ..operators.select import sort_by
from .expr import Expr


class LazyFrame:
    def __init__(self, df: DataFrame, order_by: Sequence[str] = ()):
        self.df, self.order_by = df, tuple(order_by)

    def select(self, *exprs: Expr) -> LazyFrame:
        """Only aggregates give one row; next to other expressions they are worked out over all rows."""
        columns = [e.column(self.order_by).alias(e.name) for e in exprs]
        if exprs and all(e.is_aggregate for e in exprs):
            return LazyFrame(self.df.agg(*columns))
        if any(e.is_aggregate for e in exprs):
            from pyspark.sql import functions as F

            whole = self.df.agg(*[c for e, c in zip(exprs, columns) if e.is_aggregate])  # one row
            rest = self.df.select("*", *[c.alias(f"__{i}") for i, (e, c) in enumerate(zip(exprs, columns)) if not e.is_aggregate])
            joined = rest.join(F.broadcast(whole.withColumnsRenamed({e.name: f"__{i}" for i, e in enumerate(exprs) if e.is_aggregate})))
            return LazyFrame(joined.select(*[F.col(f"__{i}").alias(e.name) for i, e in enumerate(exprs)]))
        return LazyFrame(self.df.select(*columns), [k for k in self.order_by if k in {e.name for e in exprs}])

    def filter(self, expr: Expr) -> LazyFrame:
        return LazyFrame(self.df.where(expr.column(self.order_by)), self.order_by)

    def with_column(self, name: str, expr: Expr) -> LazyFrame:
        return LazyFrame(self.df.withColumn(name, expr.column(self.order_by)), self.order_by)

    def group_by(self, *keys: str) -> LazyGroupBy:
        return LazyGroupBy(self, keys)

    def sort(self, by: Sequence[str], ascending: Sequence[bool] = ()) -> LazyFrame:
        return LazyFrame(sort_by(self.df, by, ascending, [k for k in self.order_by if k not in by]), self.order_by)

    def limit(self, n: int) -> LazyFrame:
        return LazyFrame(self.df.limit(n), self.order_by)

    def collect(self) -> DataFrame:
        """The frame; Spark runs it when rows are asked for."""
        return self.df

    def describe(self) -> str:
        """The optimised plan as text."""
        return self.df._jdf.queryExecution().optimizedPlan().toString()


class LazyGroupBy:
    def __init__(self, frame: LazyFrame, keys: Sequence[str]):
        self.frame, self.keys = frame, list(keys)

    def agg(self, aggs) -> LazyFrame:
        return LazyFrame(A.agg(self.frame.df, self.keys, aggs, self.frame.order_by))
