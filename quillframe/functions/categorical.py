"""Categorical columns: a text column and its list of categories.

The empty text and null are no category. The list travels with the value, not with the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import keys_of


@dataclass(frozen=True)
class Categorical:
    frame: DataFrame
    column: str
    categories: tuple[str, ...]
    ordered: bool = False

    @staticmethod
    def of(frame: DataFrame, column: str, ordered: bool = False, order_by: Sequence[str] = (), most: int = 100_000) -> Categorical:
        """Sorted categories if ordered, else by first appearance. More than ``most`` are an error."""
        text = F.nullif(F.col(column).cast("string"), F.lit(""))
        first = F.min(F.struct(*[F.col(k) for k in keys_of(order_by)])) if order_by and not ordered else F.min(text)
        rows = frame.where(text.isNotNull()).groupBy(text.alias("v")).agg(first.alias("o")).orderBy("o").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{column} has more than {most} categories")
        return Categorical(frame, column, tuple(r["v"] for r in rows), ordered)

    def value(self) -> Column:
        """The category as text, null where it is none."""
        text = F.col(self.column).cast("string")
        return F.when(text.isin(list(self.categories)), text) if self.categories else F.lit(None).cast("string")

    def codes(self) -> Column:
        """The place of the category in the list, from 0; null where it is none."""
        if not self.categories:
            return F.lit(None).cast("int")
        return F.nullif(F.array_position(F.array(*map(F.lit, self.categories)), F.col(self.column).cast("string")).cast("int") - 1, F.lit(-1))

    def code(self, category: str) -> int:
        return self.categories.index(category) if category in self.categories else -1

    def __len__(self) -> int:
        return len(self.categories)

    dtype = "category"

    def index(self, order_by: Sequence[str]) -> DataFrame:
        """The positions of the rows as labels, in order."""
        from ..operators.order import indexed

        return indexed(self.frame, order_by, "__at").orderBy("__at").select(F.col("__at").cast("string").alias("index"))

    def is_null(self) -> Column:
        return self.value().isNull()

    def not_null(self) -> Column:
        return self.value().isNotNull()

    def null_count(self) -> int:
        return self.frame.where(self.value().isNull()).count()

    def reorder(self, categories: Sequence[str]) -> Categorical:
        """Another list of categories; values that aren't in it become null."""
        return replace(self, categories=tuple(dict.fromkeys(categories)), ordered=True)

    def add(self, categories: Sequence[str]) -> Categorical:
        return replace(self, categories=tuple(dict.fromkeys([*self.categories, *categories])))

    def remove(self, categories: Sequence[str]) -> Categorical:
        return replace(self, categories=tuple(c for c in self.categories if c not in set(categories)))

    def is_in(self, values: Sequence[str]) -> Column:
        own = self.value()
        return F.when(own.isNotNull(), own.isin(list(values)))

    def value_counts(self) -> DataFrame:
        """``code, category, count`` for every category, in their order, also those that no row has."""
        every = self.frame.sparkSession.createDataFrame(list(enumerate(self.categories)), "code int, category string")
        counts = self.frame.groupBy(self.value().alias("__c")).agg(F.count("*").alias("n"))
        return every.join(counts, F.col("category") == F.col("__c"), "left").select("code", "category", F.coalesce("n", F.lit(0)).alias("count")).orderBy("code")

    def sort(self, ascending: bool = True, order_by: Sequence[str] = ()) -> DataFrame:
        """The frame by code; rows without a category come first either way."""
        code = self.codes()
        return self.frame.orderBy(code.isNull().desc(), code.asc() if ascending else code.desc(), *order_by)

    def with_codes(self, name: str | None = None) -> DataFrame:
        return self.frame.withColumn(name or f"{self.column}_code", self.codes())

    def __str__(self) -> str:
        mark = " < " if self.ordered else ", "
        return f"Categorical({self.column}: {mark.join(self.categories)})"
