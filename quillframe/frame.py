"""Frames with a row order and an index: one object with all operators as methods.

A :class:`Frame` is a Spark frame, the columns that order its rows and the columns that are its
index. Methods give new frames; nothing runs until rows or numbers are asked for. A
:class:`Series` is a column of a frame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import numeric as N
from .functions import strings as S
from .functions import temporal as TM
from .functions.categorical import Categorical
from .functions.types import from_spark, numeric_columns
from .index import ListIndex
from .operators import agg as A
from .operators import join as J
from .operators import nulls as NU
from .operators import reshape as R
from .operators import select as SE
from .operators import stats as ST
from .operators import timegroup as TG
from .operators import window as W
from .operators.order import indexed
from .plans.expr import Expr
from .plans.lazy import LazyFrame
from .sources import files as IO


@dataclass(frozen=True)
class Frame:
    df: DataFrame
    order: tuple[str, ...] = ()
    index: tuple[str, ...] = ()

    # construction and metadata

    @staticmethod
    def of(spark: SparkSession, columns: Mapping[str, Sequence], types: Mapping[str, str] | None = None) -> Frame:
        """A small frame from lists, in their order (a hidden column ``__idx`` keeps it)."""
        from .functions.types import to_spark

        names = list(columns)
        kinds = types or {}

        def kind(n: str) -> T.DataType:
            if n in kinds:
                return to_spark(kinds[n])
            known = [v for v in columns[n] if v is not None]
            if known and all(isinstance(v, bool) for v in known):
                return T.BooleanType()
            if known and all(isinstance(v, int) for v in known):
                return T.LongType()
            if known and all(isinstance(v, (int, float)) for v in known):
                return T.DoubleType()
            if known and all(hasattr(v, "year") for v in known):
                return T.TimestampNTZType()
            return T.StringType()

        schema = T.StructType([T.StructField("__idx", T.LongType()), *[T.StructField(n, kind(n)) for n in names]])
        made = [[float(v) if v is not None and isinstance(f.dataType, T.DoubleType) else v for v in columns[f.name]] for f in schema.fields[1:]]
        rows = list(zip(range(len(made[0]) if made else 0), *made))
        return Frame(spark.createDataFrame(rows, schema), ("__idx",))

    def _new(self, df: DataFrame, order: Sequence[str] | None = None) -> Frame:
        keep = self.order if order is None else tuple(order)
        return Frame(df, tuple(k for k in keep if k in df.columns), tuple(i for i in self.index if i in df.columns))

    @property
    def columns(self) -> list[str]:
        """The columns but the index and hidden ones, whose names start with __."""
        return [c for c in self.df.columns if not c.startswith("__") and c not in self.index]

    def data(self) -> DataFrame:
        """The Spark frame without the hidden order, in order."""
        return self.sorted().select(*self.columns) if self.order else self.df.select(*self.columns)

    def sorted(self) -> DataFrame:
        return self.df.orderBy(*[F.col(k).asc_nulls_first() for k in self.order]) if self.order else self.df

    def order_by(self, *keys: str) -> Frame:
        return replace(self, order=keys)

    def __len__(self) -> int:
        return self.df.count()

    def shape(self) -> tuple[int, int]:
        return len(self), len(self.columns)

    def dtypes(self) -> dict[str, str]:
        return {c: from_spark(self.df.schema[c].dataType) for c in self.columns}

    def col(self, name: str) -> Series:
        if name not in self.df.columns:
            raise KeyError(name)
        return Series(self, F.col(f"`{name}`"), name)

    __getitem__ = col

    def info(self) -> DataFrame:
        return ST.info(self.df.select(*self.columns))

    def describe(self) -> DataFrame:
        return ST.describe(self.df.select(*self.columns))

    def memory_usage(self) -> dict[str, int]:
        return ST.memory_usage(self.df.select(*self.columns))

    def display(self, top: int = 10, bottom: int = 3) -> str:
        """A table of the first and last rows; all rows if there are few."""
        from .plans.display import table

        n = len(self)
        names = self.columns
        if n <= top + bottom or n <= 20 and (top, bottom) == (10, 3):
            return table(names, [list(r) for r in self.data().collect()], n)
        first = SE.head(self.df, top, self.order).select(*names).collect() if self.order else self.df.select(*names).limit(top).collect()
        last = SE.tail(self.df, bottom, self.order).select(*names).collect() if self.order else []
        return table(names, [list(r) for r in first] + [["..."] * len(names)] + [list(r) for r in last], n)

    __str__ = display

    def pipe(self, fn: Callable[[Frame], Frame]) -> Frame:
        return fn(self)

    def lazy(self) -> LazyFrame:
        return LazyFrame(self.df, self.order)

    # index

    def set_index(self, *names: str) -> Frame:
        return replace(self, index=names)

    def set_multi_index(self, *names: str) -> Frame:
        """Several index columns, as text; null is ``<nil>``."""
        return replace(self, df=self.df.withColumns({n: F.coalesce(F.col(n).cast("string"), F.lit("<nil>")) for n in names}), index=names)

    def reset_index(self) -> Frame:
        """The index as a text column ``_index`` in front; several levels are joined by /."""
        if not self.index:
            raise ValueError("the frame has no index")
        label = F.concat_ws("/", *[F.col(i).cast("string") for i in self.index]) if len(self.index) > 1 else F.col(self.index[0]).cast("string")
        rest = [c for c in self.df.columns if c not in self.index or c in self.order]
        return Frame(self.df.select(label.alias("_index"), *rest), self.order)

    def index_labels(self) -> DataFrame:
        return self.sorted().select(F.concat_ws("/", *[F.col(i).cast("string") for i in self.index]).alias("index"))

    def swap_level(self, i: int, j: int) -> Frame:
        """Two levels change places; levels that aren't there leave the frame as it is."""
        names = list(self.index)
        if not (0 <= i < len(names) and 0 <= j < len(names)):
            return self
        names[i], names[j] = names[j], names[i]
        return replace(self, index=tuple(names))

    def drop_level(self, level: int) -> Frame:
        """Without a level, but the last one stays."""
        if not 0 <= level < len(self.index) or len(self.index) == 1:
            return self
        name = self.index[level]
        return Frame(self.df.drop(name), self.order, tuple(n for n in self.index if n != name))

    def rename_level(self, level: int, name: str) -> Frame:
        if not 0 <= level < len(self.index):
            return self
        old = self.index[level]
        return Frame(self.df.withColumnRenamed(old, name), tuple(name if k == old else k for k in self.order), tuple(name if k == old else k for k in self.index))

    def level_values(self, level: int) -> DataFrame:
        return self.sorted().select(self.index[level])

    def xs(self, level: int, value: str) -> Frame:
        return self._new(self.df.where(F.col(self.index[level]).cast("string") == value))

    def group_by_level(self, level: int, aggs) -> DataFrame:
        return A.agg(self.df.withColumn("_group_key", F.col(self.index[level])), ["_group_key"], aggs, self.order)

    # projection and rows

    def select(self, *names: str) -> Frame:
        return self._new(self.df.select(*dict.fromkeys([*names, *self.order, *self.index])))

    def drop(self, *names: str) -> Frame:
        return self._new(self.df.drop(*[n for n in names if n not in self.order]))

    def head(self, n: int = 5) -> Frame:
        return self._new(SE.head(self.df, n, self.order))

    def tail(self, n: int = 5) -> Frame:
        return self._new(SE.tail(self.df, n, self.order))

    def slice(self, start: int, stop: int) -> Frame:
        return self._new(SE.slice_rows(self.df, start, stop, self.order))

    def filter(self, condition: Column | Series | Expr) -> Frame:
        return self._new(self.df.where(_column(condition, self.order)))

    parallel_filter = filter

    def filter_mask(self, mask: Sequence[bool]) -> Frame:
        """The rows at the positions that are true; the mask has a value for each row."""
        return self.take([i for i, keep in enumerate(mask) if keep])

    def take(self, positions: Sequence[int]) -> Frame:
        return self._new(SE.take(self.df, positions, self.order, "__idx" if "__idx" not in self.df.columns else "__place"), ("__idx",) if "__idx" not in self.df.columns else ("__place",))

    def with_column(self, name: str, value: Column | Series | Expr) -> Frame:
        return self._new(self.df.withColumn(name, _column(value, self.order)))

    def rename(self, names: Mapping[str, str]) -> Frame:
        new = lambda k: names.get(k, k)
        return Frame(self.df.withColumnsRenamed(dict(names)), tuple(map(new, self.order)), tuple(map(new, self.index)))

    def query(self, text: str) -> Frame:
        return self._new(SE.query(self.df, text))

    def is_in(self, values: Mapping[str, list]) -> DataFrame:
        return SE.is_in_columns(self.df.select(*self.columns), values)

    def where(self, condition: Column | Series, other: Any = None) -> Frame:
        """Cells where the condition isn't true become ``other``, or null where a column can't hold it."""
        c = _column(condition, self.order)
        return self._new(self.df.withColumns({n: N.where(F.col(n), c, F.lit(other).try_cast(self.df.schema[n].dataType)) for n in self.columns if n not in self.order}))

    def mask(self, condition: Column | Series, other: Any = None) -> Frame:
        c = _column(condition, self.order)
        return self._new(self.df.withColumns({n: N.mask(F.col(n), c, F.lit(other).try_cast(self.df.schema[n].dataType)) for n in self.columns if n not in self.order}))

    def sort_by(self, names: Sequence[str], ascending: Sequence[bool] = ()) -> DataFrame:
        return SE.sort_by(self.df, names, ascending, self.order).select(*self.columns)

    def duplicated(self, subset: Sequence[str] = (), keep: str = "first") -> DataFrame:
        return SE.duplicated(self.df, subset or self.columns, keep, self.order)

    def drop_duplicates(self, subset: Sequence[str] = (), keep: str = "first") -> Frame:
        return self._new(SE.drop_duplicates(self.df, subset or self.columns, keep, self.order))

    # joins

    def merge(self, other: Frame, on: Sequence[str], how: str = "inner") -> Frame:
        right = other.df.drop(*[k for k in other.order if k == "__idx"])
        return self._new(J.merge_on(self.df, right, on, how))

    def join(self, other: Frame, how: str = "inner") -> Frame:
        """Join on the index, by its labels."""
        right = other.df.drop(*[k for k in other.order if k == "__idx"]).withColumnRenamed(other.index[0], self.index[0])
        return self._new(J.join_index(self.df, right, self.index[0], how))

    def asof_join(self, other: Frame, on: str, by: Sequence[str] = ()) -> Frame:
        return self._new(J.asof(self.df, other.df.drop("__idx"), on, by))

    def semi_join(self, other: Frame, on: Sequence[str]) -> Frame:
        return self._new(J.semi(self.df, other.df, on))

    def anti_join(self, other: Frame, on: Sequence[str]) -> Frame:
        return self._new(J.anti(self.df, other.df, on))

    def cross_join(self, other: Frame) -> Frame:
        return self._new(J.cross(self.df, other.df.drop("__idx")))

    # groups

    def agg(self, keys: Sequence[str], aggs) -> DataFrame:
        return A.agg(self.df, keys, aggs, self.order)

    parallel_agg = agg  # partial sums on every partition are how Spark aggregates

    def groups(self, keys: Sequence[str]) -> DataFrame:
        return A.groups(indexed(self.df, self.order, "__position"), keys, "__position")

    def group_transform(self, keys: Sequence[str], target: str, fn: Callable | Column, aggregates: Mapping[str, Column] | None = None) -> Frame:
        return self._new(A.transform(self.df, keys, target, fn, self.order, aggregates))

    def group_filter(self, keys: Sequence[str], predicate: Column | Callable) -> Frame:
        return self._new(A.filter_groups(self.df, keys, predicate))

    def group_apply(self, keys: Sequence[str], fn: Callable, schema) -> DataFrame:
        return A.apply_groups(self.df, keys, fn, schema)

    def group_rolling(self, group: str, column: str, size: int, fn: str) -> DataFrame:
        return W.group_rolling(self.df, group, column, size, fn, self.order)

    def group_by_dynamic(self, time: str, period: int, every: int = 0) -> TG.Dynamic:
        return TG.group_by_dynamic(self.df, time, period, every)

    def group_rolling_time(self, time: str, period: int, by: Sequence[str], column: str, fn: str) -> DataFrame:
        return TG.rolling_time(self.df, time, period, by, column, fn)

    def resample(self, time: str, every: int, fn: str) -> DataFrame:
        return TG.resample(self.df.select(*self.columns), time, every, fn)

    # nulls, types, shapes

    def drop_na(self) -> Frame:
        return self._new(NU.drop_na(self.df))

    parallel_drop_na = drop_na

    def fill_na(self, value: Any) -> Frame:
        filled = NU.fill_na(self.df.select(*[c for c in self.df.columns if c not in self.order]), value)
        return self._new(NU.fill_na(self.df, value)) if not self.order else self._new(self.df.select(*self.order, *[_filled(self.df, f, value) for f in filled.schema.fields]))

    parallel_fill_na = fill_na

    def fill_na_method(self, method: str) -> Frame:
        return self._new(NU.fill_method(self.df, method, self.order))

    def convert_dtypes(self) -> Frame:
        return self._new(R.convert_dtypes(self.df))

    def pivot(self, index: str, columns: str, values: str, names: Sequence[str] | None = None) -> DataFrame:
        return R.pivot(self.df, index, columns, values, self.order, names)

    def pivot_table(self, index: str, columns: str, values: str, fn: str, names: Sequence[str] | None = None) -> DataFrame:
        return R.pivot_table(self.df, index, columns, values, fn, self.order, names)

    def melt(self, ids: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
        return R.melt(self.df.select(*self.columns), ids, values)

    def stack(self) -> DataFrame:
        return R.stack(self.df.select(*self.columns))

    def unstack(self, level: int, names: Sequence[str] | None = None) -> DataFrame:
        return R.unstack(self.df, self.index, level, self.order, names)

    def compare(self, other: Frame, keep_equal: bool = False) -> DataFrame:
        left = self.df.select(*dict.fromkeys([*self.columns, *self.order]))
        return R.compare(left, other.df, self.order, other.order, keep_equal).select(*[c for c in self.columns if c in other.columns])

    def get_dummies(self, columns: Sequence[str]) -> Frame:
        return self._new(R.get_dummies(self.df, columns, self.order))

    def corr(self) -> DataFrame:
        return ST.corr_matrix(self.df.select(*self.columns))

    # functions over columns and rows

    def transform(self, fn: Callable[[Column], Column]) -> Frame:
        """``fn`` from column to column over the numeric columns."""
        return self._new(self.df.withColumns({c: fn(F.col(c).cast("double")) for c in numeric_columns(self.df.schema) if c not in self.order}))

    parallel_transform = transform

    def apply_cols(self, fn: Callable[[Column], Column]) -> Frame:
        return self._new(self.df.withColumns({c: fn(F.col(c)) for c in self.columns if c not in self.order}))

    parallel_apply_cols = apply_cols

    def apply_rows(self, fn: Callable[[dict], dict], schema) -> DataFrame:
        """``fn`` from a row as a dict to a dict, in Arrow batches, to a frame of ``schema``."""
        names = self.columns

        def run(batches):
            for pdf in batches:
                yield pd.DataFrame([fn(r) for r in pdf.to_dict("records")])

        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        cols = [f.name for f in wanted.fields]

        def ordered(batches):
            for out in run(batches):
                yield out.reindex(columns=cols) if len(out) else pd.DataFrame(columns=cols)

        return self.df.select(*names).mapInPandas(ordered, wanted)

    # sinks

    def to_csv(self) -> str:
        return IO.to_csv(self.data())

    def to_json(self) -> str:
        return IO.to_json(self.data())

    def to_json_lines(self) -> str:
        return IO.to_json_lines(self.data())

    def write_csv_file(self, path: str) -> None:
        IO.write_csv_file(self.data(), path)

    def write_json_file(self, path: str) -> None:
        IO.write_json_file(self.data(), path)

    def write_json_lines_file(self, path: str) -> None:
        IO.write_json_lines_file(self.data(), path)


def _vectorised(fn: Callable, kind: Any) -> Callable[[Column], Column]:
    """``fn`` over a column's values but null, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return values.map(fn, na_action="ignore")

    return run


def _filled(df: DataFrame, f: T.StructField, value: Any) -> Column:
    return N.fill(F.col(f.name), value, f.dataType).alias(f.name) if NU._fits(value, f.dataType) else F.col(f.name)


def _column(value: Any, order: tuple[str, ...] = ()) -> Column:
    if isinstance(value, Series):
        return value.column
    if isinstance(value, Expr):
        return value.column(order)
    return value if isinstance(value, Column) else F.lit(value)


@dataclass(frozen=True, eq=False)
class Series:
    """A column of a frame. Series of one frame combine row by row."""

    frame: Frame
    column: Column
    name: str

    def _new(self, column: Column, name: str | None = None) -> Series:
        return Series(self.frame, column, name or self.name)

    def _frame(self) -> DataFrame:
        """The frame with this column under a name of its own."""
        return self.frame.df.withColumn("__x", self.column)

    def _windowed(self, df: DataFrame, name: str) -> Series:
        """A column of a frame that has the rows and order of this one."""
        return Series(Frame(df, self.frame.order, self.frame.index), F.col(name), self.name)

    def data(self) -> DataFrame:
        df = self.frame.df.withColumn("__x", self.column)
        df = df.orderBy(*[F.col(k).asc_nulls_first() for k in self.frame.order]) if self.frame.order else df
        return df.select(F.col("__x").alias(self.name))

    def to_list(self) -> list:
        return [r[0] for r in self.data().collect()]

    def at(self, i: int) -> Any:
        """The value at a position, as bool, int, float, text or time by the series' type; null is None."""
        found = self.take([i]).collect()
        if not found:
            raise IndexError(i)
        return found[0][0]

    def labels(self, most: int = 1_000_000) -> ListIndex:
        """The values as an index that the program holds; more than ``most`` are an error."""
        values = [r[0] for r in self.data().limit(most + 1).collect()]
        if len(values) > most:
            raise ValueError(f"{self.name} has more than {most} values")
        kind = self.dtype()
        return ListIndex(tuple(values), kind if kind in ("int64", "timestamp") else "string")

    def display(self, top: int = 10, bottom: int = 3) -> str:
        """A table of the first and last values, with the type."""
        own = Frame(self._frame().withColumnRenamed(self.name, "__own").withColumnRenamed("__x", self.name).select(self.name, *[k for k in self.frame.order if k != self.name]), tuple(k for k in self.frame.order if k != self.name))
        return f"{own.select(self.name).display(top, bottom)}\n{self.name}: {self.dtype()}"

    def _scalar(self, column: Column) -> Any:
        return self._frame().agg(column).first()[0]

    def __len__(self) -> int:
        return self.frame.df.count()

    def dtype(self) -> str:
        return from_spark(self._frame().schema["__x"].dataType)

    def index(self) -> DataFrame:
        """The row labels in order: those of the frame's index, or else the positions."""
        if self.frame.index:
            return self.frame.index_labels()
        return indexed(self.frame.df, self.frame.order, "__at").orderBy("__at").select(F.col("__at").cast("string").alias("index"))

    def null_count(self) -> int:
        return self._scalar(F.count_if(F.col("__x").isNull()))

    def is_null(self) -> Series:
        return self._new(self.column.isNull())

    def not_null(self) -> Series:
        return self._new(self.column.isNotNull())

    def rename(self, name: str) -> Series:
        return self._new(self.column, name)

    def copy(self) -> Series:
        return self

    def head(self, n: int = 5) -> DataFrame:
        return SE.head(self._frame(), n, self.frame.order).select(F.col("__x").alias(self.name))

    def tail(self, n: int = 5) -> DataFrame:
        return SE.tail(self._frame(), n, self.frame.order).select(F.col("__x").alias(self.name))

    def slice(self, start: int, stop: int) -> DataFrame:
        return SE.slice_rows(self._frame(), start, stop, self.frame.order).select(F.col("__x").alias(self.name))

    def take(self, positions: Sequence[int]) -> DataFrame:
        return SE.take(self._frame(), positions, self.frame.order).select(F.col("__x").alias(self.name))

    def filter(self, condition: Series | Column) -> Series:
        return Series(self.frame.filter(condition), self.column, self.name)

    def __repr__(self) -> str:
        return f"Series({self.name}: {self.column})"

    # arithmetic, comparison, logic

    def __add__(self, o: Any) -> Series:
        return self._new(N.add(self.column, _column(o)))

    def __sub__(self, o: Any) -> Series:
        return self._new(N.sub(self.column, _column(o)))

    def __mul__(self, o: Any) -> Series:
        return self._new(N.mul(self.column, _column(o)))

    def __truediv__(self, o: Any) -> Series:
        return self._new(N.div(self.column, _column(o)))

    def __mod__(self, o: Any) -> Series:
        return self._new(N.mod(self.column, _column(o)))

    def __neg__(self) -> Series:
        return self._new(N.neg(self.column))

    def abs(self) -> Series:
        return self._new(N.absolute(self.column))

    def clip(self, low: float, high: float) -> Series:
        return self._new(N.clip(self.column, low, high))

    def eq(self, o: Any) -> Series:
        return self._new(N.eq(self.column, _column(o)))

    def ne(self, o: Any) -> Series:
        return self._new(N.ne(self.column, _column(o)))

    def lt(self, o: Any) -> Series:
        return self._new(N.lt(self.column, _column(o)))

    def le(self, o: Any) -> Series:
        return self._new(N.le(self.column, _column(o)))

    def gt(self, o: Any) -> Series:
        return self._new(N.gt(self.column, _column(o)))

    def ge(self, o: Any) -> Series:
        return self._new(N.ge(self.column, _column(o)))

    def __and__(self, o: Any) -> Series:
        return self._new(N.both(self.column, _column(o)))

    def __or__(self, o: Any) -> Series:
        return self._new(N.either(self.column, _column(o)))

    def __invert__(self) -> Series:
        return self._new(N.negate(self.column))

    def as_type(self, kind: str) -> Series:
        return self._new(N.as_type(self.column, kind))

    def to_numeric(self) -> Series:
        return self._new(N.to_numeric(self.column))

    def is_in(self, values: list) -> Series:
        return self._new(N.is_in(self.column, values))

    def where(self, condition: Any, other: Any = None) -> Series:
        return self._new(N.where(self.column, _column(condition), _column(other)))

    def mask(self, condition: Any, other: Any = None) -> Series:
        return self._new(N.mask(self.column, _column(condition), _column(other)))

    # reductions

    def sum(self) -> float:
        return self._scalar(A.aggregate("sum", F.col("__x").cast("double")))

    def mean(self) -> float:
        return self._scalar(A.aggregate("mean", F.col("__x").cast("double")))

    def std(self) -> float:
        return self._scalar(A.aggregate("std", F.col("__x").cast("double")))

    def median(self) -> float:
        return ST.quantile(self._frame(), "__x", 0.5)

    def quantile(self, p: float) -> float:
        return ST.quantile(self._frame(), "__x", p)

    def skew(self) -> float:
        return self._scalar(ST.skew_of(F.col("__x")))

    def kurt(self) -> float:
        return self._scalar(ST.kurt_of(F.col("__x")))

    def nunique(self) -> int:
        return self._scalar(F.count_distinct("__x"))

    def corr(self, other: Series) -> float:
        return self.frame.df.agg(ST.corr_of(self.column, other.column)).first()[0]

    def cov(self, other: Series) -> float:
        return self.frame.df.agg(ST.cov_of(self.column, other.column)).first()[0]

    def mode(self) -> DataFrame:
        return ST.mode(self._frame(), "__x", self.frame.order).withColumnRenamed("__x", self.name)

    def unique(self) -> DataFrame:
        return SE.unique(self._frame(), "__x", self.frame.order).withColumnRenamed("__x", self.name)

    def value_counts(self) -> DataFrame:
        return SE.value_counts(self._frame(), "__x", self.frame.order).withColumnRenamed("__x", self.name)

    def nlargest(self, n: int) -> DataFrame:
        return SE.nlargest(self._frame(), "__x", n).withColumnRenamed("__x", self.name)

    def nsmallest(self, n: int) -> DataFrame:
        return SE.nsmallest(self._frame(), "__x", n).withColumnRenamed("__x", self.name)

    def duplicated(self, keep: str = "first") -> Series:
        return self._windowed(SE.duplicated(self._frame(), ["__x"], keep, self.frame.order, "__dup", nulls_are_values=False), "__dup")

    def drop_duplicates(self, keep: str = "first") -> Series:
        return self._windowed(SE.drop_duplicates(self._frame(), ["__x"], keep, self.frame.order, nulls_are_values=False), "__x")

    def factorize(self) -> tuple[Series, DataFrame]:
        coded, values = SE.factorize(self._frame(), "__x", self.frame.order, "__code")
        return self._windowed(coded, "__code"), values.select(F.col("__code").alias("code"), F.col("__x").alias(self.name))

    def explode(self, separator: str) -> DataFrame:
        out = R.explode_text(self._frame(), "__x", separator, "__place")
        return out.orderBy(*self.frame.order, "__place").select(F.col("__x").alias(self.name))

    def cut(self, bins: int) -> Series:
        return self._windowed(R.cut(self._frame(), "__x", bins, "__cut"), "__cut")

    def qcut(self, q: int) -> Series:
        return self._windowed(R.qcut(self._frame(), "__x", q, "__cut"), "__cut")

    # ordered

    def shift(self, n: int) -> Series:
        return self._windowed(W.shift(self._frame(), "__x", n, self.frame.order, name="__w"), "__w")

    def diff(self, periods: int = 1) -> Series:
        return self._windowed(W.diff(self._frame(), "__x", periods, self.frame.order, name="__w"), "__w")

    def pct_change(self, periods: int = 1) -> Series:
        return self._windowed(W.pct_change(self._frame(), "__x", periods, self.frame.order, name="__w"), "__w")

    def _cum(self, fn: str) -> Series:
        return self._windowed(W.cumulative(self._frame(), "__x", fn, self.frame.order, name="__w"), "__w")

    def cumsum(self) -> Series:
        return self._cum("sum")

    def cumprod(self) -> Series:
        return self._cum("prod")

    def cummax(self) -> Series:
        return self._cum("max")

    def cummin(self) -> Series:
        return self._cum("min")

    def fill_forward(self) -> Series:
        return self._windowed(NU.fill_forward(self._frame(), ["__x"], self.frame.order), "__x")

    def fill_backward(self) -> Series:
        return self._windowed(NU.fill_backward(self._frame(), ["__x"], self.frame.order), "__x")

    def interpolate(self) -> Series:
        return self._windowed(NU.interpolate(self._frame(), ["__x"], self.frame.order), "__x")

    def rank(self, method: str = "average") -> Series:
        return self._windowed(W.rank(self._frame(), "__x", method, self.frame.order, name="__w"), "__w")

    def rolling(self, size: int, min_periods: int | None = None) -> Rolling:
        return Rolling(self, size, min_periods)

    def expanding(self, min_periods: int = 1) -> Expanding:
        return Expanding(self, min_periods)

    def ewm(self, alpha: float | None = None, span: int | None = None) -> Series:
        """The exponentially weighted mean."""
        return self._windowed(W.ewm_mean(self._frame(), "__x", self.frame.order, alpha, span, name="__w"), "__w")

    # element functions

    def apply(self, fn: Callable[[Any], Any]) -> Series:
        """``fn`` on each element, null included; the results as text. It runs in Python, in Arrow batches."""

        @F.udf("string", useArrow=True)
        def run(v):
            out = fn(v)
            return None if out is None else str(out)

        return self._new(run(self.column))

    def _mapped(self, fn: Callable, kind: Any) -> Series:
        return self._new(_vectorised(fn, kind)(self.column.cast(kind)))

    def map_float(self, fn: Callable[[float], float]) -> Series:
        return self._mapped(fn, "double")

    def map_string(self, fn: Callable[[str], str]) -> Series:
        return self._mapped(fn, "string")

    def map_bool(self, fn: Callable[[bool], bool]) -> Series:
        return self._mapped(fn, "boolean")

    # accessors

    def cat(self, separator=""):
        """All texts but null as one, in order; for small series."""
        return self._frame().agg(S.cat(F.col("__x"), separator, [F.col(k) for k in self.frame.order])).first()[0]

    @property
    def str(self) -> Accessor:
        return Accessor(self, S)

    @property
    def dt(self) -> Accessor:
        return Accessor(self, TM)

    @property
    def duration(self) -> Accessor:
        return Accessor(self, TM)

    def categorical(self, ordered: bool = False) -> Categorical:
        return Categorical.of(self._frame(), "__x", ordered, self.frame.order)


class Accessor:
    """The functions of a module on a series: ``s.str.upper()``, ``s.dt.year()``."""

    def __init__(self, series: Series, module: Any):
        self._series, self._module = series, module

    def __getattr__(self, name: str) -> Callable[..., Series]:
        fn = getattr(self._module, name)

        def call(*args: Any, **kwargs: Any) -> Series:
            args = tuple(a.column if isinstance(a, Series) else a for a in args)
            return self._series._new(fn(self._series.column, *args, **kwargs))

        return call


@dataclass(frozen=True)
class Rolling:
    series: Series
    size: int
    min_periods: int | None = None

    def _of(self, fn: str) -> Series:
        s = self.series
        return s._windowed(W.rolling(s._frame(), "__x", fn, self.size, s.frame.order, (), self.min_periods, "__w"), "__w")

    def mean(self) -> Series:
        return self._of("mean")

    def sum(self) -> Series:
        return self._of("sum")

    def std(self) -> Series:
        return self._of("std")

    def var(self) -> Series:
        return self._of("var")

    def min(self) -> Series:
        return self._of("min")

    def max(self) -> Series:
        return self._of("max")

    def count(self) -> Series:
        return self._of("count")

    def median(self) -> Series:
        return self._of("median")

    def apply(self, fn: Callable[[Column], Column]) -> Series:
        s = self.series
        return s._windowed(W.rolling_apply(s._frame(), "__x", fn, self.size, s.frame.order, (), self.min_periods, "__w"), "__w")


@dataclass(frozen=True)
class Expanding:
    series: Series
    min_periods: int = 1

    def _of(self, fn: str) -> Series:
        s = self.series
        return s._windowed(W.expanding(s._frame(), "__x", fn, s.frame.order, (), self.min_periods, "__w"), "__w")

    def mean(self) -> Series:
        return self._of("mean")

    def sum(self) -> Series:
        return self._of("sum")

    def min(self) -> Series:
        return self._of("min")

    def max(self) -> Series:
        return self._of("max")

    def std(self) -> Series:
        return self._of("std")
