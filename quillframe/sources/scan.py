"""Scan builders: projection, conditions, limit and offset, which Spark pushes into the read."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import read_csv_file
from .infer import blank, typed, vote
from .scratch import delete_path, scratch_path

_OPS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Scan:
    """A read that isn't run yet. Conditions are typed: a number is compared as a number."""

    spark: SparkSession
    path: str
    format: str
    columns: tuple[str, ...] = ()
    filters: tuple[tuple[str, str, Any], ...] = ()
    rows: int | None = None
    first: int = 0
    order: tuple[str, ...] = ()
    sep: str = ","
    skipped: int = 0

    def delimiter(self, sep: str) -> Scan:
        return replace(self, sep=sep)

    def skip_lines(self, n: int) -> Scan:
        return replace(self, skipped=n)

    def select(self, *columns: str) -> Scan:
        return replace(self, columns=columns)

    def filter(self, column: str, op: str, value: Any) -> Scan:
        if op not in _OPS:
            raise ValueError(f"unknown operator {op!r}")
        return replace(self, filters=(*self.filters, (column, op, value)))

    def limit(self, n: int) -> Scan:
        return replace(self, rows=n)

    def offset(self, n: int, order_by: Sequence[str] = ()) -> Scan:
        """Skip the first ``n`` matches; with order keys it is said which those are."""
        return replace(self, first=n, order=tuple(order_by))

    def collect(self) -> DataFrame:
        """The plan: conditions, then projection, offset and limit."""
        if self.format == "csv":
            raw = read_csv_file(self.spark, self.path, self.sep, self.skipped, infer=False)
            wanted = self.columns or tuple(raw.columns)
            if missing := [c for c in wanted if c not in raw.columns]:
                raise ValueError(f"no such columns: {', '.join(missing)}")
            for c, op, v in self.filters:
                text = blank(F.col(f"`{c}`"))
                raw = raw.where(_OPS[op](text.try_cast("double") if isinstance(v, (int, float)) and not isinstance(v, bool) else text, v))
            return typed(self._cut(raw).select(*wanted), kinds=vote(raw, wanted))
        df = self.spark.read.format(self.format).load(self.path)
        for c, op, v in self.filters:
            df = df.where(_OPS[op](F.col(f"`{c}`"), v))
        df = self._cut(df)
        return df.select(*[c for c in df.columns if c in self.columns]) if self.columns else df

    def _cut(self, df: DataFrame) -> DataFrame:
        if self.order:
            df = df.orderBy(*self.order)
        if self.first:
            df = df.offset(self.first)
        return df if self.rows is None else df.limit(self.rows)

    def for_each(self, chunk_rows: int, fn: Callable[[DataFrame], None], order_by: Sequence[str]) -> int:
        """Call ``fn`` with chunks of rows in order; the number of rows passed, to go on from with ``offset``.

        The rows are numbered and dealt into a folder for each chunk in one pass, so that a chunk
        reads its own rows only; for files that keep coming, see
        :func:`quillframe.streaming.for_each_batch`. The calls follow each other on the driver,
        each with jobs of its own, so it is for few chunks; for many see :meth:`map_chunks`.
        """
        df = self._chunked(chunk_rows, order_by)
        path = scratch_path(self.spark, "chunks")
        try:
            df.repartition("__chunk").write.partitionBy("__chunk").parquet(path)
            sizes = {r[0]: r[1] for r in self.spark.read.parquet(path).groupBy("__chunk").count().collect()}  # one row for each chunk
            for k in sorted(sizes):
                part = self.spark.read.schema(df.drop("__chunk").schema).parquet(f"{path}/__chunk={k}")
                fn(part.orderBy("__at").drop("__at"))
            return sum(sizes.values())
        finally:
            delete_path(self.spark, path)

    def map_chunks(self, chunk_rows: int, fn: Callable[[int, pa.Table], pa.Table], schema: str, order_by: Sequence[str]) -> DataFrame:
        """The rows that ``fn`` makes of each chunk, for any number of chunks.

        ``fn`` gets the number of the chunk, from 0, and its rows in order as an Arrow table; it
        runs on the executors, on many chunks at a time, and must fit a chunk into a worker's
        memory. ``schema``: what it returns.
        """
        df = self._chunked(chunk_rows, order_by)

        def apply(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
            return fn(key[0].as_py(), rows.sort_by("__at").drop_columns(["__at", "__chunk"]))

        return df.groupBy("__chunk").applyInArrow(apply, schema)

    def _chunked(self, chunk_rows: int, order_by: Sequence[str]) -> DataFrame:
        """The rows with ``__at``, their place in the order, and ``__chunk``."""
        from ..operators.order import indexed

        return indexed(self.collect(), order_by, "__at").withColumn("__chunk", F.floor(F.col("__at") / chunk_rows))


def scan_csv(spark: SparkSession, path: str) -> Scan:
    return Scan(spark, path, "csv")


def scan_parquet(spark: SparkSession, path: str) -> Scan:
    return Scan(spark, path, "parquet")
