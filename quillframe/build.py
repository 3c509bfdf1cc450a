"""Series from single values, and frames put together."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import SparkSession

from .frame import Frame, Series
from .operators import reshape as R


class SeriesBuilder:
    """Collects values of one type; ``build`` makes a series of them, in their order."""

    def __init__(self, name: str, kind: str):
        self.name, self.kind = name, kind
        self.values: list[Any] = []
        self.labels: list[str] | None = None

    def set_index(self, labels: Sequence[Any]) -> SeriesBuilder:
        """Row labels, one for each value by the time it is built."""
        self.labels = [str(v) for v in labels]
        return self

    def append(self, value: Any) -> SeriesBuilder:
        """Add a value, cast to the builder's type where Python can."""
        if value is not None:
            if self.kind == "bool":
                value = bool(value)
            elif self.kind.startswith(("int", "uint")) or self.kind == "duration":
                value = int(value)
            elif self.kind.startswith("float"):
                value = float(value)
            elif self.kind in ("string", "category"):
                value = str(value)
        self.values.append(value)
        return self

    def append_null(self) -> SeriesBuilder:
        return self.append(None)

    def __len__(self) -> int:
        return len(self.values)

    def build(self, spark: SparkSession) -> Series:
        if self.labels is None:
            return Frame.of(spark, {self.name: self.values}, {self.name: self.kind})[self.name]
        if len(self.labels) != len(self.values):
            raise ValueError(f"{len(self.labels)} labels for {len(self.values)} values")
        label = "index" if self.name != "index" else "index_"
        return Frame.of(spark, {label: self.labels, self.name: self.values}, {label: "string", self.name: self.kind}).set_index(label)[self.name]


def series(spark: SparkSession, name: str, values: Sequence[Any], kind: str, valid: Sequence[bool] | None = None) -> Series:
    """A series of a type; values that aren't ``valid`` are null."""
    own = list(values) if valid is None else [v if ok else None for v, ok in zip(values, valid)]
    return Frame.of(spark, {name: own}, {name: kind})[name]


def concat(frames: Sequence[Frame], mode: str = "rows") -> Frame:
    """Frames one below the other (``rows``) or side by side in their own orders (``columns``)."""
    first = frames[0]
    if mode == "rows":
        from pyspark.sql import functions as F

        parts = [f.df.select(F.lit(k).alias("__part"), *f.order, *[c for c in first.columns if c not in f.order]) for k, f in enumerate(frames)]
        if all(f.order == first.order for f in frames):
            return Frame(R.concat_rows(parts), ("__part", *first.order))
        return Frame(R.concat_rows([f.df.select(*first.columns) for f in frames]))
    if mode != "columns":
        raise ValueError("mode must be rows or columns")
    return Frame(R.concat_columns([f.df.select(*dict.fromkeys([*f.columns, *f.order])) for f in frames], [f.order for f in frames]).drop("__idx", "__idx_right"))


def parallel_info(spark: SparkSession) -> str:
    return f"{spark.sparkContext.defaultParallelism} tasks at a time"
