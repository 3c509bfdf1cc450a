"""Row labels as values: ranges, lists and several levels.

Frames carry their index as columns. These objects are for labels that a program holds itself,
such as those of a small result; ``to_frame`` makes columns of them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RangeIndex:
    """The whole numbers from ``start`` up to ``stop``."""

    start: int
    stop: int
    dtype: str = "int64"

    def __len__(self) -> int:
        return max(0, self.stop - self.start)

    def get(self, i: int) -> str:
        if not 0 <= i < len(self):
            raise IndexError(i)
        return str(self.start + i)

    def slice(self, start: int, stop: int) -> RangeIndex:
        low = min(max(self.start + start, self.start), self.stop)
        return RangeIndex(low, max(low, min(self.start + stop, self.stop)))

    def copy(self) -> RangeIndex:
        return self

    def to_frame(self, spark: SparkSession, name: str = "index") -> DataFrame:
        return spark.range(self.start, max(self.start, self.stop)).withColumnRenamed("id", name)


def default_index(n: int) -> RangeIndex:
    return RangeIndex(0, n)


@dataclass(frozen=True)
class ListIndex:
    """Labels of one type: int64, string or timestamp."""

    values: tuple[Any, ...]
    dtype: str

    @staticmethod
    def of_int(values: Sequence[int]) -> ListIndex:
        return ListIndex(tuple(values), "int64")

    @staticmethod
    def of_string(values: Sequence[str]) -> ListIndex:
        return ListIndex(tuple(values), "string")

    @staticmethod
    def of_time(values: Sequence[dt.datetime]) -> ListIndex:
        return ListIndex(tuple(values), "timestamp")

    def __len__(self) -> int:
        return len(self.values)

    def get(self, i: int) -> str:
        """The label as text; times as in RFC 3339."""
        v = self.values[i]
        if isinstance(v, dt.datetime):
            text = v.replace(microsecond=0).isoformat()
            return text.replace("+00:00", "Z") if v.tzinfo else text + "Z"
        return str(v)

    def slice(self, start: int, stop: int) -> ListIndex:
        return ListIndex(self.values[start:stop], self.dtype)

    def copy(self) -> ListIndex:
        return self

    def to_frame(self, spark: SparkSession, name: str = "index") -> DataFrame:
        from .functions.types import to_spark

        return spark.createDataFrame([(v,) for v in self.values], f"`{name}` {to_spark(self.dtype).simpleString()}")


@dataclass(frozen=True)
class MultiIndex:
    """Rows of text labels on several levels."""

    tuples: tuple[tuple[str, ...], ...]
    names: tuple[str, ...]

    @staticmethod
    def from_tuples(tuples: Sequence[Sequence[str]], names: Sequence[str]) -> MultiIndex:
        if any(len(t) != len(names) for t in tuples):
            raise ValueError("every row needs a label for every level")
        return MultiIndex(tuple(map(tuple, tuples)), tuple(names))

    @staticmethod
    def from_codes(levels: Sequence[Sequence[str]], codes: Sequence[Sequence[int]], names: Sequence[str]) -> MultiIndex:
        return MultiIndex.from_tuples(list(zip(*[[level[c] for c in own] for level, own in zip(levels, codes)])), names)

    def __len__(self) -> int:
        return len(self.tuples)

    @property
    def n_levels(self) -> int:
        return len(self.names)

    @property
    def levels(self) -> list[list[str]]:
        """The distinct labels of each level, by first appearance."""
        return [list(dict.fromkeys(t[k] for t in self.tuples)) for k in range(self.n_levels)]

    def get(self, i: int) -> tuple[str, ...]:
        return self.tuples[i]

    def get_level(self, level: int, i: int) -> str:
        """The label of a row on a level; empty where there is none."""
        return self.tuples[i][level] if 0 <= level < self.n_levels and 0 <= i < len(self) else ""

    def level_values(self, level: int) -> list[str]:
        return [t[level] for t in self.tuples] if 0 <= level < self.n_levels else []

    def to_index(self) -> ListIndex:
        return ListIndex.of_string(["/".join(t) for t in self.tuples])

    def xs(self, level: int, value: str) -> list[int]:
        """The positions of the rows with a label on a level."""
        return [i for i, v in enumerate(self.level_values(level)) if v == value]

    def slice(self, start: int, stop: int) -> MultiIndex:
        return MultiIndex(self.tuples[start:stop], self.names)

    def _picked(self, order: Sequence[int]) -> MultiIndex:
        return MultiIndex(tuple(tuple(t[k] for k in order) for t in self.tuples), tuple(self.names[k] for k in order))

    def swap_level(self, i: int, j: int) -> MultiIndex:
        if not (0 <= i < self.n_levels and 0 <= j < self.n_levels):
            return self
        order = list(range(self.n_levels))
        order[i], order[j] = order[j], order[i]
        return self._picked(order)

    def drop_level(self, level: int) -> MultiIndex:
        """Without a level; the last one stays."""
        if self.n_levels == 1 or not 0 <= level < self.n_levels:
            return self
        return self._picked([k for k in range(self.n_levels) if k != level])

    def rename_level(self, level: int, name: str) -> MultiIndex:
        if not 0 <= level < self.n_levels:
            return self
        return MultiIndex(self.tuples, tuple(name if k == level else n for k, n in enumerate(self.names)))

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([*self.tuples], ", ".join(f"`{n}` string" for n in self.names))

    def __str__(self) -> str:
        return "\n".join([" ".join(self.names), *[" ".join(t) for t in self.tuples]])
