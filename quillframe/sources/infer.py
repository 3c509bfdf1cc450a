"""Type inference over text columns: the type that four fifths of a sample agree on.

Values that don't conform become null. Blanks don't vote. The vote is one aggregation over the
first ``sample`` rows, or over all with None; the casts run in the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that count as booleans in the vote, and those that are read as such.
TRUE_VOTE, FALSE_VOTE = ("true", "yes"), ("false", "no")
TRUE_READ, FALSE_READ = ("true", "yes", "1"), ("false", "no", "0")
SHARE = 0.8


def blank(c: Column) -> Column:
    """Trimmed text, null where nothing is left."""
    return F.nullif(F.trim(c), F.lit(""))


def read(c: Column, kind: str) -> Column:
    """A trimmed text as bool, int64, float64 or string; null where it doesn't conform."""
    if kind == "bool":
        low = F.lower(c)
        return F.when(low.isin(list(TRUE_READ)), True).when(low.isin(list(FALSE_READ)), False)
    if kind == "int64":
        return F.when(c.rlike(r"\A[+-]?[0-9]+\z"), c.try_cast("bigint"))
    if kind == "float64":
        return F.when(~c.rlike(r"[dDfFlL]\z") | c.rlike(r"(?i)\A[+-]?inf\z"), c.try_cast("double"))
    return c


def vote(df: DataFrame, columns: Sequence[str], sample: int | None = 100) -> dict[str, str]:
    """The type of each text column; string where no other has four fifths of the votes."""
    aggs = []
    for i, name in enumerate(columns):
        c = blank(F.col(f"`{name}`"))
        low = F.lower(c)
        aggs += [
            F.count(c).alias(f"n{i}"),
            F.count_if(low.isin([*TRUE_VOTE, *FALSE_VOTE])).alias(f"b{i}"),
            F.count(read(c, "int64")).alias(f"i{i}"),
            F.count(read(c, "float64")).alias(f"f{i}"),
        ]
    if not aggs:
        return {}
    row = (df if sample is None else df.limit(sample)).agg(*aggs).first()
    kinds = {}
    for i, name in enumerate(columns):
        n = row[f"n{i}"]
        kinds[name] = "string"
        for kind, votes in (("bool", row[f"b{i}"]), ("int64", row[f"i{i}"]), ("float64", row[f"f{i}"])):
            if n and votes >= SHARE * n:
                kinds[name] = kind
                break
    return kinds


def typed(df: DataFrame, sample: int | None = 100, kinds: dict[str, str] | None = None) -> DataFrame:
    """All columns of a frame of text, with voted types (or the given ones)."""
    kinds = kinds if kinds is not None else vote(df, df.columns, sample)
    return df.select(*[read(blank(F.col(f"`{c}`")), kinds.get(c, "string")).alias(c) for c in df.columns])
