"""Concatenation, pivots, melts, bins and other changes of shape."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import numeric_columns
from .agg import aggregate
from .order import indexed, keys_of
from .stats import quantiles


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """One below the other, with the columns of the first; a missing column is an error."""
    first, *others = frames
    out = first
    for f in others:
        out = out.unionByName(f.select(*first.columns))
    return out


def concat_columns(frames: Sequence[DataFrame], order_by: Sequence[Sequence[str]]) -> DataFrame:
    """Side by side, row by row in each frame's own order; shorter frames end in nulls."""
    out = None
    for f, keys in zip(frames, order_by):
        part = indexed(f, keys, "__at")
        if out is None:
            out = part
            continue
        names = {c: c + "_right" for c in part.columns if c != "__at" and c in out.columns}
        part = part.withColumnsRenamed(names)
        out = out.join(part, "__at", "full")
    return out.drop("__at")


def distinct_texts(df: DataFrame, column: str, order_by: Sequence[str] = (), most: int = 10_000) -> list[str]:
    """The distinct values of a column as text, by first appearance or else in order.

    They become columns, so more than ``most`` is an error.
    """
    first = F.min(F.struct(*[F.col(k) for k in keys_of(order_by)])) if order_by else F.min(F.col(column).cast("string"))
    rows = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(first.alias("o")).orderBy("o").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{column} has more than {most} distinct values")
    return [r["v"] for r in rows]


def pivot(df: DataFrame, index: str, columns: str, values: str, order_by: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Long to wide: the index as text, cells as doubles; of several values for a cell the last counts.

    ``names``: the values that become columns; found by first appearance if not given. The empty
    text is no column.
    """
    return pivot_table(df, index, columns, values, "last", order_by, names)


def pivot_table(df: DataFrame, index: str, columns: str, values: str, fn: str, order_by: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """Long to wide with an aggregate; cells without values are null."""
    wanted = [n for n in (names if names is not None else distinct_texts(df, columns, order_by)) if n != ""]
    own = F.col(columns).cast("string")
    cells = [aggregate(fn, F.when(own == n, F.col(values).cast("double")), order_by).cast("double") for n in wanted]
    if fn in ("count", "nunique", "sum"):
        cells = [F.when(F.count(F.when((own == n) & F.col(values).isNotNull(), 1)) > 0, c) for n, c in zip(wanted, cells)]
    return df.groupBy(F.col(index).cast("string").alias(index)).agg(*[c.alias(n) for n, c in zip(wanted, cells)])


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Wide to long: ``variable`` and ``value`` (double); nulls stay. All other columns if no values are named."""
    names = list(values) or [c for c in df.columns if c not in ids]
    wide = df.select(*ids, *[F.col(c).try_cast("double").alias(c) for c in names])
    return wide.unpivot(list(ids), names, "variable", "value")


def stack(df: DataFrame) -> DataFrame:
    return melt(df, [], df.columns)


def unstack(df: DataFrame, levels: Sequence[str], level: int, order_by: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """One level of the index to columns ``{column}_{value}``; the other levels joined by / are ``index``."""
    name = levels[level]
    rest = [c for i, c in enumerate(levels) if i != level]
    wanted = names if names is not None else distinct_texts(df, name, order_by)
    data = [c for c in df.columns if c not in levels and c not in order_by]
    cells = [aggregate("last", F.when(F.col(name).cast("string") == v, F.col(c)), order_by).alias(f"{c}_{v}") for c in data for v in wanted]
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in rest])
    return df.groupBy(key.alias("index")).agg(*cells)


def compare(left: DataFrame, right: DataFrame, order_left: Sequence[str], order_right: Sequence[str], keep_equal: bool = False) -> DataFrame:
    """Row by row the cells that differ, as ``a→b``; equal cells are null, or their text with ``keep_equal``."""
    common = [c for c in left.columns if c in right.columns]
    a = indexed(left, order_left, "__at").select("__at", *[F.col(c).cast("string").alias(f"__a{i}") for i, c in enumerate(common)])
    b = indexed(right, order_right, "__at").select("__at", *[F.col(c).cast("string").alias(f"__b{i}") for i, c in enumerate(common)])
    cells = []
    for i, c in enumerate(common):
        x, y = F.col(f"__a{i}"), F.col(f"__b{i}")
        same = x if keep_equal else F.lit(None).cast("string")
        cells.append(F.when(x.eqNullSafe(y), same).otherwise(F.concat(F.coalesce(x, F.lit("null")), F.lit("→"), F.coalesce(y, F.lit("null")))).alias(c))
    return a.join(b, "__at", "full").orderBy("__at").select(*cells)


def get_dummies(df: DataFrame, columns: Sequence[str], order_by: Sequence[str] = (), names: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Add 0/1 columns ``{column}_{value}`` for each value; null is 0 in all."""
    made = {}
    for c in columns:
        for v in (names or {}).get(c) or distinct_texts(df, c, order_by):
            made[f"{c}_{v}"] = F.coalesce((F.col(c).cast("string") == v).cast("long"), F.lit(0).cast("long"))
    return df.withColumns(made)


def cut_edges(df: DataFrame, column: str, bins: int) -> list[float]:
    row = df.agg(F.min(F.col(column).cast("double")), F.max(F.col(column).cast("double"))).first()
    if row[0] is None:
        return []
    low, high = row
    return [low + (high - low) * k / bins for k in range(bins + 1)]


def cut_code(df: DataFrame, column: str, bins: int) -> Column:
    """The bin of equal width, from 0; the largest value is in the last. Null for null."""
    edges = cut_edges(df, column, bins)
    if not edges:
        return F.lit(None).cast("int")
    low, width = edges[0], (edges[-1] - edges[0]) / bins
    x = F.col(column).cast("double")
    place = F.floor((x - F.lit(low)) / F.lit(width)) if width > 0 else F.lit(0)
    return F.when(x.isNotNull(), F.greatest(F.least(place, F.lit(bins - 1)), F.lit(0))).cast("int")


def _label(low: float, high: float, opening: str) -> str:
    return f"{opening}{low:g},{high:g}]"


def cut(df: DataFrame, column: str, bins: int, name: str | None = None) -> DataFrame:
    """Add the bin of equal width as a label ``(low,high]``."""
    edges = cut_edges(df, column, bins)
    code = cut_code(df, column, bins)
    labels = F.array(*[F.lit(_label(a, b, "(")) for a, b in zip(edges, edges[1:])]) if edges else F.array().cast("array<string>")
    return df.withColumn(name or f"{column}_cut", F.get(labels, code))


def qcut_edges(df: DataFrame, column: str, q: int) -> list[float]:
    """The quantiles 0, 1/q, .., 1, exact."""
    got = quantiles(df, {column: [k / q for k in range(q + 1)]})[column]
    return [] if got[0] != got[0] else got


def qcut_code(df: DataFrame, column: str, q: int) -> Column:
    """The first quantile bin whose upper edge isn't below the value, from 0; null for null."""
    edges = qcut_edges(df, column, q)
    x = F.col(column).cast("double")
    code = F.lit(None).cast("int")
    for k in range(q, 0, -1):
        code = F.when(x <= F.lit(edges[k]), F.lit(k - 1)).otherwise(code) if edges else code
    return code.cast("int")


def qcut(df: DataFrame, column: str, q: int, name: str | None = None) -> DataFrame:
    """Add the quantile bin as a label ``[low,high]``."""
    edges = qcut_edges(df, column, q)
    labels = F.array(*[F.lit(_label(a, b, "[")) for a, b in zip(edges, edges[1:])]) if edges else F.array().cast("array<string>")
    return df.withColumn(name or f"{column}_qcut", F.get(labels, qcut_code(df, column, q)))


def explode_text(df: DataFrame, column: str, separator: str, place: str | None = None) -> DataFrame:
    """One row for each part of a text, trimmed; null and empty texts, and empty parts, give a null row."""
    parts = F.split(F.col(column).cast("string"), r"\Q" + separator + r"\E", -1)
    parts = F.when(F.col(column).isNull(), F.array(F.lit(None).cast("string"))).otherwise(parts)
    spread = df.select(*[c for c in df.columns if c != column], F.posexplode(parts).alias(place or "__place", column))
    out = spread.withColumn(column, F.nullif(F.trim(column), F.lit("")))
    return out if place else out.drop("__place")


def convert_dtypes(df: DataFrame) -> DataFrame:
    """Text columns all of whose values are integers become longs, all numbers doubles; a column of nulls becomes a long."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not texts:
        return df
    checks = []
    for i, c in enumerate(texts):
        bare = F.trim(c)
        checks += [F.bool_and(bare.rlike(r"\A[+-]?[0-9]+\z") & bare.try_cast("bigint").isNotNull()).alias(f"i{i}"), F.bool_and(bare.try_cast("double").isNotNull()).alias(f"f{i}"), F.count(c).alias(f"n{i}")]
    row = df.agg(*checks).first()
    kinds = {}
    for i, c in enumerate(texts):
        if row[f"n{i}"] == 0 or row[f"i{i}"]:
            kinds[c] = "bigint"
        elif row[f"f{i}"]:
            kinds[c] = "double"
    return df.withColumns({c: F.trim(c).try_cast(k) for c, k in kinds.items()}) if kinds else df


def transform_columns(df: DataFrame, fn) -> DataFrame:
    """``fn`` from column to column over all numeric columns."""
    return df.withColumns({c: fn(F.col(c).cast("double")) for c in numeric_columns(df.schema)})
