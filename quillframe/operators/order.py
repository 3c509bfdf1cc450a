"""Row order at scale.

Spark's frames have no order, so ordered operators take their order keys. A window without
partition keys would bring all rows into one task; instead rows are dealt into buckets that
follow the order of all keys. Buckets are windows of their own, and what they need from earlier
ones is one row each, worked out from one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows for each bucket, most buckets, and rows of the sample for each bucket.
BUCKET_ROWS, BUCKETS, SAMPLED = 1 << 20, 4096, 32
INDEX, BUCKET = "__idx", "__bucket"


def keys_of(order_by: str | Sequence[str]) -> list[str]:
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    if not keys:
        raise ValueError("an ordered operator needs order keys")
    return keys


def window(order_by: str | Sequence[str], partition_by: Sequence[str] = (), backwards: bool = False) -> WindowSpec:
    """A window in ascending order, nulls first, or in the order back."""
    spec = Window.partitionBy(*partition_by) if partition_by else Window.partitionBy(F.lit(0))
    return spec.orderBy(*[F.col(k).desc_nulls_last() if backwards else F.col(k).asc_nulls_first() for k in keys_of(order_by)])


def cut_keys(df: DataFrame, keys: Sequence[str], buckets: int, n: int) -> Column | None:
    """At most ``buckets`` - 1 keys, sorted, that cut ``df`` of ``n`` rows into parts of about the same size, as a literal array.

    They come from a sample of rows, of a size that the number of buckets bounds.
    """
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("k")
    sample = df.select(key).where(F.rand(17) < min(1.0, SAMPLED * buckets / max(n, 1)))
    at = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: F.floor(i * F.size("s") / buckets).cast("int"))
    cuts = sample.agg(F.array_sort(F.collect_list("k")).alias("s")).select(F.array_distinct(F.transform(F.filter(F.array_distinct(at), lambda i: i < F.size("s")), lambda i: F.get("s", i))).alias("cuts"))
    rows = cuts.first()["cuts"]  # one for each bucket at most
    kinds = [df.schema[k].dataType for k in keys]
    return F.array(*[F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(r, kinds))]) for r in rows]) if rows else None


def place_of(cuts: Column, keys: Sequence[str]) -> Column:
    """How many of the sorted ``cuts`` aren't above the keys, by binary search."""
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    steps = [1 << k for k in reversed(range(BUCKETS.bit_length()))]
    fits = lambda at: (at <= F.size(cuts)) & (F.get(cuts, at - 1) <= key)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(fits(at + step), at + step).otherwise(at))


def bucketed(df: DataFrame, order_by: str | Sequence[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``__bucket``, from 0: buckets follow the order of the keys, with about ``bucket_rows`` rows.

    Rows whose keys are all equal share a bucket; nulls are the smallest values.
    """
    keys = keys_of(order_by)
    n = df.count()
    buckets = min(BUCKETS, -(-n // bucket_rows))
    cuts = cut_keys(df, keys, buckets, n) if buckets > 1 else None
    if cuts is None:
        return df.withColumn(BUCKET, F.lit(0))
    return df.withColumn(BUCKET, place_of(cuts, keys))


def indexed(df: DataFrame, order_by: str | Sequence[str], name: str = INDEX, start: int = 0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with the position of each row as a long, from ``start``."""
    dealt = bucketed(df, order_by, bucket_rows)
    counts = dealt.groupBy(BUCKET).count()
    offset = counts.select(BUCKET, (F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy(BUCKET)) - F.col("count")).alias("__offset"))
    numbered = dealt.withColumn("__row", F.row_number().over(window(order_by, [BUCKET])))
    joined = numbered.join(F.broadcast(offset), BUCKET)  # at most BUCKETS rows
    return joined.withColumn(name, F.col("__row") + F.col("__offset") - 1 + F.lit(start).cast("long")).drop("__row", "__offset", BUCKET)


def with_halo(df: DataFrame, before: int, after: int = 0, index: str = INDEX, block: int = BUCKET_ROWS) -> DataFrame:
    """``df`` in blocks of rows with consecutive positions; ``__halo`` marks rows lent to a neighbour.

    A block also holds the ``before`` rows before its first and the ``after`` rows behind its
    last, so that windows of that reach can be worked out in it.
    """
    block = max(block, before, after, 1)
    own = F.floor(F.col(index) / block)
    targets = F.array(own)
    if before:
        targets = F.when(F.col(index) % block >= block - before, F.concat(targets, F.array(own + 1))).otherwise(targets)
    if after:
        targets = F.when(F.col(index) % block < after, F.concat(targets, F.array(own - 1))).otherwise(targets)
    return df.withColumn(BUCKET, F.explode(targets)).withColumn("__halo", F.col(BUCKET) != own)


def reaching(df: DataFrame, order_by: str | Sequence[str], columns: dict[str, object], before: int = 0, after: int = 0, partition_by: Sequence[str] = (), block: int = BUCKET_ROWS) -> DataFrame:
    """Add columns that are functions of a window specification and look at most so many rows around.

    ``columns``: name to a function from the window (partitioned and ordered, without a frame) to
    a column. With partition keys they are the window's; without, blocks of rows are.
    """
    if partition_by:
        spec = window(order_by, partition_by)
        return df.withColumns({k: f(spec) for k, f in columns.items()})
    halo = with_halo(indexed(df, order_by), before, after, block=block)
    spec = window(INDEX, [BUCKET])
    return halo.withColumns({k: f(spec) for k, f in columns.items()}).where("not __halo").drop("__halo", BUCKET, INDEX)


def plus(a: Column, b: Column) -> Column:
    """The sum of two numbers, of which a null counts as nothing."""
    return F.coalesce(a + b, a, b)


def running(df: DataFrame, order_by: str | Sequence[str], columns: dict[str, tuple], partition_by: Sequence[str] = (), backwards: bool = False, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add running aggregates over all rows up to each row (or, ``backwards``, from it on).

    ``columns``: name to (aggregate, merge, combine). ``aggregate`` is an aggregate column, such
    as ``F.sum("x")``; ``merge`` makes the aggregate of several buckets from a column of theirs,
    in order, such as ``F.sum``; ``combine`` joins the value of the buckets before with the
    running one of the row's own bucket, either of which may be null. Without partition keys each
    bucket is worked out by itself, and a window over one row for each bucket says what comes
    before it. A fourth item is another form of ``aggregate`` for rows that come in order.
    Backwards is forwards in the order back, as a frame with an open end is worked out anew for
    every row.
    """
    keys = keys_of(order_by)
    so_far = lambda by: window(keys, by, backwards).rowsBetween(Window.unboundedPreceding, 0)
    if partition_by:
        return df.withColumns({k: c[-1 if len(c) > 3 else 0].over(so_far(partition_by)) for k, c in columns.items()})
    dealt = bucketed(df, keys, bucket_rows)
    out = dealt.withColumns({k: c[-1 if len(c) > 3 else 0].over(so_far([BUCKET])) for k, c in columns.items()})
    totals = dealt.groupBy(BUCKET).agg(*[c[0].alias(f"__t{i}") for i, c in enumerate(columns.values())])
    earlier = Window.partitionBy(F.lit(0)).orderBy(F.desc(BUCKET) if backwards else F.asc(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    past = totals.select(BUCKET, *[c[1](F.col(f"__t{i}")).over(earlier).alias(f"__t{i}") for i, c in enumerate(columns.values())])
    joined = out.join(F.broadcast(past), BUCKET, "left")  # at most BUCKETS rows
    made = {k: c[2](F.col(f"__t{i}"), F.col(k)) for i, (k, c) in enumerate(columns.items())}
    return joined.withColumns(made).drop(*[f"__t{i}" for i in range(len(columns))], BUCKET)
