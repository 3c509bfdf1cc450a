"""Queries on frames, series, expressions, indexes, categoricals, strings and times, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..build import SeriesBuilder, concat, parallel_info, series
from ..frame import Frame
from ..functions import numeric as N
from ..functions import strings as S
from ..functions import temporal as TM
from ..functions import types as TY
from ..functions.categorical import Categorical
from ..index import ListIndex, MultiIndex, RangeIndex, default_index
from ..names import AggFunc, JoinType, ResampleFunc
from ..operators import select as SE
from ..operators import timegroup as TG
from ..operators import window as W
from ..operators.nulls import fill_method
from .catalog import EV, events, query, t
from .expr import col, lit
from .lazy import LazyFrame


def _frame(spark: SparkSession, d: str, name: str, *order: str) -> Frame:
    return Frame(t(spark, d, name), order)


def _rows(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    """A few results that a method gave the program, as a frame."""
    return spark.createDataFrame(list(rows), schema)


# series


@query(f"""SELECT count(*) AS n, count(*) - count(v) AS nulls, round(sum(v), 4) AS s, round(avg(v), 6) AS m, round(stddev_pop(v), 6) AS sd, round(quantile_cont(v, 0.5), 6) AS md, round(quantile_cont(v, 0.9), 6) AS q, count(DISTINCT v) AS u,
round(avg(power(v - a, 3)) / power(avg(power(v - a, 2)), 1.5), 6) AS sk, round(kurtosis_pop(v), 6) AS k, round(covar_pop(v, user_id), 5) AS c FROM {EV}, (SELECT avg(v) AS a FROM {EV})""")
def series_reductions(spark, d):
    f = Frame(events(spark, d), ("event_id",))
    v = f["v"]
    return _rows(spark, "n long, nulls long, s double, m double, sd double, md double, q double, u long, sk double, k double, c double", (len(v), v.null_count(), round(v.sum(), 4), round(v.mean(), 6), round(v.std(), 6), round(v.median(), 6), round(v.quantile(0.9), 6), v.nunique(), round(v.skew(), 6), round(v.kurt(), 6), round(v.cov(f["user_id"]), 5)))


@query(f"""SELECT event_id, v = 50 AS e, v <> 50 AS ne, v < user_id AS l, v <= user_id AS le, v >= 30 AS g, v > user_id AS gt, v = user_id AS es, fmod(v, 7) AS m, CASE WHEN v IS NOT NULL THEN NOT (v > 30) END AS n, v IS NULL AS nu, v IS NOT NULL AS nn, v / 4 AS d FROM {EV}""")
def series_comparisons(spark, d):
    f = Frame(events(spark, d), ("event_id",))
    v, u = f["v"], f["user_id"]
    made = {"e": v.eq(50), "ne": v.ne(50), "l": v.lt(u), "le": v.le(u), "g": v.ge(30), "gt": v.gt(u), "es": v.eq(u), "m": v % 7, "n": ~v.gt(30), "nu": v.is_null(), "nn": v.not_null(), "d": v / 4}
    return f.df.select("event_id", *[s.column.alias(k) for k, s in made.items()])


@query("""SELECT 'head' AS part, p_name FROM (SELECT p_name FROM part ORDER BY p_partkey LIMIT 5) UNION ALL SELECT 'tail', p_name FROM (SELECT p_name FROM part ORDER BY p_partkey DESC LIMIT 5)
UNION ALL SELECT 'slice', p_name FROM (SELECT p_name FROM part ORDER BY p_partkey LIMIT 7 OFFSET 3) UNION ALL SELECT 'take', p_name FROM (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part) WHERE k IN (1, 8)
UNION ALL SELECT 'filter', p_name FROM part WHERE p_size > 25""")
def series_parts(spark, d):
    f = _frame(spark, d, "part", "p_partkey")
    s = f["p_name"].copy()
    parts = {"head": s.head(5), "tail": s.tail(5), "slice": s.slice(3, 10), "take": s.take([8, 1]), "filter": s.filter(f["p_size"].gt(25)).data()}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("part"), "p_name")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT (row_number() OVER (ORDER BY o_orderkey) - 1)::VARCHAR AS index FROM orders")
def series_index(spark, d):
    return _frame(spark, d, "orders", "o_orderkey")["o_custkey"].index()


@query("SELECT event_id, ewm::FLOAT AS w FROM (WITH RECURSIVE o AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) AS k FROM events), e AS (SELECT k, event_id, value AS ewm FROM o WHERE k = 1 UNION ALL SELECT o.k, o.event_id, 0.5 * o.value + 0.5 * e.ewm FROM e JOIN o ON o.k = e.k + 1) SELECT * FROM e)")
def ewm_span(spark, d):
    return W.ewm_mean(t(spark, d, "events").select("event_id", "value"), "value", ["event_id"], span=3, name="w").select("event_id", F.col("w").cast("float").alias("w"))


@query(f"SELECT event_id, (CASE WHEN count(v) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) >= 5 THEN sum(v) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) END)::FLOAT AS w FROM {EV}")
def expanding_periods(spark, d):
    s = Frame(events(spark, d), ("event_id",))["v"].expanding(5).sum()
    return s.frame.df.select("event_id", s.column.cast("float").alias("w"))


@query(f"SELECT event_id, user_id, event_type, coalesce(v, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)) AS v FROM {EV}")
def fill_by_method(spark, d):
    return fill_method(events(spark, d).drop("ts"), "ffill", ["event_id"])


@query("SELECT DISTINCT ON (user_id) user_id, event_id FROM events ORDER BY user_id, event_id")
def series_distinct(spark, d):
    s = _frame(spark, d, "events", "event_id")["user_id"].drop_duplicates()
    return s.frame.df.select(s.column.alias("user_id"), "event_id")


@query("SELECT event_id, user_id::VARCHAR || '!' AS a, value > 50 AS b FROM events")
def series_functions(spark, d):
    f = _frame(spark, d, "events", "event_id")
    big = Frame(f.df.withColumn("big", F.col("value") > 50), ("event_id",))
    return big.df.select("event_id", big["user_id"].apply(lambda v: f"{v}!").column.alias("a"), (~big["big"].map_bool(lambda x: not x)).column.alias("b"))


@query("SELECT string_agg(n_name, ', ' ORDER BY n_nationkey) AS names FROM nation")
def series_cat(spark, d):
    return _rows(spark, "names string", (_frame(spark, d, "nation", "n_nationkey")["n_name"].cat(", "),))


@query("SELECT 3 AS labels, 'n_name: string' AS shown, n_name AS third, 'inner mean sum' AS names FROM nation WHERE n_nationkey = 2")
def series_values(spark, d):
    f = _frame(spark, d, "nation", "n_nationkey")
    text = f["n_name"].display(2, 1)
    few = f.filter(f["n_nationkey"].lt(3))["n_nationkey"].labels()
    return _rows(spark, "labels int, shown string, third string, names string", (len(few), text.splitlines()[-1], f["n_name"].at(2), f"{JoinType.INNER} {AggFunc.MEAN} {ResampleFunc.SUM}"))


# expressions


@query("""SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_extendedprice / l_quantity AS d, fmod(l_extendedprice, 10) AS m, -l_tax AS n, abs(l_discount - 0.05) AS ab, l_returnflag <> 'R' AS ne, l_quantity < 10 AS lt, l_quantity <= 10 AS le, l_quantity >= 40 AS ge,
l_quantity < 5 OR l_linestatus = 'O' AS o, NOT (l_quantity < 5) AS nt, false AS nu, true AS nn, l_tax::DOUBLE AS f, l_quantity::VARCHAR AS s, least(greatest(l_quantity, 10), 20) AS c, sqrt(l_quantity) AS ap, l_discount * 2 AS twice FROM lineitem""")
def expressions(spark, d):
    q, p, x, g = col("l_quantity"), col("l_extendedprice"), col("l_discount"), col("l_returnflag")
    made = {"a": q + 1, "d": p / q, "m": p % 10, "n": -col("l_tax"), "ab": (x - 0.05).abs(), "ne": g != "R", "lt": q < 10, "le": q <= 10, "ge": q >= 40, "o": (q < 5) | (col("l_linestatus") == "O"), "nt": ~(q < 5), "nu": p.is_null(), "nn": p.is_not_null(), "f": col("l_tax").fill_na(0), "s": q.cast("string"), "c": q.clip(10, 20), "ap": q.apply(F.sqrt), "twice": x * 2}
    return LazyFrame(t(spark, d, "lineitem")).select(col("l_orderkey"), col("l_linenumber"), *[e.alias(k) for k, e in made.items()]).collect()


@query(f"SELECT min(v) AS v_min, max(v) AS v_max, count(v) AS v_count, round(stddev_pop(v), 6) AS sd, quantile_cont(v, 0.5) AS v_median, arg_min(v, event_id) FILTER (v IS NOT NULL) AS v_first, arg_max(v, event_id) FILTER (v IS NOT NULL) AS v_last FROM {EV}")
def expression_aggregates(spark, d):
    v = col("v")
    out = LazyFrame(events(spark, d), ["event_id"]).select(v.min(), v.max(), v.count(), v.std(), v.median(), v.first(), v.last()).collect()
    return out.withColumn("sd", F.round("v_std", 6)).drop("v_std")


@query("SELECT p_partkey, contains(p_type, 'STEEL') AS c, replace(p_type, ' ', '-') AS r, upper(p_name) AS u, lower(p_type) AS l, p_size::DOUBLE AS one FROM part")
def expression_strings(spark, d):
    y = col("p_type")
    return LazyFrame(t(spark, d, "part")).select(col("p_partkey"), y.str_contains("STEEL").alias("c"), y.str_replace(" ", "-").alias("r"), col("p_name").str_upper().alias("u"), y.str_lower().alias("l"), (col("p_size") + lit(0)).alias("one")).collect()


@query("SELECT o_orderkey, o_totalprice, (SELECT max(o_totalprice) FROM orders) AS o_totalprice_max FROM orders")
def lazy_mixed(spark, d):
    return LazyFrame(t(spark, d, "orders")).select(col("o_orderkey"), col("o_totalprice"), col("o_totalprice").max()).collect()


@query("SELECT '(a + 1) as b' AS text, true AS filtered")
def plan_texts(spark, d):
    plan = LazyFrame(t(spark, d, "orders")).filter(col("o_totalprice") > 10).describe()
    return _rows(spark, "text string, filtered boolean", (repr((col("a") + 1).alias("b")), "Filter" in plan))


# strings


@query(r"""SELECT c_custkey, trim(s, E' \t\n\r') AS st, ltrim(s, E' \t\n\r') AS ls, rtrim(s, E' \t\n\r') AS rs, regexp_replace(c_name, '[0-9]+', '<>', 'g') AS rr, rpad(c_mktsegment, 12, '.') AS pr, lpad(c_mktsegment, 12, ' ') AS pl,
upper(substr(low, 1, 1)) || substr(low, 2) || ' ' || upper(substr(low, 1, 1)) || substr(low, 2) AS ti, true AS nu, regexp_full_match(c_mktsegment, '[A-Za-z]+') AS al FROM (SELECT *, E' \t' || c_name || E' \n' AS s, lower(c_mktsegment) AS low FROM customer)""")
def strings_edges(spark, d):
    s, g, n = F.concat(F.lit(" \t"), F.col("c_name"), F.lit(" \n")), F.col("c_mktsegment"), F.col("c_name")
    two = F.concat(F.lower(g), F.lit(" "), F.lower(g))
    return t(spark, d, "customer").select("c_custkey", S.strip(s).alias("st"), S.lstrip(s).alias("ls"), S.rstrip(s).alias("rs"), S.replace_regex(n, "[0-9]+", "<>").alias("rr"), S.pad(g, 12, ".", "right").alias("pr"), S.pad(g, 12).alias("pl"), S.title(two).alias("ti"), S.is_numeric(F.col("c_acctbal")).alias("nu"), S.is_alpha(g).alias("al"))


@query("SELECT p_partkey, upper(p_name) AS u, strlen(p_brand) AS n FROM part")
def string_accessor(spark, d):
    f = _frame(spark, d, "part", "p_partkey")
    return f.df.select("p_partkey", f["p_name"].str.upper().column.alias("u"), f["p_brand"].str.length().column.alias("n"))


# time


@query("SELECT event_id, ts - INTERVAL 9 HOURS AS l, ts + INTERVAL 9 HOURS AS c, year(ts) AS y FROM events")
def time_zones(spark, d):
    f = _frame(spark, d, "events", "event_id")
    return f.df.select("event_id", TM.localize(F.col("ts"), "Asia/Tokyo").alias("l"), TM.convert(F.col("ts"), "Asia/Tokyo").alias("c"), f["ts"].dt.year().column.alias("y"))


@query("SELECT TIMESTAMP '2024-02-27' + i * INTERVAL 1 DAY AS ts FROM range(5) r(i)")
def date_range_ends(spark, d):
    return TG.date_range_end(spark, dt.datetime(2024, 2, 27), dt.datetime(2024, 3, 2, 12), TM.nanos(days=1))


@query("""WITH e AS (SELECT event_id, ts, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS d, event_id * 1000000000 AS s FROM events)
SELECT event_id, d + s AS p, d - s AS m, s * 3 AS x3, s // 4 AS q, d / s::DOUBLE AS r, s > d AS af, s < d AS be, d / 3600e9 AS h, d / 60e9 AS mi, d / 1e9 AS se, d / 1e6 AS ms, (event_id * 1500000000)::BIGINT AS fu, event_id * 1000 AS fn, ts + event_id * INTERVAL 1 SECOND AS ad,
(s // 1000000000 // 86400)::VARCHAR || 'd' || (s // 1000000000 // 3600 % 24)::VARCHAR || 'h' || (s // 1000000000 // 60 % 60)::VARCHAR || 'm' || (s // 1000000000 % 60)::VARCHAR || 's' AS fo FROM e WHERE event_id > 0""")
def durations(spark, d):
    since = TM.difference(F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz"))
    rows = t(spark, d, "events").where("event_id > 0").select("event_id", "ts", since.alias("d"), (F.col("event_id") * 1_000_000_000).alias("s"))
    f = Frame(rows, ("event_id",))
    x, s = F.col("d"), F.col("s")
    units = {"h": "hours", "mi": "minutes", "se": "seconds", "ms": "milliseconds"}
    return rows.select(
        "event_id", TM.plus(x, s).alias("p"), TM.minus(x, s).alias("m"), TM.scaled(s, 3).alias("x3"), TM.divided(s, 4).alias("q"), TM.ratio(x, s).alias("r"), TM.after(s, x).alias("af"), TM.before(s, x).alias("be"),
        *[f["d"].duration.to_unit(u).column.alias(k) for k, u in units.items()], TM.from_unit(F.col("event_id") * 1.5, "seconds").alias("fu"), TM.from_unit(F.col("event_id"), "microseconds").alias("fn"), TM.shift(F.col("ts"), s).alias("ad"), TM.format_duration(s).alias("fo"),
    )


@query("SELECT time_bucket(INTERVAL 1 DAY, ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY AS ts, max(value) AS value FROM events GROUP BY 1")
def resample_rule(spark, d):
    return TG.ResampleRule(TM.nanos(days=1), "max", "right", "right").apply(t(spark, d, "events").select("ts", "value"), "ts")


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts) AS ts, count(value)::DOUBLE AS value FROM events GROUP BY 1")
def resample_frame(spark, d):
    return Frame(t(spark, d, "events").select("ts", "value"), ("ts",)).resample("ts", TM.nanos(hours=6), "count")


@query("SELECT 'Dynamic(time=ts, period=3600000000000ns, every=7200000000000ns, closed=left, label=left, by=[''user_id''])' AS info")
def dynamic_info(spark, d):
    return _rows(spark, "info string", (Frame(t(spark, d, "events")).group_by_dynamic("ts", TM.nanos(hours=1), TM.nanos(hours=2)).by("user_id").info(),))


# frames


@query("SELECT 'rows' AS what, count(*)::VARCHAR AS value FROM orders UNION ALL VALUES ('shape', '6'), ('o_orderkey', 'int64'), ('o_custkey', 'int64'), ('o_orderstatus', 'string'), ('o_totalprice', 'float64'), ('o_orderdate', 'timestamp'), ('o_orderpriority', 'string')")
def frame_metadata(spark, d):
    f = _frame(spark, d, "orders", "o_orderkey")
    return _rows(spark, "what string, value string", ("rows", str(len(f))), ("shape", str(f.shape()[1])), *f.dtypes().items())


@query("SELECT c, b::BIGINT AS bytes FROM (SELECT count(*) AS n FROM customer), LATERAL (VALUES ('c_custkey', 8 * n), ('c_name', 32 * n), ('c_nationkey', 4 * n), ('c_acctbal', 8 * n), ('c_mktsegment', 32 * n)) v(c, b)")
def memory_usage(spark, d):
    return _rows(spark, "c string, bytes long", *_frame(spark, d, "customer").memory_usage().items())


@query("SELECT n_nationkey AS key, n_name FROM nation WHERE n_nationkey > 2")
def drop_and_rename(spark, d):
    f = _frame(spark, d, "nation").drop("n_regionkey").rename({"n_nationkey": "key"}).pipe(lambda x: x.filter(x["key"].gt(2)))
    return f.df.select("key", "n_name")


@query("SELECT n_nationkey, CASE WHEN n_regionkey > 1 THEN n_name END AS w, CASE WHEN n_regionkey > 1 THEN 'x' ELSE n_name END AS m FROM nation")
def frame_where_mask(spark, d):
    f = Frame(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ("n_nationkey",))
    c = f["n_regionkey"].gt(1)
    w = f.where(c).df.select("n_nationkey", F.col("n_name").alias("w"))
    return w.join(f.mask(c, "x").df.select("n_nationkey", F.col("n_name").alias("m")), "n_nationkey")


@query("SELECT variable, value FROM (SELECT p_size::DOUBLE AS p_size, p_retailprice FROM part) UNPIVOT (value FOR variable IN (p_size, p_retailprice))")
def stack(spark, d):
    return Frame(t(spark, d, "part").select("p_size", "p_retailprice")).stack()


@query("SELECT p_partkey, p_size::BIGINT AS a, p_retailprice AS b, p_name AS c FROM part")
def convert_dtypes(spark, d):
    rows = t(spark, d, "part").select("p_partkey", F.col("p_size").cast("string").alias("a"), F.col("p_retailprice").cast("string").alias("b"), F.col("p_name").alias("c"))
    return Frame(rows, ("p_partkey",)).convert_dtypes().df


@query("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS l_quantity, l_tax * 2 AS l_tax FROM lineitem")
def transform_columns(spark, d):
    f = Frame(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax"), ("l_orderkey", "l_linenumber"))
    return f.parallel_transform(lambda c: c * 2).df


@query("SELECT n_nationkey, upper(n_name) AS n_name FROM nation")
def apply_columns(spark, d):
    return Frame(t(spark, d, "nation").select("n_nationkey", "n_name"), ("n_nationkey",)).parallel_apply_cols(F.upper).df


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def concat_frames(spark, d):
    f = Frame(t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), ("o_orderkey",))
    one = f.parallel_filter(f["o_totalprice"].gt(100000) & f["o_orderstatus"].eq("O"))
    return concat([one.select("o_custkey"), f.filter(F.col("o_orderstatus") == "P").select("o_custkey")]).df.select("o_orderkey", "o_custkey")


@query("SELECT event_id, user_id, coalesce(v, 0) AS v FROM (SELECT event_id, CASE WHEN user_id % 5 <> 0 THEN user_id END AS user_id, v FROM {0}) WHERE user_id IS NOT NULL".format(EV))
def frame_nulls(spark, d):
    rows = events(spark, d).select("event_id", F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("user_id"), "v")
    filled = Frame(rows.select("event_id", "v"), ("event_id",)).parallel_fill_na(0.0).df
    return Frame(rows.drop("v").join(filled, "event_id"), ("event_id",)).parallel_drop_na().df


@query("SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")
def frame_sort(spark, d):
    return Frame(t(spark, d, "nation").select("n_name", "n_regionkey")).order_by("n_name").sort_by(["n_regionkey"], [False])


@query("SELECT true AS shown")
def display(spark, d):
    text = _frame(spark, d, "nation", "n_nationkey").display(2, 1)
    return _rows(spark, "shown boolean", ("25 rows × " in text and "..." in text and "│" in text,))


@query("SELECT true AS tasks")
def parallelism(spark, d):
    return _rows(spark, "tasks boolean", (parallel_info(spark) == f"{spark.sparkContext.defaultParallelism} tasks at a time",))


# builders, types, indexes


@query("SELECT * FROM (VALUES ('a', 1, 1.5::DOUBLE, true, 'x', TIMESTAMP '2024-01-01'), ('b', NULL, NULL, NULL, NULL, NULL), ('c', 3, 2.0::DOUBLE, false, 'z', TIMESTAMP '2024-01-03')) v(label, i, f, b, s, w)")
def builders(spark, d):
    made = {"i": ("int64", [1, None, 3]), "f": ("float64", [1.5, None, 2]), "b": ("bool", [True, None, False]), "s": ("string", ["x", None, "z"]), "w": ("timestamp", [dt.datetime(2024, 1, 1), None, dt.datetime(2024, 1, 3)])}
    out = None
    for name, (kind, values) in made.items():
        builder = SeriesBuilder(name, kind).set_index("abc")
        for v in values:
            builder = builder.append_null() if v is None else builder.append(v)
        built = builder.build(spark)
        part = built.frame.df.select(F.col("index").alias("label"), built.column.alias(name))
        out = part if out is None else out.join(part, "label")
    return out


@query("SELECT * FROM (VALUES (1), (NULL), (3)) v(x)")
def series_with_nulls(spark, d):
    return series(spark, "x", [1, 2, 3], "int64", [True, False, True]).data()


_PAIRS = [("int8", "int64", "int64"), ("uint8", "int8", "int16"), ("int32", "float32", "float64"), ("float32", "int16", "float32"), ("uint16", "uint32", "uint32"), ("string", "int64", "float64"), ("bool", "bool", "bool")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {str(a.startswith(('int', 'uint'))).lower()}, {str(a.startswith('float')).lower()}, {str(a.startswith(('int', 'uint', 'float'))).lower()}, {str(a.startswith('int')).lower()})" for a, b, c in _PAIRS) + ") v(a, b, p, i, f, n, s)")
def type_rules(spark, d):
    return _rows(spark, "a string, b string, p string, i boolean, f boolean, n boolean, s boolean", *[(TY.from_spark(TY.to_spark(a)) if not a.startswith("u") else a, b, TY.promote(a, b), TY.is_integer(a), TY.is_float(a), TY.is_numeric(a), TY.is_signed(a)) for a, b, _ in _PAIRS])


@query("""SELECT * FROM (VALUES ('range', 0, '3'), ('range', 1, '4'), ('range', 2, '5'), ('default', 0, '0'), ('default', 1, '1'), ('int', 0, '7'), ('int', 1, '9'), ('text', 0, 'b'), ('time', 0, '2024-01-02T03:04:05Z'), ('many', 0, 'a/x'), ('many', 1, 'b/y')) v(kind, place, label)""")
def indexes(spark, d):
    many = MultiIndex.from_codes([["a", "b"], ["x", "y"]], [[0, 1], [0, 1]], ["one", "two"])
    made = {"range": RangeIndex(1, 9).slice(2, 5).copy(), "default": default_index(2), "int": ListIndex.of_int([7, 9]), "text": ListIndex.of_string(["a", "b", "c"]).slice(1, 2), "time": ListIndex.of_time([dt.datetime(2024, 1, 2, 3, 4, 5)]), "many": many.to_index()}
    return _rows(spark, "kind string, place int, label string", *[(k, i, index.get(i)) for k, index in made.items() for i in range(len(index))])


@query("SELECT * FROM (VALUES ('int64', 4, 'one,two', 'b', 'x,y,x', '0,2', 'two,one', 'two', 'one,TWO', 2, 'a y')) v(kind, n, names, label, own, places, swapped, dropped, renamed, part, line)")
def multi_index(spark, d):
    m = MultiIndex.from_tuples([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], ["one", "two"])
    first = m.slice(0, 3)
    return _rows(spark, "kind string, n int, names string, label string, own string, places string, swapped string, dropped string, renamed string, part int, line string", (RangeIndex(0, 2).dtype, len(m), ",".join(m.names), m.get_level(0, 2), ",".join(first.level_values(1)), ",".join(map(str, first.xs(1, "x"))), ",".join(m.swap_level(0, 1).names), ",".join(m.drop_level(0).names), ",".join(m.rename_level(1, "TWO").names), m.n_levels, str(m).split("\n")[2]))


@query("SELECT 'a/' || n_regionkey::VARCHAR AS index FROM nation")
def index_labels(spark, d):
    f = Frame(t(spark, d, "nation").withColumn("g", F.lit("a")), ("n_nationkey",)).set_multi_index("n_regionkey", "g")
    return f.swap_level(0, 1).index_labels()


@query("SELECT n_name, n_regionkey::VARCHAR AS region FROM nation WHERE n_regionkey = 2")
def frame_levels(spark, d):
    f = Frame(t(spark, d, "nation").withColumn("g", F.lit("a")), ("n_nationkey",)).set_multi_index("g", "n_regionkey")
    return f.rename_level(1, "region").drop_level(0).xs(0, "2").df.select("n_name", "region")


@query("SELECT n_regionkey::VARCHAR AS n_regionkey FROM nation")
def level_values(spark, d):
    return _frame(spark, d, "nation", "n_nationkey").set_multi_index("n_regionkey", "n_name").level_values(0)


# categoricals


@query("""SELECT c_custkey, array_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS code, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 END AS other, c_mktsegment IN ('BUILDING') AS chosen,
array_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment) - 1 AS more, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS less, c_mktsegment = 'BUILDING' AS gone FROM customer""")
def categorical_codes(spark, d):
    c = Categorical.of(t(spark, d, "customer"), "c_mktsegment", ordered=True)
    few = c.remove(["BUILDING"])
    return c.frame.select("c_custkey", c.codes().alias("code"), c.reorder(["MACHINERY", "BUILDING"]).codes().alias("other"), c.is_in(["BUILDING"]).alias("chosen"), c.add(["NEW"]).codes().alias("more"), few.value().alias("less"), few.is_null().alias("gone"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) AS place FROM customer")
def categorical_sort(spark, d):
    c = Categorical.of(t(spark, d, "customer"), "c_mktsegment", ordered=True)
    done = c.sort(False, ["c_custkey"]).select("c_custkey", F.monotonically_increasing_id().alias("__at"))
    return SE.row_number(done, ["__at"], [], "place").select("c_custkey", F.col("place").cast("long").alias("place"))


@query("SELECT 'c_mktsegment' AS name, 'category' AS kind, 5 AS n, true AS ordered, 0::BIGINT AS nulls, 1 AS code, -1 AS none, 'Categorical(c_mktsegment: AUTOMOBILE < BUILDING < FURNITURE < HOUSEHOLD < MACHINERY)' AS text")
def categorical_metadata(spark, d):
    c = Categorical.of(t(spark, d, "customer"), "c_mktsegment", ordered=True)
    return _rows(spark, "name string, kind string, n int, ordered boolean, nulls long, code int, none int, text string", (c.column, c.dtype, len(c), c.ordered, c.null_count(), c.code("BUILDING"), c.code("?"), str(c)))


@query("SELECT event_id, round(value, 2) AS r, CASE WHEN value > 50 THEN value ELSE 0.0 END AS w FROM events")
def with_columns(spark, d):
    f = _frame(spark, d, "events", "event_id")
    return f.with_column("r", F.round("value", 2)).with_column("w", N.where(F.col("value"), F.col("value") > 50, 0.0)).df.select("event_id", "r", "w")
