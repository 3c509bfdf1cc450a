"""One query for each operator, with the DuckDB SQL that gives the same rows.

``QUERIES`` maps a name to a function of (spark, sf_dir), ``ORACLES`` to SQL over the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame
from ..functions import numeric as N
from ..functions import strings as S
from ..functions import temporal as TM
from ..functions.categorical import Categorical
from ..operators import agg as A
from ..operators import join as J
from ..operators import nulls as NU
from ..operators import reshape as R
from ..operators import select as SE
from ..operators import stats as ST
from ..operators import timegroup as TG
from ..operators import window as W
from ..operators.order import indexed
from .expr import col, lit
from .lazy import LazyFrame
from .sql import SQLContext

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events with a value that is null in every third row."""
    return t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))


EV = "(SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 3 <> 0 THEN value END AS v FROM events)"


# aggregation


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, avg(l_extendedprice) AS l_extendedprice_mean, round(stddev_pop(l_discount), 9) AS l_discount_std, quantile_cont(l_quantity, 0.5) AS l_quantity_median,
count(l_orderkey)::DOUBLE AS l_orderkey_count FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    rows = t(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    out = A.agg(rows, ["l_returnflag", "l_linestatus"], [("l_quantity", "sum"), ("l_extendedprice", "mean"), ("l_discount", "std"), ("l_quantity", "median"), ("l_orderkey", "count")])
    return out.withColumn("l_discount_std", F.round("l_discount_std", 9))


@query(f"""SELECT user_id, coalesce(sum(v), 'NaN'::DOUBLE) AS v_sum, coalesce(avg(v), 'NaN'::DOUBLE) AS v_mean, coalesce(quantile_cont(v, 0.5), 'NaN'::DOUBLE) AS v_median, coalesce(min(v), 'NaN'::DOUBLE) AS v_min, coalesce(max(v), 'NaN'::DOUBLE) AS v_max,
CASE WHEN count(v) = 0 THEN 'NaN'::DOUBLE ELSE count(v)::DOUBLE END AS v_count, round(coalesce(stddev_pop(v), 'NaN'::DOUBLE), 6) AS v_std, round(coalesce(var_pop(v), 'NaN'::DOUBLE), 5) AS v_var,
coalesce(arg_min(v, event_id) FILTER (v IS NOT NULL), 'NaN'::DOUBLE) AS v_first, coalesce(arg_max(v, event_id) FILTER (v IS NOT NULL), 'NaN'::DOUBLE) AS v_last, CASE WHEN count(v) = 0 THEN 'NaN'::DOUBLE ELSE count(DISTINCT v)::DOUBLE END AS v_nunique FROM {EV} GROUP BY user_id""")
def agg_registry(spark, d):
    out = A.agg(events(spark, d), ["user_id"], [("v", f) for f in A.AGGREGATES], ["event_id"])
    return out.withColumns({"v_std": F.round("v_std", 6), "v_var": F.round("v_var", 5)})


@query("SELECT o_orderstatus, count(DISTINCT o_orderpriority)::DOUBLE AS o_orderpriority_nunique, min(o_orderpriority) AS o_orderpriority_min, max(o_orderpriority) AS o_orderpriority_max FROM orders GROUP BY 1")
def agg_strings(spark, d):
    return A.agg(t(spark, d, "orders"), ["o_orderstatus"], {"o_orderpriority": ["nunique", "min", "max"]})


@query("SELECT n_regionkey, sum(c_acctbal) AS c_acctbal_sum FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def agg_after_join(spark, d):
    joined = J.merge_on(t(spark, d, "customer"), t(spark, d, "nation").withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"])
    return A.agg(joined, ["n_regionkey"], {"c_acctbal": "sum"})


@query(f"SELECT event_id, v - avg(v) OVER (PARTITION BY event_type) AS v_transformed FROM {EV}")
def group_transform(spark, d):
    return A.transform(events(spark, d), ["event_type"], "v", F.col("v") - F.col("mean"), aggregates={"mean": F.avg("v")}).select("event_id", "v_transformed")


@query(f"SELECT event_id, v - first_value(v) OVER (PARTITION BY user_id ORDER BY event_id) AS v_transformed FROM {EV}")
def group_transform_window(spark, d):
    return A.transform(events(spark, d), ["user_id"], "v", lambda w: F.col("v") - F.first("v").over(w.orderBy("event_id"))).select("event_id", "v_transformed")


@query("SELECT event_id, value / max(value) OVER (PARTITION BY user_id) AS value_transformed FROM events")
def group_transform_vector(spark, d):
    rows = t(spark, d, "events").select("event_id", "user_id", "value")
    return A.transform(rows, ["user_id"], "value", A.vector(lambda x: x / x.max()), ["event_id"]).select("event_id", "value_transformed")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING avg(c_acctbal) > 4500)")
def group_filter(spark, d):
    return A.filter_groups(t(spark, d, "customer"), ["c_mktsegment"], F.avg("c_acctbal") > 4500).select("c_custkey", "c_mktsegment")


@query("SELECT user_id, count(*) AS n, max(value) AS top FROM events GROUP BY 1")
def group_apply(spark, d):
    import pandas as pd

    rows = t(spark, d, "events").select("user_id", "value")
    return A.apply_groups(rows, ["user_id"], lambda g: pd.DataFrame({"user_id": [g.user_id.iloc[0]], "n": [len(g)], "top": [g.value.max()]}), "user_id long, n long, top double")


@query("SELECT event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS rows FROM events GROUP BY 1")
def group_positions(spark, d):
    return A.groups(t(spark, d, "events"), ["event_type"], "event_id").withColumn("rows", F.array_join("rows", ","))


# selection, sorting, duplicates


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'")
def filter_project(spark, d):
    rows = Frame(t(spark, d, "lineitem"), ("l_orderkey", "l_linenumber")).filter((F.col("l_quantity") < 10) & (F.col("l_returnflag") == "R"))
    return rows.with_column("net", rows["l_extendedprice"] * (lit(1) - col("l_discount")).column()).df.select("l_orderkey", "l_linenumber", "net")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10")
def head(spark, d):
    return SE.head(t(spark, d, "orders"), 10, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7")
def tail(spark, d):
    return SE.tail(t(spark, d, "orders"), 7, ["o_orderkey"]).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15 OFFSET 20")
def slice_rows(spark, d):
    return SE.slice_rows(t(spark, d, "orders"), 20, 35, ["o_orderkey"]).select("o_orderkey")


@query("WITH i AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders) SELECT place, o_orderkey FROM (VALUES (0, 5), (1, 2), (2, 2), (3, 90)) w(place, p) JOIN i USING (p)")
def take(spark, d):
    return SE.take(t(spark, d, "orders"), [5, 2, 2, 90], ["o_orderkey"], "place").select("place", "o_orderkey")


@query("SELECT * FROM part WHERE p_size >= 40")
def query_text(spark, d):
    return SE.query(t(spark, d, "part"), "p_size >= 40")


@query("SELECT c_mktsegment IN ('BUILDING', 'MACHINERY') AS c_mktsegment, false AS c_name, c_nationkey IN (1, 2, 3) AS c_nationkey FROM customer")
def is_in_columns(spark, d):
    return SE.is_in_columns(t(spark, d, "customer").select("c_mktsegment", "c_name", "c_nationkey"), {"c_mktsegment": ["BUILDING", "MACHINERY"], "c_nationkey": [1, 2, 3]})


@query(f"SELECT event_id, CASE WHEN v > 50 THEN v ELSE -1.0 END AS w, CASE WHEN v > 50 THEN -1.0 ELSE v END AS m FROM {EV}")
def where_mask(spark, d):
    c = F.col("v") > 50
    return events(spark, d).select("event_id", N.where(F.col("v"), c, -1.0).alias("w"), N.mask(F.col("v"), c, -1.0).alias("m"))


@query("SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) - 1 AS place FROM customer")
def sort_by(spark, d):
    """The whole sort; the place of a row is that of its partition, which holds a range, and within it."""
    done = SE.sort_by(t(spark, d, "customer"), ["c_mktsegment", "c_acctbal"], [True, False], ["c_custkey"]).select("c_custkey", "c_acctbal", F.monotonically_increasing_id().alias("__at"))
    return indexed(done, "__at", "place").select("c_custkey", "c_acctbal", "place")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) > 1 AS f, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey DESC) > 1 AS l, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) > 1 AS n FROM orders")
def duplicated(spark, d):
    rows = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    for name, keep in (("f", "first"), ("l", "last"), ("n", "none")):
        rows = SE.duplicated(rows, ["o_custkey", "o_orderstatus"], keep, ["o_orderkey"], name)
    return rows.select("o_orderkey", "f", "l", "n")


@query("SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def drop_duplicates(spark, d):
    return SE.drop_duplicates(t(spark, d, "orders"), ["o_custkey"], "first", ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("SELECT DISTINCT event_type FROM events")
def unique(spark, d):
    return SE.unique(t(spark, d, "events"), "event_type", ["event_id"])


@query("SELECT event_type, count(*) AS count FROM events GROUP BY 1")
def value_counts(spark, d):
    return SE.value_counts(t(spark, d, "events"), "event_type", ["event_id"])


@query("WITH f AS (SELECT event_type, min(event_id) AS m FROM events GROUP BY 1), c AS (SELECT event_type, row_number() OVER (ORDER BY m) - 1 AS event_type_code FROM f) SELECT event_id, event_type_code FROM events JOIN c USING (event_type)")
def factorize(spark, d):
    return SE.factorize(t(spark, d, "events").select("event_id", "event_type"), "event_type", ["event_id"])[0].select("event_id", "event_type_code")


@query("SELECT o_totalprice FROM orders ORDER BY 1 DESC LIMIT 20")
def nlargest(spark, d):
    return SE.nlargest(t(spark, d, "orders"), "o_totalprice", 20)


@query("SELECT o_totalprice FROM orders ORDER BY 1 LIMIT 20")
def nsmallest(spark, d):
    return SE.nsmallest(t(spark, d, "orders"), "o_totalprice", 20)


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 2")
def top_per_group(spark, d):
    rows = SE.top_per_group(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 2)
    return SE.row_number(rows, ["o_orderkey"], ["o_custkey"], "k")


@query("SELECT event_id, row_number() OVER (ORDER BY ts) - 1 AS pos FROM events")
def row_index(spark, d):
    return indexed(t(spark, d, "events").select("event_id", "ts"), "ts", "pos", bucket_rows=1000).select("event_id", "pos")


# joins

# customers' keys are shifted and orders' keys spread, so that both sides have rows without a match
_L = "(SELECT c_custkey + 40 AS k, c_name AS a FROM customer UNION ALL SELECT NULL, 'nobody')"
_R = "(SELECT o_custkey AS k, o_orderkey AS a, o_totalprice AS b FROM orders UNION ALL SELECT NULL, -1, 0.5)"


def _sides(spark, d):
    left = t(spark, d, "customer").select((F.col("c_custkey") + 40).alias("k"), F.col("c_name").alias("a"))
    right = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("a"), F.col("o_totalprice").alias("b"))
    return left.unionByName(spark.sql("SELECT cast(null as bigint) AS k, 'nobody' AS a")), right.unionByName(spark.sql("SELECT cast(null as bigint) AS k, -1L AS a, 0.5D AS b"))


def _join(how: str, sql: str) -> None:
    def run(spark, d):
        return J.merge_on(*_sides(spark, d), ["k"], how)

    run.__name__ = f"join_{how}"
    query(f"SELECT {'coalesce(l.k, r.k)' if how == 'outer' else 'r.k' if how == 'right' else 'l.k'} AS k, l.a, r.a AS a_right, r.b FROM {_L} l {sql} JOIN {_R} r ON l.k IS NOT DISTINCT FROM r.k")(run)


for _how, _sql in (("inner", ""), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):
    _join(_how, _sql)


@query(f"SELECT * FROM {_L} l WHERE EXISTS (SELECT 1 FROM {_R} r WHERE l.k IS NOT DISTINCT FROM r.k)")
def join_semi(spark, d):
    return J.semi(*_sides(spark, d), ["k"])


@query(f"SELECT * FROM {_L} l WHERE NOT EXISTS (SELECT 1 FROM {_R} r WHERE l.k IS NOT DISTINCT FROM r.k)")
def join_anti(spark, d):
    return J.anti(*_sides(spark, d), ["k"])


@query("SELECT r.*, n_name FROM region r, nation")
def join_cross(spark, d):
    return J.cross(t(spark, d, "region"), t(spark, d, "nation").select("n_name"))


@query("SELECT c.c_custkey::VARCHAR AS c_custkey, c_name, o_orderkey FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def join_index(spark, d):
    right = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return J.join_index(t(spark, d, "customer").select("c_custkey", "c_name"), right, "c_custkey", "left", ["o_orderkey"])


_CLICKS = "(SELECT event_id, ts, user_id FROM events WHERE event_type = 'click')"
_ERRORS = "(SELECT ts, user_id, event_id AS error_id FROM events WHERE event_type = 'error')"


@query(f"SELECT c.event_id, c.ts, c.user_id, e.error_id FROM {_CLICKS} c ASOF LEFT JOIN {_ERRORS} e ON c.user_id = e.user_id AND c.ts >= e.ts")
def join_asof_by(spark, d):
    rows = t(spark, d, "events")
    return J.asof(rows.where("event_type = 'click'").select("event_id", "ts", "user_id"), rows.where("event_type = 'error'").select("ts", "user_id", F.col("event_id").alias("error_id")), "ts", ["user_id"], bucket_rows=700)


@query(f"SELECT c.event_id, c.ts, e.error_id FROM {_CLICKS} c ASOF LEFT JOIN {_ERRORS} e ON c.ts >= e.ts")
def join_asof(spark, d):
    rows = t(spark, d, "events")
    return J.asof(rows.where("event_type = 'click'").select("event_id", "ts"), rows.where("event_type = 'error'").select("ts", F.col("event_id").alias("error_id")), "ts", bucket_rows=700)


# windows


def _event_window(name: str, sql: str, make) -> None:
    def run(spark, d):
        out = make(events(spark, d).select("event_id", "user_id", "v"))
        return out.select("event_id", F.col("w").cast("float").alias("w"))

    run.__name__ = name
    query(f"SELECT event_id, ({sql})::FLOAT AS w FROM {EV}")(run)


_O = ["event_id"]
for _fn, _agg in (("mean", "avg"), ("sum", "sum"), ("min", "min"), ("max", "max"), ("median", "median"), ("count", "count")):
    _x = f"{_agg}(v) OVER w3" if _fn != "median" else "quantile_cont(v, 0.5) OVER w3"
    _x = _x.replace("w3", "(ORDER BY event_id ROWS 4 PRECEDING)")
    _event_window(f"rolling_{_fn}", f"CASE WHEN count(v) OVER (ORDER BY event_id ROWS 4 PRECEDING) >= 3 THEN {_x} END::DOUBLE", lambda df, f=_fn: W.rolling(df, "v", f, 5, _O, (), 3, "w", block=1000))
for _fn, _agg in (("std", "stddev_pop"), ("var", "var_pop")):
    _event_window(f"rolling_{_fn}", f"CASE WHEN count(v) OVER (ORDER BY event_id ROWS 4 PRECEDING) >= 3 THEN {_agg}(v) OVER (ORDER BY event_id ROWS 4 PRECEDING) END", lambda df, f=_fn: W.rolling(df, "v", f, 5, _O, (), 3, "w", block=1000))
_event_window("rolling_apply", "CASE WHEN count(v) OVER (ORDER BY event_id ROWS 4 PRECEDING) >= 3 THEN max(v) OVER (ORDER BY event_id ROWS 4 PRECEDING) - min(v) OVER (ORDER BY event_id ROWS 4 PRECEDING) END", lambda df: W.rolling_apply(df, "v", lambda a: F.array_max(a) - F.array_min(a), 5, _O, (), 3, "w"))
_event_window("rolling_by_user", "CASE WHEN count(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING) >= 1 THEN avg(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS 4 PRECEDING) END", lambda df: W.rolling(df, "v", "mean", 5, _O, ["user_id"], 1, "w"))
_UP = "(ORDER BY event_id ROWS UNBOUNDED PRECEDING)"
for _fn, _agg in (("mean", "avg"), ("min", "min"), ("max", "max")):
    _event_window(f"expanding_{_fn}", f"{_agg}(v) OVER {_UP}", lambda df, f=_fn: W.expanding(df, "v", f, _O, name="w", bucket_rows=900))
_event_window("expanding_sum", f"CASE WHEN count(v) OVER {_UP} >= 1 THEN sum(v) OVER {_UP} END", lambda df: W.expanding(df, "v", "sum", _O, name="w", bucket_rows=900))
_event_window("expanding_std", f"CASE WHEN count(v) OVER {_UP} >= 2 THEN stddev_pop(v) OVER {_UP} WHEN count(v) OVER {_UP} = 1 THEN 'NaN'::DOUBLE END", lambda df: W.expanding(df, "v", "std", _O, name="w", bucket_rows=900))
for _fn in ("sum", "max", "min"):
    _event_window(f"cum{_fn}", f"CASE WHEN v IS NOT NULL THEN {_fn}(v) OVER {_UP} END", lambda df, f=_fn: W.cumulative(df, "v", f, _O, name="w", bucket_rows=900))
_event_window("cumprod_by_user", "CASE WHEN v IS NOT NULL THEN product(1 + v / 1e5) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) END", lambda df: W.cumulative(df.withColumn("v", 1 + F.col("v") / 1e5), "v", "prod", _O, ["user_id"], "w"))
_event_window("shift_forward", "lag(v, 2) OVER (ORDER BY event_id)", lambda df: W.shift(df, "v", 2, _O, name="w"))
_event_window("shift_back", "lead(v, 3) OVER (ORDER BY event_id)", lambda df: W.shift(df, "v", -3, _O, name="w"))
_event_window("diff", "v - lag(v) OVER (ORDER BY event_id)", lambda df: W.diff(df, "v", 1, _O, name="w"))
_event_window("pct_change", "(v - lag(v) OVER (ORDER BY event_id)) / nullif(lag(v) OVER (ORDER BY event_id), 0)", lambda df: W.pct_change(df, "v", 1, _O, name="w"))
_event_window("fill_forward", f"coalesce(v, last_value(v IGNORE NULLS) OVER {_UP})", lambda df: NU.fill_forward(df, ["v"], _O).withColumnRenamed("v", "w"))
_event_window("fill_backward", "coalesce(v, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))", lambda df: NU.fill_backward(df, ["v"], _O).withColumnRenamed("v", "w"))
for _m, _x in (("min", "rank() OVER (ORDER BY r)"), ("max", "rank() OVER (ORDER BY r) + count(*) OVER (PARTITION BY r) - 1"), ("average", "rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0"), ("dense", "dense_rank() OVER (ORDER BY r) - 1"), ("first", "row_number() OVER (ORDER BY r, event_id)")):

    def _rank(spark, d, m=_m):
        rows = t(spark, d, "events").select("event_id", F.floor("value").alias("r"))
        return W.rank(rows, "r", m, ["event_id"], name="w").select("event_id", "w")

    _rank.__name__ = f"rank_{_m}"
    query(f"SELECT event_id, ({_x})::DOUBLE AS w FROM (SELECT event_id, floor(value)::BIGINT AS r FROM events)")(_rank)


@query("""WITH RECURSIVE o AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id FROM events),
e AS (SELECT user_id, k, event_id, value AS w FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.k, o.event_id, 0.5 * o.value + 0.5 * e.w FROM e JOIN o ON o.user_id = e.user_id AND o.k = e.k + 1) SELECT event_id, w::FLOAT AS w FROM e""")
def ewm_by_user(spark, d):
    return W.ewm_mean(t(spark, d, "events").select("event_id", "user_id", "value"), "value", _O, alpha=0.5, partition_by=["user_id"], name="w").select("event_id", F.col("w").cast("float").alias("w"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY event_id) AS k FROM {EV}),
b AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN k END) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS pk, min(CASE WHEN v IS NOT NULL THEN k END) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nk FROM r)
SELECT b.event_id, coalesce(b.v, p.v + (n.v - p.v) * (b.k - b.pk) / nullif(b.nk - b.pk, 0)::DOUBLE, p.v, n.v)::FLOAT AS w FROM b LEFT JOIN r p ON p.k = b.pk LEFT JOIN r n ON n.k = b.nk""")
def interpolate(spark, d):
    return NU.interpolate(events(spark, d).select("event_id", "v"), ["v"], _O).select("event_id", F.col("v").cast("float").alias("w"))


@query(f"SELECT event_id, user_id, max(v) OVER (PARTITION BY user_id ORDER BY event_id ROWS 3 PRECEDING) AS v_rolling FROM {EV}")
def group_rolling(spark, d):
    return W.group_rolling(events(spark, d), "user_id", "v", 4, "max", _O)


# time


@query("SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s, dayofweek(ts) AS dw, dayofyear(ts) AS dy, quarter(ts) AS q, week(ts) AS w, epoch_us(ts) // 1000000 AS u, strftime(ts, '%Y-%m-%d') AS dt, strftime(ts, '%H:%M:%S') AS tm FROM events")
def date_parts(spark, d):
    c = F.col("ts")
    parts = {"y": TM.year, "mo": TM.month, "d": TM.day, "h": TM.hour, "mi": TM.minute, "s": TM.second, "dw": TM.day_of_week, "dy": TM.day_of_year, "q": TM.quarter, "w": TM.week, "u": TM.unix, "dt": TM.date_text, "tm": TM.time_text}
    return t(spark, d, "events").select("event_id", *[f(c).alias(k) for k, f in parts.items()])


@query("SELECT event_id, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2001-01-01') AS f, CASE WHEN time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2001-01-01') = ts THEN ts ELSE time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2001-01-01') + INTERVAL 6 HOURS END AS c, time_bucket(INTERVAL 6 HOURS, ts + INTERVAL 3 HOURS, TIMESTAMP '2001-01-01') AS r FROM events")
def time_rounding(spark, d):
    h, c = TM.nanos(hours=6), F.col("ts")
    return t(spark, d, "events").select("event_id", TM.floor(c, h).alias("f"), TM.ceil(c, h).alias("c"), TM.round_to(c, h).alias("r"))


@query("SELECT event_id, ts + INTERVAL 90 MINUTES AS plus, ts - INTERVAL 1 DAY AS minus, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 1000 AS since, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400e6 AS days, ts < TIMESTAMP '2024-01-15' AS before FROM events")
def time_arithmetic(spark, d):
    c, o = F.col("ts"), F.lit("2024-01-01").cast("timestamp_ntz")
    since = TM.difference(c, o)
    return t(spark, d, "events").select("event_id", TM.shift(c, TM.nanos(minutes=90)).alias("plus"), TM.shift(c, -TM.nanos(days=1)).alias("minus"), since.alias("since"), TM.to_unit(since, "days").alias("days"), (c < F.lit("2024-01-15").cast("timestamp_ntz")).alias("before"))


@query("SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00'")
def between_time(spark, d):
    import datetime as dt

    return t(spark, d, "events").where(TM.between(F.col("ts"), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 9, 12))).select("event_id")


@query("SELECT event_id FROM events WHERE hour(ts) = 13 AND minute(ts) = 5")
def at_time(spark, d):
    return t(spark, d, "events").where(TM.at_time(F.col("ts"), 13, 5)).select("event_id")


@query(f"SELECT time_bucket(INTERVAL 7 DAYS, ts) AS ts, event_type, coalesce(sum(v), 'NaN'::DOUBLE) AS v_sum, CASE WHEN count(v) = 0 THEN 'NaN'::DOUBLE ELSE count(v)::DOUBLE END AS v_count FROM {EV} GROUP BY ALL")
def dynamic_weeks(spark, d):
    return TG.group_by_dynamic(events(spark, d), "ts", TM.nanos(days=7)).by("event_type").agg([("v", "sum"), ("v", "count")])


@query("SELECT time_bucket(INTERVAL 1 DAY, ts - INTERVAL 1 MICROSECOND) + INTERVAL 1 DAY AS ts, max(value) AS value_max FROM events GROUP BY 1")
def dynamic_right(spark, d):
    return TG.group_by_dynamic(t(spark, d, "events").select("ts", "value"), "ts", TM.nanos(days=1)).closed("right").label("right").agg({"value": "max"})


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS ts, avg(value) AS value_mean FROM events WHERE ts < time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 6 HOURS GROUP BY 1")
def dynamic_gaps(spark, d):
    return TG.group_by_dynamic(t(spark, d, "events").select("ts", "value"), "ts", TM.nanos(hours=6), TM.nanos(days=1)).agg({"value": "mean"})


@query("SELECT time_bucket(INTERVAL 3 HOURS, ts) AS ts, sum(event_id)::DOUBLE AS event_id, sum(value) AS value, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1")
def resample(spark, d):
    return TG.resample(t(spark, d, "events").select("ts", "event_id", "value", "event_type"), "ts", TM.nanos(hours=3), "sum", ["event_id"])


@query("SELECT event_id, (avg(value) OVER (PARTITION BY user_id ORDER BY ts RANGE INTERVAL 2 DAYS PRECEDING))::FLOAT AS rolling_result FROM events")
def rolling_time(spark, d):
    return TG.rolling_time(t(spark, d, "events"), "ts", TM.nanos(days=2), ["user_id"], "value", "mean").select("event_id", F.col("rolling_result").cast("float").alias("rolling_result"))


@query("SELECT TIMESTAMP '2024-01-01' + i * INTERVAL 90 MINUTES AS ts FROM range(100) r(i)")
def date_range(spark, d):
    import datetime as dt

    return TG.date_range(spark, dt.datetime(2024, 1, 1), 100, TM.nanos(minutes=90))


@query("SELECT i AS at, CASE WHEN i IN (SELECT p_size FROM part) THEN i ELSE 0 END::DOUBLE AS p_size FROM range((SELECT min(p_size) FROM part), (SELECT max(p_size) FROM part) + 1, 3) r(i)")
def as_freq(spark, d):
    return TG.as_freq(t(spark, d, "part"), "p_size", 3, 0.0)


# numbers, strings, nulls


@query(f"""SELECT event_id, v + 1 AS a, v - user_id AS s, v * 2 AS m, CASE WHEN user_id % 4 = 0 THEN CASE WHEN v IS NOT NULL THEN 'NaN'::DOUBLE END ELSE v / (user_id % 4) END AS d, CASE WHEN v IS NOT NULL THEN least(greatest(v, 10), 60) END AS c, abs(v - 50) AS b, -v AS n,
CASE WHEN v IS NOT NULL THEN v > 30 AND user_id > 5 END AS l, CASE WHEN v IS NOT NULL THEN v > 30 OR user_id > 5 END AS o FROM {EV}""")
def arithmetic(spark, d):
    v, u = F.col("v"), F.col("user_id")
    return events(spark, d).select("event_id", N.add(v, 1).alias("a"), N.sub(v, u).alias("s"), N.mul(v, 2).alias("m"), N.div(v, u % 4).alias("d"), N.clip(v, 10, 60).alias("c"), N.absolute(N.sub(v, 50)).alias("b"), N.neg(v).alias("n"), N.both(v > 30, u > 5).alias("l"), N.either(v > 30, u > 5).alias("o"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, strlen(p_name) AS n, contains(p_name, 'a') AS c, regexp_matches(p_type, '^[A-Z]+ [A-Z]+$') AS x, starts_with(p_brand, 'Brand#1') AS st, ends_with(p_brand, '3') AS en, replace(p_type, 'E', 'e') AS r, split_part(p_type, ' ', 2) AS s1, regexp_extract(p_brand, '#([0-9])', 1) AS e, lpad(p_size::VARCHAR, 6, '0') AS z, regexp_matches(p_brand, '^[0-9]+$') AS di, p_name = '' AS em FROM part")
def strings(spark, d):
    n, b, ty = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    return t(spark, d, "part").select(
        "p_partkey", S.upper(n).alias("u"), S.lower(b).alias("l"), S.length(n).alias("n"), S.contains(n, "a").alias("c"), S.contains(ty, "^[A-Z]+ [A-Z]+$").alias("x"), S.starts_with(b, "Brand#1").alias("st"), S.ends_with(b, "3").alias("en"),
        S.replace(ty, "E", "e").alias("r"), S.split(ty, " ", 1).alias("s1"), S.extract(b, "#([0-9])").alias("e"), S.zero_fill(F.col("p_size"), 6).alias("z"), S.is_digit(b).alias("di"), S.is_empty(n).alias("em"),
    )


@query("SELECT doc_id, strlen(text) AS n, len(regexp_extract_all(text, '[aeiou]')) AS c, translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz') AS w, array_to_string(regexp_extract_all(text, '[0-9]+'), ',') AS x FROM documents")
def strings_documents(spark, d):
    c = F.col("text")
    return t(spark, d, "documents").select("doc_id", S.length(c).alias("n"), S.count(c, "[aeiou]").alias("c"), S.swap_case(c).alias("w"), S.extract_all(c, "[0-9]+").alias("x"))


@query(f"SELECT * FROM {EV} WHERE v IS NOT NULL")
def drop_na(spark, d):
    return NU.drop_na(events(spark, d))


@query(f"SELECT event_id, ts, user_id, event_type, coalesce(v, -5) AS v FROM {EV}")
def fill_na(spark, d):
    return NU.fill_na(events(spark, d), -5)


@query("SELECT p_partkey, coalesce(try_cast(p_name AS BIGINT), 0) AS a, coalesce(try_cast(substr(p_brand, 7) AS DOUBLE), 0) AS f, p_size::VARCHAR AS s, try_cast(substr(p_brand, 7) AS DOUBLE) AS n FROM part")
def casts(spark, d):
    b = F.substring("p_brand", 7, 100)
    return t(spark, d, "part").select("p_partkey", N.as_type(F.col("p_name"), "int64").alias("a"), N.as_type(b, "float64").alias("f"), N.as_type(F.col("p_size"), "string").alias("s"), N.to_numeric(b).alias("n"))


# statistics


@query("""SELECT statistic, v AS o_totalprice FROM (SELECT count(o_totalprice)::DOUBLE AS c, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, min(o_totalprice) AS mi, quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q, max(o_totalprice) AS ma FROM orders),
LATERAL (VALUES ('count', round(c, 4)), ('mean', round(m, 4)), ('std', round(s, 4)), ('min', round(mi, 4)), ('25%', round(q[1], 4)), ('50%', round(q[2], 4)), ('75%', round(q[3], 4)), ('max', round(ma, 4))) x(statistic, v)""")
def describe(spark, d):
    return ST.describe(t(spark, d, "orders"), ["o_totalprice"]).select("statistic", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 9) AS corr, round(covar_pop(l_quantity, l_extendedprice), 3) AS cov, round(avg(power(l_extendedprice - m, 3)) / power(avg(power(l_extendedprice - m, 2)), 1.5), 6) AS skew, round(kurtosis_pop(l_extendedprice), 6) AS kurt, round(quantile_cont(l_extendedprice, 0.9), 6) AS q FROM lineitem, (SELECT avg(l_extendedprice) AS m FROM lineitem)")
def moments(spark, d):
    a, b = F.col("l_quantity"), F.col("l_extendedprice")
    rows = t(spark, d, "lineitem")
    return rows.agg(F.round(ST.corr_of(a, b), 9).alias("corr"), F.round(ST.cov_of(a, b), 3).alias("cov"), F.round(ST.skew_of(b), 6).alias("skew"), F.round(ST.kurt_of(b), 6).alias("kurt")).withColumn("q", F.round(F.lit(ST.quantile(rows, "l_extendedprice", 0.9)), 6))


@query("""WITH m AS (SELECT round(corr(l_quantity, l_discount), 9) AS qd, round(corr(l_tax, l_discount), 9) AS td, round(corr(l_tax, l_quantity), 9) AS tq FROM lineitem)
SELECT 'l_discount' AS "column", 1.0::DOUBLE AS l_discount, qd AS l_quantity, td AS l_tax FROM m UNION ALL SELECT 'l_quantity', qd, 1.0, tq FROM m UNION ALL SELECT 'l_tax', td, tq, 1.0 FROM m""")
def corr_matrix(spark, d):
    names = ["l_discount", "l_quantity", "l_tax"]
    return ST.corr_matrix(t(spark, d, "lineitem"), names).select("column", *[F.round(c, 9).alias(c) for c in names])


@query("WITH c AS (SELECT p_size, count(*) AS n FROM part GROUP BY 1) SELECT p_size FROM c WHERE n = (SELECT max(n) FROM c)")
def mode(spark, d):
    return ST.mode(t(spark, d, "part"), "p_size", ["p_partkey"])


@query("SELECT column_name AS column, CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' END AS dtype, (SELECT count(*) FROM customer) AS non_null FROM information_schema.columns WHERE table_name = 'customer'")
def info(spark, d):
    return ST.info(t(spark, d, "customer"))


# shapes


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT c_nationkey::VARCHAR AS c_nationkey, " + ", ".join(f"last(c_acctbal ORDER BY c_custkey) FILTER (c_mktsegment = '{v}') AS \"{v}\"" for v in _SEGMENTS) + " FROM customer GROUP BY 1")
def pivot(spark, d):
    return R.pivot(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", ["c_custkey"])


@query("SELECT c_nationkey::VARCHAR AS c_nationkey, " + ", ".join(f"round(sum(c_acctbal) FILTER (c_mktsegment = '{v}'), 4) AS \"{v}\"" for v in _SEGMENTS) + " FROM customer GROUP BY 1")
def pivot_table(spark, d):
    out = R.pivot_table(t(spark, d, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", "sum")
    return out.select("c_nationkey", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query("SELECT l_orderkey, l_linenumber, variable, value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))")
def melt(spark, d):
    return R.melt(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"), ["l_orderkey", "l_linenumber"])


@query("SELECT n_regionkey::VARCHAR AS index, " + ", ".join(f"max(n) FILTER (c_mktsegment = '{v}') AS \"total_{v}\"" for v in _SEGMENTS) + " FROM (SELECT n_regionkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY 1")
def unstack(spark, d):
    rows = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("total"))
    return R.unstack(rows, ["n_regionkey", "c_mktsegment"], 1, ["n_regionkey", "c_mktsegment"])


@query("SELECT c_custkey, 'c' AS side FROM customer UNION ALL SELECT c_custkey, 'c' FROM customer WHERE c_custkey < 10")
def concat_rows(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", F.lit("c").alias("side"))
    return R.concat_rows([rows, rows.where("c_custkey < 10").select("side", "c_custkey")])


@query("WITH a AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders), b AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS k FROM part) SELECT o_orderkey, p_partkey FROM a FULL JOIN b USING (k)")
def concat_columns(spark, d):
    return R.concat_columns([t(spark, d, "orders").select("o_orderkey"), t(spark, d, "part").select("p_partkey")], [["o_orderkey"], ["p_partkey"]])


@query("SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::BIGINT AS \"c_mktsegment_{v}\"" for v in _SEGMENTS) + " FROM customer")
def get_dummies(spark, d):
    return R.get_dummies(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"]).drop("c_mktsegment")


@query("SELECT p_partkey, least(floor((p_retailprice - lo) / ((hi - lo) / 5)), 4)::INT AS code, format('({:g},{:g}]', lo + (hi - lo) * least(floor((p_retailprice - lo) / ((hi - lo) / 5)), 4) / 5, lo + (hi - lo) * (least(floor((p_retailprice - lo) / ((hi - lo) / 5)), 4) + 1) / 5) AS label FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)")
def cut(spark, d):
    rows = t(spark, d, "part")
    return R.cut(rows, "p_retailprice", 5, "label").select("p_partkey", R.cut_code(rows, "p_retailprice", 5).alias("code"), "label")


@query("""SELECT p_partkey, code, format('[{:g},{:g}]', q[code + 1], q[code + 2]) AS label FROM (SELECT p_partkey, CASE WHEN p_retailprice <= q[2] THEN 0 WHEN p_retailprice <= q[3] THEN 1 WHEN p_retailprice <= q[4] THEN 2 ELSE 3 END AS code, q
FROM part, (SELECT quantile_cont(p_retailprice, [0, 0.25, 0.5, 0.75, 1]) AS q FROM part))""")
def qcut(spark, d):
    rows = t(spark, d, "part")
    return R.qcut(rows, "p_retailprice", 4, "label").select("p_partkey", R.qcut_code(rows, "p_retailprice", 4).alias("code"), "label")


@query("SELECT p_partkey, nullif(trim(unnest(string_split(p_type, ' '))), '') AS p_type FROM part")
def explode_text(spark, d):
    return R.explode_text(t(spark, d, "part").select("p_partkey", "p_type"), "p_type", " ")


@query("SELECT CASE WHEN a = b THEN NULL ELSE a || '→' || b END AS n FROM (SELECT n_name AS a, CASE WHEN n_nationkey % 5 = 0 THEN 'X' ELSE n_name END AS b FROM nation)")
def compare(spark, d):
    rows = t(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("n"))
    other = rows.withColumn("n", F.when(F.col("n_nationkey") % 5 == 0, "X").otherwise(F.col("n")))
    return R.compare(rows, other, ["n_nationkey"], ["n_nationkey"]).select("n")


@query("SELECT (row_number() OVER (ORDER BY c_mktsegment) - 1)::INT AS code, c_mktsegment AS category, count(*) AS count FROM customer GROUP BY 2")
def categorical_counts(spark, d):
    return Categorical.of(t(spark, d, "customer"), "c_mktsegment", ordered=True).value_counts()


# plans


@query("SELECT c_mktsegment, count(*) AS n, round(stddev_pop(c_acctbal), 6) AS s, quantile_cont(c_acctbal, 0.5) AS m FROM customer WHERE c_acctbal > 0 AND (c_nationkey < 10 OR c_nationkey > 20) GROUP BY 1 HAVING count(*) > 1")
def sql_query(spark, d):
    return SQLContext(spark).register("cust", t(spark, d, "customer")).query("SELECT c_mktsegment, count(*) AS n, round(STD(c_acctbal), 6) AS s, MEDIAN(c_acctbal) AS m FROM cust WHERE c_acctbal > 0 AND (c_nationkey < 10 OR c_nationkey > 20) GROUP BY c_mktsegment HAVING count(*) > 1")


@query("SELECT l_returnflag, sum(l_extendedprice * (1 - l_discount)) AS net_sum, max(l_extendedprice * (1 - l_discount)) AS net_max FROM lineitem WHERE l_quantity > 20 AND l_linestatus = 'O' GROUP BY 1 ORDER BY 1 LIMIT 2")
def lazy_plan(spark, d):
    lazy = LazyFrame(t(spark, d, "lineitem")).filter((col("l_quantity") > 20) & (col("l_linestatus") == "O")).with_column("net", col("l_extendedprice") * (lit(1) - col("l_discount")))
    return lazy.group_by("l_returnflag").agg([("net", "sum"), ("net", "max")]).sort(["l_returnflag"]).limit(2).collect()


@query("SELECT sum(o_totalprice) AS o_totalprice_sum, avg(o_totalprice) AS o_totalprice_mean, count(DISTINCT o_custkey) AS o_custkey_nunique FROM orders")
def lazy_aggregates(spark, d):
    return LazyFrame(t(spark, d, "orders")).select(col("o_totalprice").sum(), col("o_totalprice").mean(), col("o_custkey").nunique()).collect()


@query("SELECT c_mktsegment AS _group_key, sum(c_acctbal) AS c_acctbal_sum FROM customer GROUP BY 1")
def multi_index_group(spark, d):
    return Frame(t(spark, d, "customer"), ("c_custkey",)).set_multi_index("c_nationkey", "c_mktsegment").group_by_level(1, {"c_acctbal": "sum"})


@query("SELECT r_regionkey::VARCHAR AS _index, r_name FROM region")
def reset_index(spark, d):
    return Frame(t(spark, d, "region")).set_index("r_regionkey").reset_index().df


@query("SELECT event_id, upper(event_type) AS e, value * 2 AS w FROM events")
def mapped_functions(spark, d):
    f = Frame(t(spark, d, "events"), ("event_id",))
    return f.df.select("event_id", f["event_type"].map_string(str.upper).column.alias("e"), f["value"].map_float(lambda x: x * 2).column.alias("w"))


@query("SELECT event_id + 1 AS next, event_type || '!' AS e FROM events")
def apply_rows(spark, d):
    return Frame(t(spark, d, "events").select("event_id", "event_type")).apply_rows(lambda r: {"next": r["event_id"] + 1, "e": r["event_type"] + "!"}, "next long, e string")


from . import catalog_frames, catalog_sources  # noqa: E402, F401  their queries use the names above
