"""The frame and series objects on small fixtures with expected values worked out by hand."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from quillframe.frame import Frame
from quillframe.functions import temporal as TM
from quillframe.functions.types import from_spark, is_float, is_integer, is_numeric, is_signed, promote, to_spark
from quillframe.operators import agg as A
from quillframe.operators import nulls as NU
from quillframe.operators import reshape as R
from quillframe.plans.expr import col, lit
from quillframe.plans.sql import SQLContext, rewrite


@pytest.fixture(scope="module")
def people(spark):
    return Frame.of(spark, {"name": ["alice", "bob", "charlie", "dave"], "age": [25, 30, 35, 40], "score": [88.5, 92.0, 76.5, 95.0]})


def s(spark, values, kind=None):
    return Frame.of(spark, {"x": values}, {"x": kind} if kind else None)["x"]


def listed(series):
    return series.to_list() if hasattr(series, "to_list") else [r[0] for r in series.collect()]


def near(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want):
        if b is None:
            assert a is None
        elif isinstance(b, float) and math.isnan(b):
            assert math.isnan(a)
        else:
            assert a == pytest.approx(b)


def test_metadata(people):
    assert people.shape() == (4, 3) and people.columns == ["name", "age", "score"]
    assert people.dtypes() == {"name": "string", "age": "int64", "score": "float64"}
    assert people.select("age").columns == ["age"] and people.drop("age").columns == ["name", "score"]
    assert people.rename({"age": "years"}).columns == ["name", "years", "score"]
    assert people.pipe(lambda f: f.head(2)).shape()[0] == 2
    assert people.memory_usage()["age"] == 32
    text = people.display()
    assert "charlie" in text and text.endswith("4 rows × 3 columns")
    assert {r["column"]: r["non_null"] for r in people.info().collect()} == {"name": 4, "age": 4, "score": 4}
    with pytest.raises(KeyError):
        people["nothing"]


def test_describe(people):
    rows = {r["statistic"]: r["age"] for r in people.describe().collect()}
    assert rows["count"] == 4 and rows["mean"] == 32.5 and rows["50%"] == 32.5 and rows["25%"] == 28.75
    assert rows["std"] == pytest.approx(5.59017, abs=1e-4)


def test_rows(people):
    assert [r["name"] for r in people.tail(2).sorted().collect()] == ["charlie", "dave"]
    assert [r["name"] for r in people.slice(1, 3).sorted().collect()] == ["bob", "charlie"]
    assert [r["age"] for r in people.take([3, 0, 0]).sorted().collect()] == [40, 25, 25]
    assert people.filter(people["age"].gt(28)).shape()[0] == 3
    assert people.query("score >= 92").shape()[0] == 2 and people.query("name == 'bob'").shape()[0] == 1
    assert people.query("nonsense").shape()[0] == 4
    assert [r["name"] for r in people.sort_by(["age"], [False]).collect()][0] == "dave"
    assert people.filter(F.col("age") > 99).columns == people.columns


def test_nulls(spark):
    f = Frame.of(spark, {"name": ["a", None, "c"], "age": [1, 2, None], "w": [float("nan"), 1.0, 2.0]})
    assert f.drop_na().shape()[0] == 1
    filled = f.fill_na(7).sorted().collect()
    assert [r["age"] for r in filled] == [1, 2, 7] and math.isnan(filled[0]["w"]) and filled[1]["name"] == "7"
    x = s(spark, [1.0, None, None, 4.0, None], "float64")
    near(listed(x.fill_forward()), [1, 1, 1, 4, 4])
    near(listed(x.fill_backward()), [1, 4, 4, 4, None])
    near(listed(x.interpolate()), [1, 2, 3, 4, 4])
    near(listed(s(spark, [None, 3.0, None], "float64").interpolate()), [3, 3, 3])
    for method, want in (("ffill", [1, 1, 1, 4, 4]), ("other", [1, None, None, 4, None])):
        near([r["x"] for r in x.frame.fill_na_method(method).sorted().collect()], want)


def test_joins(spark):
    left = Frame.of(spark, {"key": ["a", "b", "c"], "v": [1, 2, 3]})
    right = Frame.of(spark, {"key": ["b", "c", "d"], "v": [20, 30, 40]})
    got = {h: sorted(map(tuple, left.merge(right, ["key"], h).df.select("key", "v", "v_right").collect()), key=str) for h in ("inner", "left", "right", "outer")}
    assert got["inner"] == [("b", 2, 20), ("c", 3, 30)]
    assert got["left"] == [("a", 1, None), ("b", 2, 20), ("c", 3, 30)]
    assert got["right"] == [("b", 2, 20), ("c", 3, 30), ("d", None, 40)]
    assert got["outer"] == [("a", 1, None), ("b", 2, 20), ("c", 3, 30), ("d", None, 40)]
    assert left.merge(right, ["key"], "cross").shape()[0] == 9 == left.cross_join(right).shape()[0]
    assert [r["key"] for r in left.semi_join(right, ["key"]).sorted().collect()] == ["b", "c"]
    assert [r["key"] for r in left.anti_join(right, ["key"]).sorted().collect()] == ["a"]
    joined = left.set_index("key").join(right.set_index("key"), "left").sorted().collect()
    assert [(r["key"], r["v_right"]) for r in joined] == [("a", None), ("b", 20), ("c", 30)]


def test_asof(spark):
    trades = Frame.of(spark, {"ts": [1.0, 3.0, 5.0, 7.0, None, -1.0], "price": [1, 2, 3, 4, 5, 6]})
    quotes = Frame.of(spark, {"ts": [0.0, 2.0, 4.0, 6.0, 8.0], "bid": [99, 100, 101, 102, 103]})
    assert [r["bid"] for r in trades.asof_join(quotes, "ts").sorted().collect()] == [99, 100, 101, 102, None, None]
    assert [r["bid"] for r in trades.asof_join(Frame(quotes.df.limit(0), quotes.order), "ts").sorted().collect()] == [None] * 6


def test_agg(spark):
    f = Frame.of(spark, {"dept": ["eng", "eng", "sales", "sales", None], "salary": [100.0, 120.0, 80.0, 90.0, None]})
    got = {r["dept"]: r for r in f.agg(["dept"], {"salary": list(A.AGGREGATES)}).collect()}
    assert got["eng"]["salary_mean"] == 110 and got["sales"]["salary_median"] == 85 and got["eng"]["salary_std"] == 10 and got["eng"]["salary_first"] == 100
    assert all(math.isnan(v) for k, v in got[None].asDict().items() if k != "dept")
    with pytest.raises(TypeError):
        f.agg(["salary"], {"dept": "sum"})
    with pytest.raises(ValueError):
        f.agg(["dept"], {"salary": "nothing"})
    assert f.group_filter(["dept"], F.avg("salary") > 85).shape()[0] == 2
    assert f.group_filter(["dept"], lambda g: g.salary.mean() > 85).shape()[0] == 2
    assert f.group_rolling("dept", "salary", 2, "sum").count() == 5
    assert {tuple(r["rows"]) for r in f.groups(["dept"]).collect()} == {(0, 1), (2, 3), (4,)}


def test_arithmetic(spark):
    f = Frame.of(spark, {"a": [10.0, 7.0, None], "b": [0.0, 2.0, 1.0]})
    a, b = f["a"], f["b"]
    near(listed(a / b), [math.nan, 3.5, None])
    near(listed(a % b), [math.nan, 1, None])
    near(listed(a + 1), [11, 8, None])
    near(listed(-(a - b) * 2), [-20, -10, None])
    near(listed(a.clip(8, 9)), [9, 8, None])
    assert listed(a.ge(10)) == [True, False, None] and listed(a.ne(b)) == [True, True, None]
    c = Frame.of(spark, {"p": [True, True, False, None], "q": [True, False, False, False]})
    assert listed(c["p"] & c["q"]) == [True, False, False, None] and listed(c["p"] | c["q"]) == [True, True, False, None] and listed(~c["p"]) == [False, False, True, None]
    assert listed(a.where(a.gt(8), -1.0)) == [10, -1, -1] and listed(a.mask(a.gt(8), -1.0)) == [-1, 7, None]
    assert listed(a.is_in([7.0])) == [False, True, None]
    assert listed(s(spark, ["12", "x", "3.7", None]).as_type("int64")) == [12, 0, 3, None]
    assert listed(s(spark, ["1.5", "x", None]).to_numeric()) == [1.5, None, None]


def test_ordered(spark):
    x = s(spark, [10, 20, 30, 40, 50])
    near(listed(x.shift(2)), [None, None, 10, 20, 30])
    near(listed(x.shift(-1)), [20, 30, 40, 50, None])
    near(listed(s(spark, [100.0, 110.0, 121.0, 0.0, 5.0]).pct_change()), [None, 0.1, 0.1, -1, None])
    near(listed(s(spark, [10.0, 15.0, 13.0, 20.0]).diff()), [None, 5, -2, 7])
    y = s(spark, [1.0, 2.0, 3.0, 4.0, 5.0])
    near(listed(y.rolling(3).mean()), [None, None, 2, 3, 4])
    near(listed(y.rolling(3, 1).mean()), [1, 1.5, 2, 3, 4])
    near(listed(y.rolling(2).apply(lambda a: F.array_max(a) * 2)), [None, 4, 6, 8, 10])
    near(listed(y.rolling(2).std()), [None, 0.5, 0.5, 0.5, 0.5])
    near(listed(y.expanding().mean()), [1, 1.5, 2, 2.5, 3])
    near(listed(y.expanding().std()), [math.nan, 0.5, (2 / 3) ** 0.5, 1.25**0.5, 2**0.5])
    z = s(spark, [1.0, 2.0, None, 4.0, 6.0])
    near(listed(z.ewm(alpha=0.5)), [1, 1.5, None, 4, 5])
    near(listed(z.ewm(span=3)), [1, 1.5, None, 4, 5])
    near(listed(z.cumsum()), [1, 3, None, 7, 13])
    near(listed(z.cumprod()), [1, 2, None, 8, 48])
    near(listed(s(spark, [3.0, 1.0, None, 5.0]).cummax()), [3, 3, None, 5])
    near(listed(s(spark, [3.0, 1.0, None, 5.0]).cummin()), [3, 1, None, 1])


def test_ranks(spark):
    x = s(spark, [3.0, 1.0, 4.0, 1.0, 5.0, None])
    want = {"average": [3, 1.5, 4, 1.5, 5, None], "min": [3, 1, 4, 1, 5, None], "max": [3, 2, 4, 2, 5, None], "first": [3, 1, 4, 2, 5, None], "dense": [1, 0, 2, 0, 3, None]}
    for method, ranks in want.items():
        near(listed(x.rank(method)), ranks)
    assert listed(x.nlargest(2)) == [5, 4] and listed(x.nsmallest(3)) == [1, 1, 3]


def test_statistics(spark):
    f = Frame.of(spark, {"a": [1.0, 2.0, 3.0, 4.0, 5.0], "b": [2.0, 4.0, 6.0, 8.0, 10.0]})
    assert f["a"].corr(f["b"]) == pytest.approx(1) and f["a"].cov(f["a"]) == pytest.approx(2)
    assert [r["b"] for r in f.corr().collect()] == pytest.approx([1, 1])
    assert s(spark, [1.0, 2.0, 9.0, 4.0]).skew() == pytest.approx(0.7684, abs=1e-3)
    assert math.isnan(s(spark, [1.0, 2.0]).skew()) and math.isnan(s(spark, [1.0, 1.0, 1.0, 1.0]).kurt())
    assert f["a"].quantile(0.5) == 3 and math.isnan(s(spark, [None], "float64").quantile(0.5))
    assert listed(s(spark, ["b", "a", "b", "a", None]).mode()) == ["b", "a"]
    assert s(spark, ["b", None, "b"]).nunique() == 1


def test_duplicates(spark):
    x = s(spark, ["a", "b", "a", None, "b", None])
    assert listed(x.duplicated()) == [False, False, True, False, True, False]
    assert listed(x.duplicated("last")) == [True, True, False, False, False, False]
    assert listed(x.duplicated("none")) == [True, True, True, False, True, False]
    assert listed(x.drop_duplicates()) == ["a", "b", None, None]
    assert listed(x.unique()) == ["a", "b"] and [tuple(r) for r in x.value_counts().collect()] == [("a", 2), ("b", 2)]
    f = Frame.of(spark, {"a": ["x", "y", "x"], "b": [1, 2, 1]})
    assert f.drop_duplicates().shape()[0] == 2 and f.drop_duplicates(["b"], "none").shape()[0] == 1
    codes, values = s(spark, ["b", "a", "c", "a", None]).factorize()
    assert listed(codes) == [0, 1, 2, 1, None] and [tuple(r) for r in values.orderBy("code").collect()] == [(0, "b"), (1, "a"), (2, "c")]


def test_shapes(spark):
    f = Frame.of(spark, {"date": ["Jan", "Jan", "Feb", "Feb"], "type": ["A", "B", "A", "B"], "val": [10.0, 20.0, 30.0, 40.0]})
    assert sorted(map(tuple, f.pivot("date", "type", "val").collect())) == [("Feb", 30, 40), ("Jan", 10, 20)]
    assert sorted(map(tuple, f.pivot_table("type", "date", "val", "sum").collect())) == [("A", 10, 30), ("B", 20, 40)]
    g = Frame.of(spark, {"name": ["alice"], "math": [90.0], "eng": [85.0]})
    assert sorted(map(tuple, g.melt(["name"]).collect())) == [("alice", "eng", 85), ("alice", "math", 90)]
    a, b = s(spark, [1.0, 2.0, 3.0]).frame, s(spark, [1.0, 5.0, 3.0]).frame
    assert [r["x"] for r in a.compare(b).collect()] == [None, "2.0→5.0", None]
    assert listed(s(spark, ["a,b", "c", None, ""]).explode(",")) == ["a", "b", "c", None, None]
    assert listed(s(spark, [1.0, 5.0, 10.0, 15.0, 20.0]).cut(2)) == ["(1,10.5]"] * 3 + ["(10.5,20]"] * 2
    assert listed(s(spark, [float(i) for i in range(1, 6)]).qcut(2)) == ["[1,3]"] * 3 + ["[3,5]"] * 2
    assert R.convert_dtypes(spark.createDataFrame([("1", "1.5", "x", None)], "a string, b string, c string, d string")).dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "bigint")]
    m = Frame.of(spark, {"dept": ["e", "e", "s"], "level": ["x", "y", "x"], "pay": [1.0, 2.0, 3.0]}).set_multi_index("dept", "level")
    assert sorted(map(tuple, m.unstack(1).collect()), key=str) == [("e", 1, 2), ("s", 3, None)]
    assert m.swap_level(0, 1).index == ("level", "dept") and m.drop_level(0).index == ("level",) and m.rename_level(0, "d").index == ("d", "level")
    assert m.xs(0, "e").shape()[0] == 2 and [r["index"] for r in m.index_labels().collect()] == ["e/x", "e/y", "s/x"]
    assert m.reset_index().df.columns[0] == "_index"


def test_strings(spark):
    x = s(spark, ["  hello wORLD ", "é", None, "a-b-c"])
    assert listed(x.str.strip())[0] == "hello wORLD" and listed(x.str.length()) == [14, 2, None, 5]
    assert listed(x.str.title())[0] == "  Hello WORLD " and listed(x.str.swap_case())[3] == "A-B-C"
    assert listed(x.str.split("-", 1))[3] == "b" and listed(x.str.split("-", 9))[3] == ""
    assert listed(x.str.pad(6, "*", "right"))[3] == "a-b-c*" and listed(x.str.pad(2, "*"))[3] == "a-b-c"
    assert listed(x.str.contains("["))[3] is False and listed(x.str.count("[a-c]"))[3] == 3
    n = s(spark, ["123", "1e5", "12a", "", " 1", "1\n", "1.0d"])
    assert listed(n.str.is_numeric()) == [True, True, False, False, False, False, False]
    assert listed(n.str.is_digit()) == [True, False, False, False, False, False, False]
    assert listed(s(spark, ["a1b22"]).str.extract_all("[0-9]+")) == ["1,22"] and listed(s(spark, ["a1"]).str.extract("x(.)")) == [""]


def test_times(spark):
    ts = s(spark, [dt.datetime(2024, 1, 15, 10, 30), dt.datetime(2024, 3, 20, 14, 45, 30), None])
    assert listed(ts.dt.year()) == [2024, 2024, None] and listed(ts.dt.day_of_week())[0] == 1 and listed(ts.dt.time_text())[1] == "14:45:30"
    hour = TM.nanos(hours=1)
    assert listed(ts.dt.floor(hour))[1] == dt.datetime(2024, 3, 20, 14) and listed(ts.dt.ceil(hour))[1] == dt.datetime(2024, 3, 20, 15) and listed(ts.dt.round_to(hour))[0] == dt.datetime(2024, 1, 15, 11)
    assert listed(ts.dt.shift(hour))[0] == dt.datetime(2024, 1, 15, 11, 30)
    week = listed(ts.dt.floor(TM.nanos(days=7)))[0]
    assert week == dt.datetime(2024, 1, 15)  # a Monday
    d = s(spark, [TM.nanos(days=1, hours=2, minutes=3, seconds=4), None])
    assert listed(d.duration.format_duration()) == ["1d2h3m4s", None] and listed(d.duration.to_unit("hours"))[0] == pytest.approx(26.05111, abs=1e-4)
    assert math.isnan(listed(d.duration.divided(0))[0])
    assert listed(ts.dt.localize("Europe/Berlin"))[0] == dt.datetime(2024, 1, 15, 9, 30) and listed(ts.dt.convert("Europe/Berlin"))[0] == dt.datetime(2024, 1, 15, 11, 30)


def test_time_groups(spark):
    f = Frame.of(spark, {"ts": [dt.datetime(2024, 1, 1) + dt.timedelta(hours=i) for i in range(48)], "val": [float(i + 1) for i in range(48)]})
    half = f.group_by_dynamic("ts", TM.nanos(hours=12))
    assert [r["val_sum"] for r in half.agg({"val": "sum"}).orderBy("ts").collect()] == [78, 222, 366, 510]
    assert half.closed("right").agg({"val": "count"}).count() == 5
    assert "period" in half.info()
    from dataclasses import replace

    both = replace(f.group_by_dynamic("ts", TM.nanos(hours=24), TM.nanos(hours=12)), overlapping=True)
    assert sum(r["val_count"] for r in both.agg({"val": "count"}).collect()) == 96
    assert [r["val"] for r in f.resample("ts", TM.nanos(days=1), "last").orderBy("ts").collect()] == [24, 48]
    assert f.group_rolling_time("ts", TM.nanos(hours=2), [], "val", "count").count() == 48


def test_functions(people):
    assert listed(people["age"].apply(lambda v: f"<{v}>"))[0] == "<25>"
    assert listed(people["name"].map_string(str.upper))[1] == "BOB" and listed(people["age"].map_float(lambda v: v / 5))[0] == 5
    assert listed(people.transform(lambda c: c * 2)["age"])[0] == 50 and listed(people.apply_cols(lambda c: c.cast("string"))["age"])[0] == "25"
    assert people.apply_rows(lambda r: {"n": r["age"] + 1}, "n long").count() == 4


def test_expressions(people):
    lazy = people.lazy().filter((col("age") > 25) & ~(col("name") == "dave")).with_column("half", col("score") / lit(2)).select(col("name").str_upper(), (col("age") + col("half")).alias("sum"))
    assert sorted(map(tuple, lazy.collect().collect())) == [("BOB", 76.0), ("CHARLIE", 73.25)]
    one = people.lazy().select(col("age").first(), col("age").last(), col("score").median()).collect().first()
    assert (one["age_first"], one["age_last"], one["score_median"]) == (25, 40, 90.25)
    mixed = people.lazy().select(col("name"), col("age").max()).collect().collect()
    assert len(mixed) == 4 and {r["age_max"] for r in mixed} == {40}
    assert "Filter" in people.lazy().filter(col("age") > 30).describe()
    assert repr((col("a") + lit(1)).alias("b")) == "(a + 1) as b"
    assert listed(people.with_column("c", col("score").clip(80, 90).cast("int64").fill_na(0))["c"]) == [88, 90, 80, 90]


def test_sql(spark, people):
    sql = SQLContext(spark).register("people", people.data()).register("depts", spark.createDataFrame([(25, "x"), (30, "y")], "age int, dept string"))
    assert sql.query("SELECT name FROM people WHERE (age > 25 AND score > 90) OR name LIKE 'al%'").count() == 3
    assert sql.query("SELECT dept, STD(score) AS s FROM people JOIN depts ON people.age = depts.age GROUP BY dept").count() == 2
    assert rewrite("SELECT 'STD(' || x, std (y)") == "SELECT 'STD(' || x, stddev_pop(y)"
    assert not spark.catalog.tableExists("people")


def test_types():
    assert promote("int8", "int64") == "int64" and promote("int32", "float64") == "float64" and promote("int8", "uint8") == "int16" and promote("string", "int8") == "float64"
    assert is_integer("uint8") and is_float("float32") and is_numeric("int8") and not is_numeric("bool") and not is_signed("uint8")
    assert from_spark(to_spark("int32")) == "int32" and from_spark(to_spark("uint64")) == "uint64"
    with pytest.raises(ValueError):
        to_spark("nothing")


def test_categorical(spark):
    c = s(spark, ["b", "a", "", None, "b"]).categorical()
    assert c.categories == ("b", "a") and c.null_count() == 2 and c.code("a") == 1
    assert [tuple(r) for r in c.add(["z"]).value_counts().collect()] == [(0, "b", 2), (1, "a", 1), (2, "z", 0)]
    assert c.remove(["b"]).null_count() == 4 and c.reorder(["a", "b"]).codes() is not None
    assert [r["__x"] for r in c.sort(False, ["__idx"]).collect()] == ["", None, "a", "b", "b"]
    assert str(s(spark, ["b", "a"]).categorical(True)) == "Categorical(__x: a < b)"


def test_buckets_give_the_same_rows(spark):
    """Running, shifted and filled columns don't depend on how rows are dealt into buckets."""
    from quillframe.operators import window as W

    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 7 != 0, (F.col("id") * 37 % 101).cast("double")).alias("v"))
    for fn in W.CUMULATIVE[:1] + W.CUMULATIVE[2:]:
        a = W.cumulative(df, "v", fn, ["id"], name="w", bucket_rows=64)
        assert a.exceptAll(W.cumulative(df, "v", fn, ["id"], name="w")).count() == 0
    a = W.rolling(df, "v", "mean", 9, ["id"], min_periods=2, name="w", block=16)
    assert a.exceptAll(W.rolling(df, "v", "mean", 9, ["id"], min_periods=2, name="w")).count() == 0
    assert NU.fill_forward(df, ["v"], ["id"]).where("v is null").count() == 1
