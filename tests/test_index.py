import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillframe import Frame, ListIndex, MultiIndex, SeriesBuilder, concat, default_index, series
from quillframe.functions import temporal as TM
from quillframe.operators.timegroup import ResampleRule


def test_labels(spark):
    r = default_index(5)
    assert len(r) == 5 and r.get(3) == "3" and len(r.slice(1, 9)) == 4 and r.slice(4, 2).get is not None and len(r.slice(4, 2)) == 0
    with pytest.raises(IndexError):
        r.get(5)
    assert ListIndex.of_int([7, 8]).slice(1, 2).get(0) == "8"
    assert ListIndex.of_time([dt.datetime(2024, 1, 2, 3)]).get(0) == "2024-01-02T03:00:00Z"
    assert r.to_frame(spark).count() == 5 and ListIndex.of_string(["a"]).to_frame(spark).first()[0] == "a"


def test_levels(spark):
    m = MultiIndex.from_tuples([("e", "x"), ("e", "y"), ("s", "x")], ["dept", "level"])
    assert (len(m), m.n_levels, m.get(1), m.get_level(1, 9), m.xs(0, "e"), m.level_values(1)) == (3, 2, ("e", "y"), "", [0, 1], ["x", "y", "x"])
    assert m.to_index().get(2) == "s/x" and m.levels == [["e", "s"], ["x", "y"]]
    assert m.swap_level(0, 1).get(1) == ("y", "e") and m.swap_level(0, 5) is m and m.drop_level(0).names == ("level",) and m.drop_level(0).drop_level(0).n_levels == 1
    assert m.rename_level(1, "z").names == ("dept", "z") and len(m.slice(1, 3)) == 2 and str(m).startswith("dept level\ne x")
    assert MultiIndex.from_codes([["a", "b"]], [[1, 0, 1]], ["k"]).tuples == (("b",), ("a",), ("b",))
    assert m.to_frame(spark).columns == ["dept", "level"]


def test_building(spark):
    b = SeriesBuilder("n", "int64").append(1.9).append_null().append(3)
    assert len(b) == 3 and b.build(spark).to_list() == [1, None, 3]
    assert series(spark, "x", [1, 2], "int64", [True, False]).to_list() == [1, None]
    assert series(spark, "x", ["a", None, "b"], "string").cat("-") == "a-b"
    a = Frame.of(spark, {"k": [1, 2]})
    assert [r["k"] for r in concat([a, a]).sorted().collect()] == [1, 2, 1, 2]
    assert concat([a, a.rename({"k": "j"})], "columns").df.count() == 2
    assert a.filter_mask([False, True]).shape() == (1, 1)
    d = Frame.of(spark, {"a": [5, 7], "b": [2, None]})
    assert d["a"].duration.minus(d["b"]).to_list() == [3, None] and d["a"].duration.before(d["b"]).to_list() == [False, None]
    hourly = Frame.of(spark, {"ts": [dt.datetime(2024, 1, 1, h) for h in range(6)], "v": [1.0] * 6})
    assert [r["v"] for r in ResampleRule(TM.nanos(hours=3), "sum").apply(hourly.df.select("ts", "v"), "ts").orderBy(F.col("ts")).collect()] == [3, 3]
