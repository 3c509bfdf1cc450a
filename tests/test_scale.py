"""What holds at scale: buckets of any keys, quantiles with bounded state, groups that aren't brought together."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.operators import agg as A
from quillframe.operators import join as J
from quillframe.operators import order as O
from quillframe.operators import stats as ST
from quillframe.plans.sql import SQLContext


@pytest.mark.parametrize("keys", [["same", "id"], ["name"], ["maybe", "id"], ["when", "id"]])
def test_buckets_follow_all_keys(spark, keys):
    rows = spark.range(900).select("id", F.lit("x").alias("same"), F.format_string("Customer#%09d", "id").alias("name"), F.when(F.col("id") % 3 > 0, F.col("id") / 7).alias("maybe"), F.timestamp_seconds(F.col("id") % 5).cast("timestamp_ntz").alias("when"))
    dealt = O.bucketed(rows, keys, 100)
    sizes = [r["count"] for r in dealt.groupBy(O.BUCKET).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 400
    spec = Window.partitionBy(F.lit(0)).orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    falls = dealt.withColumn("before", F.lag(O.BUCKET).over(spec)).where(F.col("before") > F.col(O.BUCKET))
    assert falls.count() == 0
    at = O.indexed(rows, keys, "at", bucket_rows=100).withColumn("want", F.row_number().over(spec) - 1)
    assert at.where("at <> want").count() == 0


def test_buckets_of_one_key(spark):
    assert {r[O.BUCKET] for r in O.bucketed(spark.range(500).select(F.lit(None).cast("string").alias("k")), ["k"], 50).collect()} <= {0, 1}
    assert O.bucketed(spark.range(0), ["id"]).count() == 0


@pytest.mark.parametrize("kind", ["spread", "ties", "few"])
def test_quantiles_narrow_down(spark, monkeypatch, kind):
    monkeypatch.setattr(ST, "PICKED", 40)
    monkeypatch.setattr(ST, "ACCURACY", 20)
    rng = random.Random(4)
    values = {"spread": [rng.gauss(0, 100) for _ in range(3000)], "ties": [float(rng.choice([1, 2, 2, 2, 7])) for _ in range(3000)], "few": [3.0, 1.0]}[kind]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    ps = [0.0, 0.01, 0.25, 0.5, 0.77, 0.999, 1.0]
    assert ST.quantiles(df, {"x": ps})["x"] == pytest.approx(np.quantile(values, ps).tolist())
    assert all(v != v for v in ST.quantiles(df.where("x is null"), {"x": ps})["x"])


def test_group_quantiles(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 5.0, 9.0])) for _ in range(300)]
    got = {r["k"]: r["q"] for r in A.group_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", [0.1, 0.5]).collect()}
    for k in ("a", "b", None):
        assert got[k] == pytest.approx(np.quantile([x for key, x in rows if key == k and x is not None], [0.1, 0.5]).tolist())


def test_asof_over_buckets(spark):
    rng = random.Random(6)
    left = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, *range(400)])) for i in range(300)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(0, 400, 9)]), k) for k in range(60)]
    got = {r["i"]: r["v"] for r in J.asof(spark.createDataFrame(left, "i long, k string, t long"), spark.createDataFrame(right, "k string, t long, v long"), "t", ["k"], bucket_rows=20).collect()}
    for i, k, t in left:
        found = [(u, v) for g, u, v in right if g == k and u is not None and t is not None and u <= t]
        assert got[i] == (max(found)[1] if found else None)


def test_queries_leave_the_views_of_the_session(spark):
    spark.range(3).createOrReplaceTempView("cust")
    own = SQLContext(spark).register("cust", spark.range(10).withColumnRenamed("id", "n"))
    out = own.query("WITH big AS (SELECT n FROM cust WHERE n > 4) SELECT count(*) AS n, MEDIAN(cust.n) AS m FROM cust JOIN big USING (n)")
    assert tuple(out.first()) == (5, 7.0)
    assert spark.table("cust").count() == 3
    spark.catalog.dropTempView("cust")


def test_ewm_streams_over_batches(spark):
    from quillframe.operators import window as W

    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, 1.0, 5.0, -2.0, 8.0, 3.5])) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, k string, x double")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["i"]: r["w"] for r in W.ewm_mean(df, "x", ["i"], alpha=0.3, partition_by=["k"], name="w").collect()}
        whole = {r["i"]: r["w"] for r in W.ewm_mean(df, "x", ["i"], span=4, name="w").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)

    def plain(own, alpha):
        mean, out = None, {}
        for i, _, x in own:
            mean = None if x is None else x if mean is None else alpha * x + (1 - alpha) * mean
            out[i] = mean
        return out

    want = {i: v for k in ("a", "b", None) for i, v in plain([r for r in rows if r[1] == k], 0.3).items()}
    for found, wanted in ((got, want), (whole, plain(rows, 0.4))):
        for i in wanted:
            assert found[i] is None and wanted[i] is None or found[i] == pytest.approx(wanted[i])
