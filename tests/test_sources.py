"""Readers and writers on files in a temporary folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pyspark
import pytest
from pyspark.sql import functions as F

from quillframe.sources import database, excel
from quillframe.sources import files as IO
from quillframe.sources.scan import scan_csv, scan_parquet
from quillframe.streaming import for_each_batch, read_stream, windowed, write_stream


def test_csv_text(spark):
    df = IO.read_csv(spark, "name,age,score\na,1,1.5\nb,,x\nc,3,2.5\nd,4,3\ne,5,4\nf,6,5\n")
    assert df.dtypes == [("name", "string"), ("age", "bigint"), ("score", "double")]
    assert df.where("score is null").count() == 1 and df.where("age is null").count() == 1
    assert IO.read_csv(spark, "x;y\n1;yes\n2;no\n", sep=";").dtypes == [("x", "bigint"), ("y", "boolean")]
    assert IO.read_csv(spark, "# c\n# d\nx,y\n1,2\n", skip_lines=2).columns == ["x", "y"]
    assert IO.read_csv(spark, "1,2\n3,4\n", header=False).columns == ["col0", "col1"]
    with pytest.raises(ValueError):
        IO.read_csv(spark, "only,header\n")


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('skip\nname,note\nx,"a, ""b"""\ny,\n')
    df = IO.read_csv_file(spark, str(tmp_path / "a.csv"), skip_lines=1)
    assert sorted((r["name"], r["note"]) for r in df.collect()) == [("x", 'a, "b"'), ("y", None)]
    (tmp_path / "b.csv").write_text("1,a\n2,b\n")
    assert IO.read_csv_file(spark, str(tmp_path / "b.csv"), header=False).columns == ["col0", "col1"]
    out = str(tmp_path / "out")
    IO.write_csv_file(df, out)
    assert IO.read_csv_file(spark, out).count() == 2
    assert IO.to_csv(spark.range(2).withColumn("b", F.lit(None).cast("string")), ["id"]) == "id,b\n0,\n1,\n"


def test_json(spark, tmp_path):
    df = IO.read_json(spark, '[{"a": 1, "b": {"c": [1]}}, {"a": 2.5, "d": true}]')
    assert df.dtypes == [("a", "double"), ("b", "string"), ("d", "boolean")] and df.first()["b"] == '{"c": [1]}'
    lines = IO.read_json_lines(spark, '{"a": 1}\n{"a": null, "b": "x"}\n')
    assert lines.count() == 2 and IO.to_json_lines(lines.where("b = 'x'")) == '{"a":null,"b":"x"}\n'
    IO.write_json_lines_file(lines, str(tmp_path / "j"))
    assert IO.read_json_lines_file(spark, str(tmp_path / "j")).count() == 2
    IO.write_json_file(lines, f"file://{tmp_path}/one.json")
    assert IO.read_json_file(spark, str(tmp_path / "one.json")).count() == 2
    assert '"a": 1' in IO.to_json(lines)


def test_chunk_writers(spark, tmp_path):
    for make, kind in ((IO.csv_writer, "csv"), (IO.json_writer, "json"), (IO.parquet_writer, "parquet")):
        with make(str(tmp_path / kind)) as w:
            w.write_chunk(spark.createDataFrame([(1, "a")], "n long, t string"))
            w.write_chunk(spark.createDataFrame([("2", "b"), ("x", "c")], "n string, t string"))
        with pytest.raises(ValueError):
            w.write_chunk(spark.range(1))
        back = spark.read.format(kind).option("header", "true").load(str(tmp_path / kind))
        assert back.count() == 3 and back.where("n is null").count() == 1


def test_parquet_scan(spark, tmp_path):
    p = str(tmp_path / "p")
    IO.write_parquet_file(spark.createDataFrame([("a", 25, 1.0), ("b", 30, 2.0), ("c", None, 3.0), ("d", 40, 4.0)], "name string, age int, score double"), p)
    scan = scan_parquet(spark, p).filter("age", ">", 26).select("name", "nothing")
    assert sorted(r["name"] for r in scan.collect().collect()) == ["b", "d"] and scan.limit(1).collect().count() == 1
    plan = scan_parquet(spark, p).filter("age", ">", 26).select("name").collect()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(age,26)" in plan and "score" not in plan
    with pytest.raises(ValueError):
        scan.filter("age", "~", 1)


def test_csv_scan(spark, tmp_path):
    (tmp_path / "c.csv").write_text("id,n\n" + "".join(f"{i},{i * 3}\n" for i in range(40)))
    scan = scan_csv(spark, str(tmp_path / "c.csv")).filter("n", ">", 90)
    assert scan.collect().count() == 9 and scan.select("id").offset(2, ["id"]).collect().count() == 7
    with pytest.raises(ValueError):
        scan.select("zz").collect()
    seen = []
    assert scan.for_each(4, lambda df: seen.append([r["id"] for r in df.collect()]), ["id"]) == 9
    assert seen == [[31, 32, 33, 34], [35, 36, 37, 38], [39]]


def test_chunks_on_executors(spark, tmp_path):
    spark.range(20_000).select(F.pmod(F.col("id") * 7919, F.lit(20_000)).alias("id"), (F.col("id") % 10).alias("v")).repartition(5).write.parquet(str(tmp_path / "p"))
    scan = scan_parquet(spark, str(tmp_path / "p")).filter("v", "<", 8).select("id")
    kept = sorted(r["id"] for r in scan.collect().collect())
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chunks", "")
    made = scan.map_chunks(7, lambda k, rows: pa.table({"chunk": [k], "ids": [rows["id"].to_pylist()]}), "chunk long, ids array<bigint>", ["id"])
    found = {r["chunk"]: r["ids"] for r in made.collect()}
    assert found == {k: kept[7 * k : 7 * k + 7] for k in range(-(-len(kept) // 7))}
    assert len(jobs.getJobIdsForGroup("chunks")) < 40  # not some for each of 2,286 chunks
    nothing = scan.filter("id", "<", 0).map_chunks(7, lambda k, rows: rows, "id long", ["id"])
    assert nothing.count() == 0


def test_excel(spark, tmp_path):
    path = f"file://{tmp_path}/b.xlsx"
    df = spark.createDataFrame([("a & <b>", 1, 1.5, True), (None, 2, None, False)], "t string, n long, f double, b boolean")
    excel.write_excel_file(df, path, "Data")
    back = excel.read_excel_file(spark, path, "Data")
    assert [tuple(r) for r in back.collect()] == [("a & <b>", 1, 1.5, True), (None, 2, None, False)]
    assert excel.read_excel_file(spark, path).columns == df.columns
    with pytest.raises(ValueError):
        excel.read_excel_file(spark, path, "Other")


def test_database(spark, tmp_path):
    assert database.mysql_url("u", "p@", "h", 1, "d") == "jdbc:mysql://h:1/d?user=u&password=p%40"
    assert database.postgres_url("u", "p", "h", 2, "d").startswith("jdbc:postgresql://h:2/d")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.createDataFrame([(1, 1.5, True), (2, None, False)], "id int, v double, b boolean")
    database.write_sql(df, url, "things", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = database.read_sql(spark, url, "SELECT * FROM things", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted(r["ID"] if "ID" in back.columns else r["id"] for r in back.collect()) == [1, 2]
    assert database.column_types(df) == "id BIGINT, v DOUBLE PRECISION, b BOOLEAN"


def test_embedded_database_by_the_driver(spark, tmp_path, monkeypatch):
    driver = "org.apache.derby.jdbc.EmbeddedDriver"
    url = f"jdbc:derby:{tmp_path}/own;create=true"
    assert not database.only_driver(spark, url)
    monkeypatch.setattr(database, "only_driver", lambda spark, url: True)
    monkeypatch.setattr(database, "CHUNK_ROWS", 7)
    rows = [(k, None if k % 3 else k / 4, f"t {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "id int, v double, t string").repartition(3)
    database.write_sql(df, url, "things", driver, createTableColumnTypes="t varchar(20)")
    read = lambda q: sorted(tuple(r) for r in database.read_sql(spark, url, q, driver).collect())
    assert read('SELECT "id", "v", "t" FROM things') == rows
    assert read('SELECT "id" FROM things WHERE "id" < 0') == []
    database.write_sql(df, url, "things", driver)
    assert read('SELECT "id", "v", "t" FROM things') == sorted(rows * 2, key=lambda r: r[0])
    database.write_sql(df, url, "things", driver, mode="ignore")
    assert read("SELECT count(*) AS n FROM things") == [(100,)]
    database.write_sql(df.where("id < 5"), url, "things", driver, mode="overwrite")
    assert read("SELECT count(*) AS n FROM things") == [(5,)]


def test_database_table_on_executors(tmp_path):
    """A cluster of two processes, in which executors have no database of the driver's."""
    script = (
        "import sys; from pyspark.sql import SparkSession; from quillframe.plans import catalog\n"
        "c = {'spark.master': 'local-cluster[2,1,1024]', 'spark.executor.memory': '600m', 'spark.ui.enabled': 'false', 'spark.driver.host': '127.0.0.1', 'spark.checkpoint.dir': 'file://' + sys.argv[1] + '/shared'}\n"
        "s = SparkSession.builder.config(map=c).getOrCreate()\n"
        "print('rows', catalog.QUERIES['database_table'](s, '/root/testdata/sf0.001').count()); s.stop()\n"
    )
    home = tmp_path / "home"  # executors' logs go to Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))}
    env |= {"PYTHONPATH": str(Path(__file__).resolve().parents[1]), "PYSPARK_PYTHON": sys.executable, "SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1"}
    done = subprocess.run([sys.executable, "-c", script, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 10\n" in done.stdout, done.stderr[-2000:]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "src")
    rows = spark.range(20).select("id", F.timestamp_seconds(F.col("id") * 1800).alias("ts"))
    rows.repartition(4).write.parquet(src)
    seen = []
    stream = lambda: read_stream(spark, src, rows.schema)
    assert for_each_batch(stream(), lambda df, n: seen.append(df.count()), str(tmp_path / "c1")) == 20 and sum(seen) == 20 and len(seen) == 4
    assert for_each_batch(stream(), lambda df, n: seen.append(0), str(tmp_path / "c1")) == 0  # goes on behind what was passed
    write_stream(stream(), str(tmp_path / "out"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
    counts = windowed(rows, "ts", "2 hours", [F.count("*").alias("n")])
    assert sorted(r["n"] for r in counts.collect()) == [4] * 5
