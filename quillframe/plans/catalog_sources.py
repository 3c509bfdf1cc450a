"""Queries on sources and sinks: tables are written, read back and compared as a whole."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frame import Frame
from ..sources import database as DB
from ..sources import excel as XL
from ..sources import files as IO
from ..sources.scan import scan_csv, scan_parquet
from ..sources.scratch import scratch_path
from ..streaming import for_each_batch, read_stream, windowed, write_stream
from .catalog import query, t

_PART = "SELECT p_partkey, p_name, p_size::BIGINT AS p_size, p_retailprice FROM part"


def _part(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::BIGINT AS l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def csv_file(spark, d):
    path = scratch_path(spark, "csv")
    Frame(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("l_quantity"), "l_extendedprice", "l_returnflag")).write_csv_file(path)
    return IO.read_csv_file(spark, path, sample=None)


@query("SELECT c_custkey::VARCHAR AS col0, c_name AS col1, c_acctbal::VARCHAR AS col2 FROM customer")
def csv_without_header(spark, d):
    path = scratch_path(spark, "csv")
    t(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string")).repartition(5, "c_custkey").write.option("sep", ";").csv(path)
    return IO.read_csv_file(spark, path, ";", header=False, infer=False)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def csv_skip_lines(spark, d):
    """Many small files, each with two lines of its own before the header."""
    path = scratch_path(spark, "csv")
    rows = t(spark, d, "orders").select(F.concat_ws(";", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"), F.pmod("o_orderkey", F.lit(30)).alias("part"))
    heads = spark.range(30).select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("value")) for k, v in enumerate(("made by hand", "in two lines", "o_orderkey;o_custkey;o_orderstatus"))])).alias("h"), F.col("id").alias("part")).select("part", "h.k", "h.value")
    body = rows.select("part", F.lit(3).alias("k"), "value")
    heads.unionByName(body).repartition(30, "part").sortWithinPartitions("part", "k").select("part", "value").write.partitionBy("part").text(path)
    return IO.read_csv_file(spark, f"{path}/*", ";", skip_lines=2, sample=None)


@query("SELECT n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def csv_text(spark, d):
    return IO.read_csv(spark, IO.to_csv(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"]))


@query("SELECT n_nationkey, n_name || E'\\nand \"more\"' AS n_name FROM nation")
def csv_line_breaks(spark, d):
    path = scratch_path(spark, "csv")
    IO.write_csv_file(t(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit('\nand "more"')).alias("n_name")), path)
    return IO.read_csv_file(spark, path, multi_line=True)


@query(f"{_PART} UNION ALL {_PART} WHERE p_size > 25")
def csv_chunks(spark, d):
    path = scratch_path(spark, "csv")
    with IO.csv_writer(path) as out:
        out.write_chunk(_part(spark, d))
        out.write_chunk(_part(spark, d).where("p_size > 25"))
    return IO.read_csv_file(spark, path, sample=None)


@query("SELECT r_regionkey, r_name FROM region")
def json_file(spark, d):
    path = scratch_path(spark, "json")
    IO.write_json_file(t(spark, d, "region").select("r_regionkey", "r_name"), path, ["r_regionkey"])
    return IO.read_json_file(spark, path)


@query("SELECT r_regionkey, r_name FROM region")
def json_text(spark, d):
    return IO.read_json(spark, IO.to_json(t(spark, d, "region").select("r_regionkey", "r_name")))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS p FROM orders")
def json_lines_file(spark, d):
    path = scratch_path(spark, "jsonl")
    IO.write_json_lines_file(t(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("p")), path)
    return IO.read_json_lines_file(spark, path)


@query("SELECT n_nationkey, n_name FROM nation")
def json_lines_text(spark, d):
    return IO.read_json_lines(spark, IO.to_json_lines(t(spark, d, "nation").select("n_nationkey", "n_name")))


@query(f"{_PART} UNION ALL {_PART}")
def json_chunks(spark, d):
    path = scratch_path(spark, "jsonl")
    with IO.json_writer(path) as out:
        out.write_chunk(_part(spark, d))
        out.write_chunk(_part(spark, d))
    return IO.read_json_lines_file(spark, path)


@query("SELECT * FROM orders")
def parquet_file(spark, d):
    path = scratch_path(spark, "parquet")
    IO.write_parquet_file(t(spark, d, "orders"), path)
    return IO.read_parquet_file(spark, path)


@query("SELECT p_partkey, p_size FROM part UNION ALL SELECT p_partkey, NULL FROM part")
def parquet_chunks(spark, d):
    path = scratch_path(spark, "parquet")
    with IO.parquet_writer(path) as out:
        out.write_chunk(t(spark, d, "part").select("p_partkey", "p_size"))
        out.write_chunk(t(spark, d, "part").select("p_partkey", F.lit("no number").alias("p_size")))
    return IO.read_parquet_file(spark, path)


@query("SELECT n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def excel_file(spark, d):
    path = scratch_path(spark, "book") + ".xlsx"
    XL.write_excel_file(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return XL.read_excel_file(spark, path)


@query("SELECT S_SUPPKEY, S_NAME, S_ACCTBAL FROM (SELECT s_suppkey AS S_SUPPKEY, s_name AS S_NAME, s_acctbal AS S_ACCTBAL FROM supplier)")
def database_table(spark, d):
    """An embedded database, which in a cluster only the driver reads and writes."""
    url, driver = f"jdbc:derby:memory:{scratch_path(spark, 'db').rsplit('-', 1)[-1]};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    DB.write_sql(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), url, "suppliers", driver)
    return DB.read_sql(spark, url, 'SELECT "s_suppkey" AS S_SUPPKEY, "s_name" AS S_NAME, "s_acctbal" AS S_ACCTBAL FROM suppliers', driver)


@query("SELECT 'jdbc:mysql://h:3306/d?user=u&password=p%40' AS my, 'jdbc:postgresql://h:5432/d?user=u&password=p' AS pg")
def database_urls(spark, d):
    return spark.createDataFrame([(DB.mysql_url("u", "p@", "h", 3306, "d"), DB.postgres_url("u", "p", "h", 5432, "d"))], "my string, pg string")


@query("SELECT l_orderkey, l_quantity::BIGINT AS l_quantity FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R'")
def scan_csv_file(spark, d):
    path = scratch_path(spark, "csv")
    IO.write_csv_file(t(spark, d, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("l_quantity"), "l_returnflag"), path)
    return scan_csv(spark, path).filter("l_quantity", ">", 45).filter("l_returnflag", "=", "R").select("l_orderkey", "l_quantity").collect()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 20 ORDER BY o_orderkey LIMIT 10 OFFSET 5")
def scan_csv_part(spark, d):
    path = scratch_path(spark, "csv")
    rows = t(spark, d, "orders").select(F.format_string("%09d;%d", "o_orderkey", "o_custkey").alias("value"))
    lines = spark.createDataFrame([(0, "a remark"), (1, "o_orderkey;o_custkey")], "k int, value string").unionByName(rows.select(F.lit(2).alias("k"), "value"))
    lines.repartition(1).sortWithinPartitions("k", "value").select("value").write.text(path)
    return scan_csv(spark, path).delimiter(";").skip_lines(1).filter("o_custkey", ">", 20).select("o_orderkey", "o_custkey").limit(10).offset(5, ["o_orderkey"]).collect()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def scan_parquet_file(spark, d):
    return scan_parquet(spark, f"{d}/orders.parquet").filter("o_totalprice", ">", 150000).filter("o_orderstatus", "==", "F").select("o_orderkey", "o_totalprice").collect()


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20")
def scan_parquet_part(spark, d):
    return scan_parquet(spark, f"{d}/orders.parquet").select("o_orderkey").offset(0, ["o_orderkey"]).limit(20).collect()


@query("SELECT k AS chunk, count(*) AS n, min(event_id) AS low, max(event_id) AS high FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 300 AS k FROM events WHERE value > 20) GROUP BY 1")
def scan_chunks(spark, d):
    def bounds(k: int, rows: pa.Table) -> pa.Table:
        ends = pc.min_max(rows["event_id"]).as_py()
        return pa.table({"chunk": [k], "n": [rows.num_rows], "low": [ends["min"]], "high": [ends["max"]]})

    return scan_parquet(spark, f"{d}/events.parquet").filter("value", ">", 20).map_chunks(300, bounds, "chunk long, n long, low long, high long", ["event_id"])


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_batches(spark, d):
    source, out = scratch_path(spark, "events"), scratch_path(spark, "sums")
    rows = t(spark, d, "events")
    rows.repartition(6, "event_id").write.parquet(source)
    for_each_batch(read_stream(spark, source, rows.schema), lambda df, k: df.groupBy("event_type").count().write.mode("append").parquet(out), scratch_path(spark, "marks"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("count").alias("n"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n, round(sum(value), 4) AS s FROM events GROUP BY 1")
def stream_windows(spark, d):
    """The copy of a stream, and the windows of its rows."""
    source, out = scratch_path(spark, "events"), scratch_path(spark, "copy")
    rows = t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    rows.repartition(3, "event_id").write.parquet(source)
    write_stream(read_stream(spark, source, rows.schema), out, scratch_path(spark, "marks"))
    sums = windowed(spark.read.parquet(out), "ts", "1 day", [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s")])
    return sums.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "s")
