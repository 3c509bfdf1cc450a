"""Times headline queries; prints one JSON line.

``BENCH_SF_DIR``: the folder of tables; ``BENCH_CPUS``: the threads. Each query runs once to warm
up and once on the clock, into Spark's no-op sink, so that every row is made.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from quillframe.plans import catalog
from quillframe.session import session
from quillframe.sources.files import read_csv_file
from quillframe.sources.scan import scan_csv
from quillframe.sources.scratch import delete_path, scratch_path

NAMES = (
    "pricing_summary agg_registry agg_after_join group_transform group_filter filter_project head sort_by drop_duplicates value_counts nlargest row_index join_inner join_outer join_semi join_asof join_asof_by "
    "rolling_mean rolling_by_user cumsum fill_forward rank_average date_parts dynamic_weeks resample rolling_time arithmetic strings describe moments pivot_table melt cut sql_query lazy_plan"
).split()


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="8g", spark_ui_enabled="false", spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def clock(name: str, make) -> None:
        for _ in range(2):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 4)

    for name in NAMES:
        clock(name, lambda q=catalog.QUERIES[name]: q(spark, folder))
    path = scratch_path(spark, "lineitem")
    spark.read.parquet(f"{folder}/lineitem.parquet").write.option("header", "true").csv(path)
    clock("csv_read_filter", lambda: read_csv_file(spark, path).where(F.col("l_quantity") > 45))
    clock("csv_scan_filter", lambda: scan_csv(spark, path).filter("l_quantity", ">", 45).select("l_orderkey", "l_quantity").collect())
    delete_path(spark, path)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
