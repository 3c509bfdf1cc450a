"""File streams by micro-batches. The checkpoint says where to go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType | str, format: str = "parquet", files_per_batch: int = 1, **options: str) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).load(path)


def for_each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str) -> int:
    """Call ``fn`` with every micro-batch that is there and its number; the number of rows passed.

    A later call with the same checkpoint goes on behind what was passed.
    """
    rows = 0

    def counted(batch: DataFrame, number: int) -> None:
        nonlocal rows
        fn(batch, number)
        rows += batch.count()

    query = stream.writeStream.foreachBatch(counted).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return rows


def write_stream(stream: DataFrame, path: str, checkpoint: str, format: str = "parquet", **options: str):
    """Append what is there to a table, each row once."""
    query = stream.writeStream.format(format).option("path", path).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
