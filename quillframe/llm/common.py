"""What the corpus operators share: the shared folder, written tables, row keys, table readers."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: str | None = None
#: Written tables: the path, and a weak reference of the JVM to the file index by which plans read it.
_held: list[tuple[str, object]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only a local session may name none, as in tests; it gets a temporary folder.
    """
    global _own_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = "file://" + tempfile.mkdtemp(prefix="quillframe-")
    return _own_dir


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/quillframe/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, per_core: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    It cuts the lineage: a lost executor costs the tasks that were running, not the table, and
    the shuffle files before it can go. ``per_core``: files for each core of the cluster at most;
    not for frames that end in a function of Python, as its tasks would be as few. The table is
    deleted after all plans that read it are gone (see :func:`sweep`).
    """
    spark = df.sparkSession
    spark._jvm.System.gc()  # plans are large: without it the driver's heap grows to its limit
    sweep(spark)
    path = shared_path(spark, name)
    if per_core:
        df = df.coalesce(per_core * spark.sparkContext.defaultParallelism)
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    index = out._jdf.queryExecution().analyzed().collectLeaves().apply(0).relation().location()
    _held.append((path, spark._jvm.java.lang.ref.WeakReference(index)))
    return out


def sweep(spark: SparkSession) -> None:
    """Delete the written tables that no plan in the JVM reads any more.

    A frame and what was made of it share the file index of the table that they read, so a table
    stays as long as anybody holds one of them, and goes some time after.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path, index in list(_held):
        if index.refersTo(None):
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
            _held.remove((path, index))


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that nobody holds any more, as after a written table, and sweep.

    It would do so by itself at the driver's next garbage collections, which may come late.
    """
    for _ in range(2):  # the first round lets go of the frames, the second of what they held
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)
    sweep(spark)


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with a binary column ``name`` that tells rows apart and is the same at every reading.

    For a plain scan of Parquet files it is made of the file's hash (64 bits of its path) and the
    row's place in it; any other frame is written first, with numbers.
    """
    code = lambda high, low: F.unhex(F.concat(*[F.lpad(F.hex(x), 16, "0") for x in (high, low)]))
    if "_metadata" not in docs.columns and _plain_scan(docs):
        return docs.withColumn(name, code(F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")))
    return written(docs.withColumn(name, code(F.lit(0).cast("long"), F.monotonically_increasing_id())), "numbered")


def _plain_scan(df: DataFrame) -> bool:
    """Whether a frame is a scan of Parquet files, with projections and filters at most."""
    node = df._jdf.queryExecution().analyzed()
    kind = lambda x: x.getClass().getSimpleName()
    while kind(node) in ("Project", "Filter", "SubqueryAlias"):
        node = node.child()
    return kind(node) == "LogicalRelation" and kind(node.relation()) == "HadoopFsRelation" and kind(node.relation().fileFormat()) == "ParquetFileFormat"


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file through Hadoop's file systems, whatever the scheme of the path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        for at in range(0, len(data), 1 << 20):
            stream.write(bytearray(data[at : at + (1 << 20)]))
    finally:
        stream.close()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Limit the session's Arrow batches to ``size`` bytes: by rows alone, long texts make huge ones."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Cut record batches to at most ``rows`` rows, so that Python's copies stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
