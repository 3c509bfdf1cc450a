"""CSV, JSON and Parquet, from files and from text."""

from __future__ import annotations

import csv as _csv
import io
import json as _json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .infer import typed


def read_csv_file(spark: SparkSession, path: str, sep: str = ",", skip_lines: int = 0, header: bool = True, infer: bool = True, sample: int | None = 100, multi_line: bool = False) -> DataFrame:
    """A CSV file, or several by a pattern, with voted types.

    Without a header the columns are ``col0``, ``col1`` and so on. ``skip_lines`` drops the first
    lines of each file, before the header. The types are voted by the first ``sample`` rows that
    Spark reads, or by all rows with None. ``multi_line``: line breaks in quotes belong to the
    value; a file is then read by one task. With ``skip_lines`` a row is always one line.
    """
    if skip_lines:
        df = _behind_lines(spark, path, sep, skip_lines, header)
        return typed(df, sample) if infer else df
    options = {"sep": sep, "inferSchema": "false", "mode": "PERMISSIVE", "nullValue": "", "emptyValue": "", "quote": '"', "escape": '"', "multiLine": str(multi_line).lower()}
    df = spark.read.options(**options).option("header", str(header).lower()).csv(path)
    if not header:
        df = df.toDF(*[f"col{i}" for i in range(len(df.columns))])
    return typed(df, sample) if infer else df


def _behind_lines(spark: SparkSession, path: str, sep: str, skip_lines: int, header: bool) -> DataFrame:
    """The rows of files as text columns, without the first lines of each file."""
    at = F.monotonically_increasing_id()  # lines of a file's first block follow each other in one task
    lines = spark.read.text(path, lineSep="\n").select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("at"))
    place = F.row_number().over(Window.partitionBy("file").orderBy("at"))
    heads = lines.where("block = 0").withColumn("k", place).where(F.col("k") <= skip_lines + 1)
    first = heads.where(F.col("k") == skip_lines + 1).orderBy("file").select("value").first()
    names = next(_csv.reader([first["value"].rstrip("\r")], delimiter=sep)) if first else []
    columns = names if header else [f"col{i}" for i in range(len(names))]
    if not columns:
        return spark.createDataFrame([], T.StructType([]))
    last = heads.where(F.col("k") <= skip_lines + int(header)).groupBy("file").agg(F.max("at").alias("last"))  # one row for each file
    body = lines.join(last, "file", "left").where((F.col("block") > 0) | (F.col("at") > F.col("last")) | F.col("last").isNull())
    ddl = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    return body.where(F.trim("value") != "").select(F.from_csv(F.regexp_replace("value", r"\r\z", ""), ddl, {"sep": sep, "quote": '"', "escape": '"'}).alias("r")).select("r.*")


def read_csv(spark: SparkSession, data: str, sep: str = ",", skip_lines: int = 0, header: bool = True) -> DataFrame:
    """CSV text. An empty text, or a header without rows, is an error."""
    rows = [r for r in _csv.reader(io.StringIO(data), delimiter=sep) if r][skip_lines:]
    if len(rows) < (2 if header else 1):
        raise ValueError("CSV text needs a header and a row")
    names = rows[0] if header else [f"col{i}" for i in range(len(rows[0]))]
    body = [[*r, *[None] * (len(names) - len(r))][: len(names)] for r in (rows[1:] if header else rows)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return typed(spark.createDataFrame([tuple(r) for r in body], schema))


def write_csv_file(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def to_csv(df: DataFrame, order_by: Sequence[str] = ()) -> str:
    """The frame as one CSV text, null as empty; it is built on the driver, so for small frames."""
    rows = (df.orderBy(*order_by) if order_by else df).collect()
    out = io.StringIO()
    writer = _csv.writer(out, lineterminator="\n")
    writer.writerow(df.columns)
    for r in rows:
        writer.writerow(["" if v is None else (str(v).lower() if isinstance(v, bool) else v) for v in r])
    return out.getvalue()


def _flat(df: DataFrame) -> DataFrame:
    """Nested values as JSON text."""
    nested = (T.StructType, T.ArrayType, T.MapType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_json_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of objects: the union of their keys, a missing key as null, nested values as JSON text."""
    return _flat(spark.read.option("multiLine", "true").json(path))


def read_json_lines_file(spark: SparkSession, path: str) -> DataFrame:
    return _flat(spark.read.json(path))


def _from_objects(spark: SparkSession, objects: list[dict]) -> DataFrame:
    """Objects as a frame: each column takes the type that all its values share, else text."""
    names = list(dict.fromkeys(k for o in objects for k in o))
    fields, columns = [], {}
    for n in names:
        values = [o.get(n) for o in objects]
        known = [v for v in values if v is not None]
        if known and all(isinstance(v, bool) for v in known):
            kind = T.BooleanType()
        elif known and all(isinstance(v, int) and not isinstance(v, bool) for v in known):
            kind = T.LongType()
        elif known and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in known):
            kind, values = T.DoubleType(), [None if v is None else float(v) for v in values]
        else:
            kind, values = T.StringType(), [v if v is None or isinstance(v, str) else _json.dumps(v, ensure_ascii=False) for v in values]
        fields.append(T.StructField(n, kind))
        columns[n] = values
    return spark.createDataFrame(list(zip(*columns.values())) if names else [], T.StructType(fields))


def read_json(spark: SparkSession, data: str) -> DataFrame:
    return _from_objects(spark, _json.loads(data))


def read_json_lines(spark: SparkSession, data: str) -> DataFrame:
    return _from_objects(spark, [_json.loads(x) for x in data.splitlines() if x.strip()])


def json_column(df: DataFrame) -> Column:
    """Each row as a JSON object, nulls included."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def to_json_lines(df: DataFrame, order_by: Sequence[str] = ()) -> str:
    """One JSON object a line, built on the driver, so for small frames."""
    rows = (df.orderBy(*order_by) if order_by else df).select(json_column(df).alias("j")).collect()
    return "".join(r["j"] + "\n" for r in rows)


def to_json(df: DataFrame, order_by: Sequence[str] = ()) -> str:
    """An indented JSON array, built on the driver, so for small frames."""
    rows = (df.orderBy(*order_by) if order_by else df).select(json_column(df).alias("j")).collect()
    return _json.dumps([_json.loads(r["j"]) for r in rows], indent=2, ensure_ascii=False)


def write_json_lines_file(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_json_file(df: DataFrame, path: str, order_by: Sequence[str] = ()) -> None:
    """One JSON array in one file, through Hadoop's file systems; built on the driver, so for small frames."""
    _write_text(df.sparkSession, path, to_json(df, order_by))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_parquet_file(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet file with its own types."""
    return spark.read.parquet(path)


def write_parquet_file(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


class ChunkWriter:
    """Appends frames to one CSV, JSON or Parquet table.

    The first frame fixes the types; later ones are cast to them, and what can't be is null.
    """

    def __init__(self, path: str, format: str):
        self.path, self.format = path, format
        self.schema: T.StructType | None = None
        self.closed = False

    def write_chunk(self, df: DataFrame) -> None:
        if self.closed:
            raise ValueError("the writer is closed")
        if self.schema is None:
            self.schema = df.schema
        same = df.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in self.schema.fields])
        options = {"csv": {"header": "true", "escape": '"'}, "json": {"ignoreNullFields": "false"}, "parquet": {"compression": "snappy"}}[self.format]
        same.write.mode("append").format(self.format).options(**options).save(self.path)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> ChunkWriter:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def csv_writer(path: str) -> ChunkWriter:
    return ChunkWriter(path, "csv")


def json_writer(path: str) -> ChunkWriter:
    return ChunkWriter(path, "json")


def parquet_writer(path: str) -> ChunkWriter:
    return ChunkWriter(path, "parquet")
