"""Type names, what they are in Spark, and which one two of them share."""

from __future__ import annotations

from pyspark.sql import types as T

SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
    "string": T.StringType(),
    "timestamp": T.TimestampNTZType(),
    "duration": T.LongType(),
    "category": T.StringType(),
}


def to_spark(name: str) -> T.DataType:
    try:
        return SPARK_TYPES[name]
    except KeyError:
        raise ValueError(f"unknown type {name!r}; known: {', '.join(SPARK_TYPES)}") from None


def from_spark(kind: T.DataType) -> str:
    """The name of a Spark type; what has no name of its own counts as a string."""
    if isinstance(kind, T.DecimalType):
        return "uint64" if (kind.precision, kind.scale) == (20, 0) else "float64"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    own = {"BooleanType": "bool", "ByteType": "int8", "ShortType": "int16", "IntegerType": "int32", "LongType": "int64", "FloatType": "float32", "DoubleType": "float64"}
    return own.get(type(kind).__name__, "string")


def is_integer(name: str) -> bool:
    return name.startswith(("int", "uint"))


def is_float(name: str) -> bool:
    return name.startswith("float")


def is_numeric(name: str) -> bool:
    return is_integer(name) or is_float(name)


def is_signed(name: str) -> bool:
    return name.startswith("int")


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def promote(a: str, b: str) -> str:
    """The type that holds values of both: a float if one is, else the wider integer, else float64."""
    if a == b:
        return a
    if not (is_numeric(a) and is_numeric(b)):
        return "float64"
    if is_float(a) or is_float(b):
        return "float32" if {a, b} <= {"float32", "int8", "int16", "uint8", "uint16"} else "float64"
    width = max(int(a.lstrip("uint")), int(b.lstrip("uint")))
    if width == 64:
        return "int64"
    if is_signed(a) == is_signed(b):
        return f"{'int' if is_signed(a) else 'uint'}{width}"
    unsigned = a if not is_signed(a) else b
    need = int(unsigned.lstrip("uint")) * 2
    return f"int{max(width, min(64, need))}"
