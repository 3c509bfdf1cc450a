"""The SQL entry point: frames under names, and Spark SQL over them.

STD is the standard deviation of the population and MEDIAN the interpolated one, as everywhere
in this library; ``==`` reads as ``=``. They are rewritten as words outside of quoted text.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_WORD = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`)|\bSTD\s*\(|\bMEDIAN\s*\(""", re.I)


def rewrite(query: str) -> str:
    def one(found: re.Match) -> str:
        if found[1]:
            return found[0]
        return "stddev_pop(" if found[0].lower().startswith("std") else "median("

    return _WORD.sub(one, query)


class SQLContext:
    """A registry of frames. Queries see them by name; the session's own views aren't touched."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.frames: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> SQLContext:
        self.frames[name.lower()] = df
        return self

    def query(self, query: str) -> DataFrame:
        """Run a query. A name that isn't registered must be one of the session's tables.

        A frame gets a view of a private name for as long as the query is resolved, and the query
        a common table expression of the frame's own name, which hides a view of the session.
        """
        used = {n: f"qf_{uuid.uuid4().hex}" for n in self.frames if re.search(rf"\b{re.escape(n)}\b", query, re.I)}
        text = rewrite(query)
        if used:
            own = ", ".join(f"`{n}` AS (SELECT * FROM `{view}`)" for n, view in used.items())
            begun = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text, re.I)
            text = f"WITH {begun[1] or ''}{own}, {text[begun.end() :]}" if begun else f"WITH {own} {text}"
        for n, view in used.items():
            self.frames[n].createOrReplaceTempView(view)
        try:
            return self.spark.sql(text)
        finally:
            for view in used.values():
                self.spark.catalog.dropTempView(view)
