"""A corpus pipeline: each stage works on all documents that the stage before has kept.

``run(spark, sf_dir)`` applies the stages to the documents of a folder of tables. Between two
stages the documents are written as Parquet to the shared folder and read again. All stages but
the last return the columns of ``documents``. Rows are told apart by numbers of their own, so
ids that are null or repeat take no row with them that isn't meant.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillframe.llm import queries as _queries
from quillframe.llm.common import table, written
from quillframe.llm.decontam import keep_clean
from quillframe.llm.exact import unique_documents
from quillframe.llm.jaccard import distinct_documents
from quillframe.llm.mixing import soft_mix
from quillframe.llm.quality import keep_quality

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return keep_quality(spark, docs, _queries.quality_model(spark, sf_dir))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return unique_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest doc_id.

    Near duplicates share 80 % of their five-word shingles at least, by Jaccard similarity.
    """
    return distinct_documents(spark, docs, percent=80, width=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an occurrence of a benchmark window."""
    return keep_clean(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their tokens, posteriors and the rate that meets the target weights.

    The column ``rate`` is the decision: each document is returned once, also with rate 0, and the
    rows have the target weights only when a reader takes each as often as its rate says.
    """
    return soft_mix(docs, _queries.mix_labels(spark, sf_dir), _queries.MIX_TARGETS, keep_columns=True)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontamination", decontaminated), ("mixing", mixed)]

#: The quality classifier's training and the fit of the rates have no equivalent in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages kept, as the last stage returns them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
