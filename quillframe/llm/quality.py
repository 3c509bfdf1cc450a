"""Quality classifier: hashed word n-gram logistic regression, trained by FTRL-proximal.

Features are hashed n-grams of two word sequences: the lower-cased words and their shapes
(case pattern, punctuation run, repeat of the word before). A document is a unit-length sparse
vector and its score the logistic function of one sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

BITS = 18
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _shape(token: str) -> str:
    """The kind of a word, or how a run of punctuation begins: runs of three and more count as alike."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isdigit():
        return "9"
    if len(token) > 1 and token.isupper():
        return "W"
    return "X" if token[0].isupper() else "x"


class Hasher:
    """Maps tokens to 32-bit codes, remembering at most ``keep`` of them."""

    def __init__(self, keep: int = 1 << 19):
        self.known: dict[str, tuple[int, int]] = {}
        self.keep = keep

    def codes(self, token: str) -> tuple[int, int]:
        if len(self.known) >= self.keep:
            self.known.clear()
        found = self.known[token] = (zlib.crc32(token.lower().encode("utf-8", "surrogatepass")), zlib.crc32(b"\x00" + _shape(token).encode("utf-8", "surrogatepass")))
        return found

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Hashed features and their values, a vector of length 1 (empty for a text without tokens)."""
        known, codes = self.known, self.codes
        pairs = [known.get(t) or codes(t) for t in _TOKEN.findall(text)]
        if not pairs:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        both = np.array(pairs, np.uint64)
        word, shape = both[:, 0], both[:, 1].copy()
        shape[1:][word[1:] == word[:-1]] = 1  # a word that repeats the one before
        with np.errstate(over="ignore"):
            grams = [word * _MUL[0], shape * _MUL[1]]
            for seq, salt in ((word, 3), (shape, 5)):
                grams.append(seq[:-1] * _MUL[1] + seq[1:] * _MUL[2] + np.uint64(salt))
            grams.append(shape[:-2] * _MUL[0] + shape[1:-1] * _MUL[1] + shape[2:] * _MUL[2] + np.uint64(7))
            mixed = np.concatenate(grams)
            mixed ^= mixed >> np.uint64(29)
            mixed *= _MUL[0]
        index, count = np.unique((mixed >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        value = np.log1p(count)
        return index, (value / np.sqrt((value * value).sum())).astype(np.float32)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], passes: int = 10, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias after ``passes`` over the examples in their order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0
    for _ in range(passes):
        for index, value, label in examples:
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            b = -zb / ((beta + nb**0.5) / alpha)
            g = sigmoid(float(w @ value) + b) - label
            gi = g * value
            step = gi * gi
            z[index] = zi + gi - (np.sqrt(ni + step) - np.sqrt(ni)) / alpha * w
            n[index] = ni + step
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * b
            nb += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w.astype(np.float32), -zb / ((beta + nb**0.5) / alpha)


def sigmoid(x: float) -> float:
    return 1 / (1 + np.exp(-x)) if x > -500 else 0.0


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000) -> tuple[np.ndarray, float]:
    """Weights and bias learnt from a bounded sample of the labelled rows.

    The sample is the ``max_rows`` labelled ids with the smallest hash, so it is the same on
    every run and at every size; their whole texts are turned into features on the executors.
    Null labels and ids are left out; an id labelled more than once counts with its largest
    label. Without labelled documents the weights are 0 and every score is 0.5.
    """
    labelled = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sample = F.broadcast(labelled.orderBy(F.xxhash64("id"), "id").limit(max_rows))  # max_rows rows of two numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in slices(batches, 256):
            rows = [hasher.features(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([i.astype(np.int32).tobytes() for i, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())],
                names=["id", "label", "index", "value"],
            )

    rows = (
        docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        .join(sample, "id")
        .select("id", "label", "text")
        .mapInArrow(extract, "id long, label int, index binary, value binary")
        .withColumn("turn", F.xxhash64("id", F.lit(1)))
    )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            columns = (batch.column(k).to_pylist() for k in range(3))
            examples += [(np.frombuffer(i, np.int32), np.frombuffer(v, np.float32), y) for i, v, y in zip(*columns)]
        weights, bias = ftrl(examples)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["weights", "bias"])

    # one task learns, from max_rows documents
    ordered = rows.repartition(1).sortWithinPartitions("turn", "id", "index").select("index", "value", "label")
    row = ordered.mapInArrow(train, "weights binary, bias double").first()
    return (np.frombuffer(row["weights"], np.float32), row["bias"]) if row else ftrl([])


def score_quality(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted`` for each row: 1 where the score reaches ``threshold``.

    The whole text counts. A null, empty or blank text has no features and scores the bias.
    Repeated rows stay repeated; an empty table gives an empty result.
    """
    weights, bias = model
    shared = spark.sparkContext.broadcast(weights)  # 2**BITS floats, whatever the input

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = Hasher(), shared.value
        for batch in slices(batches):
            scores = []
            for text in batch.column(1).to_pylist():
                index, value = hasher.features(text or "")
                scores.append(float(sigmoid(float(w[index] @ value) + bias)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(score, "doc_id long, score double, predicted int")


def keep_quality(spark: SparkSession, docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text reaches the threshold."""
    weights, bias = model
    shared = spark.sparkContext.broadcast(weights)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, w = Hasher(), shared.value
        for batch in slices(batches):
            mask = []
            for text in batch.column(at).to_pylist():
                index, value = hasher.features(text or "")
                mask.append(float(sigmoid(float(w[index] @ value) + bias)) >= threshold)
            yield batch.filter(pa.array(mask, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
