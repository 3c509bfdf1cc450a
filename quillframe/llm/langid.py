"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has one bit for each language in every slot. A lookup ands the slots
of an n-gram and so returns, at once, all languages that contain it. A text's n-grams are
counted for each language by its bit; the counts are corrected for the language's rate of false
positives, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

SIZES = (1, 2, 3, 4, 5)
_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


@cache
def _letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a space for what is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x40000):  # the planes with letters
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def grams(text: str) -> np.ndarray:
    """64-bit hashes of the n-grams of a text's words, each word with a space at either side."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    c = _letters()[np.minimum(points, 0x10FFFF)]
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))].astype(np.uint64)  # one space between words
    if len(c) < 3:
        return np.empty(0, np.uint64)
    out = []
    inner = c != 32
    with np.errstate(over="ignore"):
        for n in SIZES:
            if len(c) < n:
                break
            h = np.full(len(c) - n + 1, n, np.uint64)
            ok = np.ones(len(h), bool)
            for k in range(n):
                h = (h ^ c[k : len(c) - n + 1 + k]) * _MUL[k]
                h ^= h >> np.uint64(31)
                if 0 < k < n - 1 or n == 1:
                    ok &= inner[k : len(c) - n + 1 + k]  # a space only at an end
            if n == 2:
                ok &= inner[: len(h)] | inner[1:]
            out.append(h[ok])
    return np.concatenate(out)


class Filter:
    """The bit-sliced filter: ``slots[i]`` has bit l set if an n-gram of language l hashes to i."""

    HASHES = 3

    def __init__(self, languages: list[str], bits: int = 20):
        self.languages, self.bits = languages, bits
        self.slots = np.zeros((1 << bits, (len(languages) + 63) // 64 or 1), np.uint64)

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            for k in range(self.HASHES):
                yield ((hashes * _MUL[k + 1]) >> np.uint64(64 - self.bits)).astype(np.int64)

    def add(self, language: int, hashes: np.ndarray) -> None:
        for at in self._places(hashes):
            self.slots[at, language // 64] |= np.uint64(1 << language % 64)

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """For each n-gram the languages that contain it, as bits."""
        found = None
        for at in self._places(hashes):
            found = self.slots[at] if found is None else found & self.slots[at]
        return found

    def rates(self) -> np.ndarray:
        """The rate of false positives of each language."""
        return np.array([np.mean((self.slots[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) ** self.HASHES for k in range(len(self.languages))])

    def decide(self, hashes: np.ndarray, rates: np.ndarray) -> tuple[str, float]:
        """The language with the largest corrected count, of equal ones the first, and its share of all counts."""
        found = self.masks(hashes)
        counts = np.array([np.count_nonzero((found[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(self.languages))], float)
        true = np.maximum(0.0, (counts - rates * len(hashes)) / np.maximum(1e-9, 1 - rates))
        k = int(np.argmax(true))
        return self.languages[k], float(true[k] / true.sum()) if true.sum() > 0 else 0.0


def fit_languages(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 3000, lead: float = 3.0, seen: int = 2, slots: int = 16) -> Filter:
    """A filter learnt from at most ``max_rows`` documents, those with the smallest hash of their id.

    Their whole texts are counted on the executors. A language contains an n-gram that the sample
    has ``seen`` times in it or more (once says little: a name, a misprint) and whose rate there
    is at least a ``lead``-th of the rate in the language where it is most frequent. The filter
    has ``slots`` slots for each n-gram of the language with most, 2**20 at least. Rows without a
    text or language don't count; without any the filter knows no language.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = F.broadcast(rows.select("id").orderBy(F.xxhash64("id"), "id").limit(max_rows).distinct())  # max_rows numbers at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(lang, []).append(grams(text))
            for lang, parts in by.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "h", "n"])

    counted = rows.join(sample, "id").select("text", "lang").mapInArrow(count, "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= seen).toArrow()  # bounded by the texts of max_rows documents
    languages = sorted(set(found.column("lang").to_pylist()))
    if not languages:
        return Filter(languages)
    h = found.column("h").to_numpy().view(np.uint64)
    n = found.column("n").to_numpy().astype(float)
    code = np.searchsorted(np.array(languages, object), np.array(found.column("lang").to_pylist(), object))
    rate = n / np.bincount(code, n)[code]
    keys, inverse = np.unique(h, return_inverse=True)
    top = np.zeros(len(keys))
    np.maximum.at(top, inverse, rate)
    own = [h[(code == k) & (rate * lead >= top[inverse])] for k in range(len(languages))]
    out = Filter(languages, max(20, (slots * max(map(len, own)) - 1).bit_length()))
    for k, grams_of in enumerate(own):
        out.add(k, grams_of)
    return out


def detect_languages(spark: SparkSession, docs: DataFrame, model: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for each row, judged by its whole text.

    ``und`` with score 0 where the text is null or has no letter, and where the model knows no
    language. ``score``: the language's share of the corrected counts. Repeated rows stay
    repeated; an empty table gives an empty result.
    """
    shared = spark.sparkContext.broadcast(model)  # 8 bytes for each slot and 64 languages, whatever the input

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        rates = found.rates()
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                h = grams(text) if text else ()
                out.append(found.decide(h, rates) if len(h) and found.languages else ("und", 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([s for _, s in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(predict, "doc_id long, lang_pred string, score double")
