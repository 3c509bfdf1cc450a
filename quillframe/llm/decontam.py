"""Benchmark decontamination with one Aho-Corasick automaton.

The windows of all benchmark items go into one automaton over normalised text, whose letters are
words: numbers of the benchmark's vocabulary, 0 for any other word. A document is normalised once
and scanned once; hits are word ranges, and their places in the original text are worked out for
the documents that have any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

#: A word of the original text, whose A-Z aren't lower-cased yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of UTF-8: A-Z to a-z; what isn't a digit, letter or part of a non-ASCII character to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """The words of a text, lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Windows:
    """The automaton of the windows of ``n`` words of some items; an item without an id has windows but no name."""

    def __init__(self, items: list[tuple], n: int):
        self.number: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set] = {}
        for item, text in items:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text or "")]
            for i in range(max(1, len(words) - n + 1) if words else 0):
                found.setdefault(tuple(words[i : i + n]), set()).add(item)
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, owners in found.items():
            self.machine.add_word(window, (len(window), sorted(x for x in owners if x is not None)))
        if found:
            self.machine.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Ranges of words (first, behind the last) inside any window, in order and without overlap, and the items."""
        if not words or not len(self.machine):
            return [], set()
        get = self.number.get
        items: set = set()
        ranges: list[tuple[int, int]] = []
        for end, (k, owners) in self.machine.iter(tuple([get(w, 0) for w in words])):
            items.update(owners)
            ranges.append((end + 1 - k, end + 1))
        return _merged(ranges), items


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of words as ranges of characters of the original text."""
    if not ranges:
        return []
    places = [m.span() for m in WORD.finditer(text)]
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


def benchmark_shards(benchmark: DataFrame, id_col: str, text_col: str, shard_bytes: int, most_bytes: int) -> list[list[tuple]]:
    """The items, in shards of at most ``shard_bytes`` (one larger item is a shard of its own)."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where(F.col("text").isNotNull())
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes; most_bytes is {most_bytes}")
    shards: list[list[tuple]] = [[]]
    size = 0
    for r in rows.orderBy("item", "text").toLocalIterator():
        if size and size + len(r["text"]) > shard_bytes:
            shards.append([])
            size = 0
        shards[-1].append((r["item"], r["text"]))
        size += len(r["text"])
    return shards


def contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 2 << 20, most_bytes: int = 512 << 20) -> DataFrame:
    """One row per document: ``doc_id, n_words, spans, items``.

    ``spans``: ranges of words (``first``, ``behind``) inside any occurrence of a benchmark
    window, with their places in the original text (``start``, ``stop``), merged. ``items``: the
    items with an occurring window, as strings in order. A window is ``n`` consecutive words of
    an item; an item of fewer words, but not none, is one window. A null or wordless text has no
    words and no spans; an empty benchmark contaminates nothing. Rows that repeat a document stay
    repeated; equal items under several ids are all named. An item with a null id marks spans,
    but isn't named.

    A task holds the automaton, some hundred times the size of the items. A benchmark of more
    than ``shard_bytes`` has an automaton for each shard of whole items; a task then takes its
    texts in portions and each portion through all shards, so texts are still read once. The
    items are broadcast; a benchmark of more than ``most_bytes`` is refused with an error.
    """
    shards = [spark.sparkContext.broadcast(x) for x in benchmark_shards(benchmark, item_col, item_text_col, shard_bytes, most_bytes)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, shards, n, 1):
            out = []
            for key, text, (n_words, ranges, items) in zip(batch.column(0).to_pylist(), batch.column(1), found):
                places = original_spans(text.as_py(), ranges) if ranges else []
                out.append((key, n_words, [dict(first=a, behind=b, start=s, stop=e) for (a, b), (s, e) in zip(ranges, places)], sorted(items)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND_ARROW)], schema=_FOUND_ARROW)

    return rows.mapInArrow(run, _FOUND)


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = 2 << 20, most_bytes: int = 512 << 20) -> DataFrame:
    """The rows of ``docs``, with all their columns, in whose text no benchmark window occurs (see :func:`contamination`)."""
    shards = [spark.sparkContext.broadcast(x) for x in benchmark_shards(benchmark, item_col, item_text_col, shard_bytes, most_bytes)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _scanned(batches, shards, n, at):
            yield batch.filter(pa.array([not ranges for _, ranges, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


_FOUND = "doc_id long, n_words long, spans array<struct<first:long,behind:long,start:long,stop:long>>, items array<string>"
_FOUND_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "behind", "start", "stop")]))), ("items", pa.list_(pa.string()))]
)


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


#: Bytes of a portion of texts, with several shards.
PORTION = 64 << 20


def _scanned(batches: Iterator[pa.RecordBatch], shards: list, n: int, at: int) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list, set]]]]:
    """Each batch with the number of words, the ranges and the items of its rows; ``at``: the place of the texts."""
    only = Windows(shards[0].value, n) if len(shards) == 1 else None

    def through(batch: pa.RecordBatch, windows: Windows, found: list | None) -> list[tuple[int, list, set]]:
        out = []
        for k, text in enumerate(batch.column(at)):
            words = words_of(text.as_py() or "")
            ranges, items = windows.scan(words)
            if found is not None:
                ranges, items = _merged(found[k][1] + ranges), found[k][2] | items
            out.append((len(words), ranges, items))
        return out

    if only:
        for batch in slices(batches):
            yield batch, through(batch, only, None)
        return
    held: list[list] = []
    size = 0

    def portion() -> Iterator[tuple[pa.RecordBatch, list]]:
        for shard in shards:
            windows = Windows(shard.value, n)
            for pair in held:
                pair[1] = through(pair[0], windows, pair[1])
        yield from map(tuple, held)

    for batch in slices(batches):
        held.append([batch, None])
        size += batch.nbytes
        if size >= PORTION:
            yield from portion()
            held, size = [], 0
    if held:
        yield from portion()
