"""Removal of repeated byte strings by fixed-length hashes over a difference cover.

This is no suffix sort: no suffixes are ordered or merged and nothing recurses, as only equality
at one length is asked for. A difference cover D modulo v has, for any two positions, a shift
s < v that brings both to residues in D. So of two equal strings of ``length`` bytes, some pair
of corresponding sampled positions is followed by at least ``length - v + 1`` equal bytes:

1. *samples*: positions with residues in D are named by a 40-bit hash of the ``length - v + 1``
   bytes that follow. A name that one document alone has can't belong to a repeated string, and
   is dropped;
2. *windows*: every position from up to v - 1 bytes before a sample whose name is left gets a
   64-bit hash of all its ``length`` bytes;
3. *smallest document*: of each of these hashes, which keeps the string; others lose it.

Both times the names of a chunk of documents are sorted by value, cut into ranges and compared
with those of other chunks range by range.

Documents that equal one with a smaller id are left out of these steps, as that one stands for
them: all their strings start there too.

With v = 3, as in suffix sorting by triples, two thirds of all bytes would become rows, more than
the disk holds; v = 13 has 4 residues in 13. Rows aren't suffixes but sorted runs of one chunk and one
range, coded as differences; the answer to a run is one bit for each of its names.

The names of windows are 64-bit hashes of the bytes, and equal names are taken for equal strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_shuffles, small_batches, written

#: A perfect difference set: every residue is a difference of two of its members.
COVER, COVER_OF = (0, 1, 3, 9), 13
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LAST = np.iinfo(np.int64).max


def names(text: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """64-bit names of the strings of ``length`` (8 at least) bytes that start at the places ``at``."""
    word = np.ndarray((max(0, len(text) - 7),), "<u8", text, strides=(1,))
    out = np.full(len(at), length, np.uint64)
    with np.errstate(over="ignore"):
        for k in [*range(0, length - 8, 8), length - 8]:
            out = (out ^ word[at + k]) * _MIX[0]
            out ^= out >> np.uint64(32)
        out *= _MIX[1]
        out ^= out >> np.uint64(29)
    return out


def _pack(values: np.ndarray) -> bytes:
    """Sorted numbers as the byte planes of their differences, compressed."""
    gaps = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(len(gaps), -1).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


_CHUNK = "ids array<long>, sizes array<long>, digests array<binary>, packed binary"


def _chunks(chunk_bytes: int):
    """Documents as rows of up to ``chunk_bytes`` bytes of text (a longer one is a row of its own)."""
    kind = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([ids], [list(map(len, texts))], [[hashlib.blake2b(t, digest_size=16).digest() for t in texts]], [zstandard.compress(b"".join(texts), 6)]), kind)], schema=kind)

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if texts and size + len(data) > chunk_bytes:
                    yield made()
                    ids, texts, size = [], [], 0
                ids.append(key.as_py())
                texts.append(data)
                size += len(data)
        if texts:
            yield made()

    return run


def _covered(first: np.ndarray, behind: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in any of the ranges."""
    edge = np.bincount(first, minlength=size + 1).astype(np.int32)
    edge -= np.bincount(behind, minlength=size + 1).astype(np.int32)
    return np.cumsum(edge[:-1]) > 0


class _Text:
    """A chunk: its bytes, and the document and the place in it of each position."""

    def __init__(self, ids: list[int | None], sizes: list[int], packed: bytes, copies: list[int] | None = None):
        self.copy = np.zeros(len(ids), bool)  # equal to a document with a smaller id
        self.copy[copies or []] = True
        self.bytes = zstandard.decompress(packed)
        self.ids = np.array([_LAST if i is None else i for i in ids], np.int64)  # a row without an id comes last
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - np.array(sizes, np.int64)

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right")

    def sampled(self, length: int) -> np.ndarray:
        """Positions with residues in the cover, within their document, that ``length`` bytes follow."""
        own = zip(self.starts[~self.copy].tolist(), self.ends[~self.copy].tolist())
        out = [np.arange(s + r, e - length + 1, COVER_OF) for s, e in own for r in COVER if s + r <= e - length]
        return np.sort(np.concatenate(out)) if out else np.empty(0, np.int64)

    def windows(self, near: np.ndarray, length: int) -> np.ndarray:
        """Starts of strings of ``length`` bytes up to v - 1 bytes before one of the positions ``near``."""
        if not len(near):
            return np.empty(0, np.int64)
        first = np.maximum(near - COVER_OF + 1, self.starts[self.document(near)])
        at = np.flatnonzero(_covered(first, near + 1, len(self.bytes)))
        return at[at + length <= self.ends[self.document(at)]]


def _runs(name: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """Cut sorted names by the ranges of their high bits: (range, first, behind)."""
    if not len(name):
        return
    part = ((name >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(name)]
    for a, b in zip(edges, edges[1:]):
        yield int(part[a]), a, b


def _groups(name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the names, where each distinct one begins in it, and the group of each place of the order."""
    order = np.argsort(name)
    fresh = np.ones(len(name), bool)
    own = name[order]
    fresh[1:] = own[1:] != own[:-1]
    return order, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _table(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct names, the smallest document of each, and the largest."""
    if not len(name):
        return name, doc, doc
    order, first, _ = _groups(name)
    doc = doc[order]
    return name[order[first]], np.minimum.reduceat(doc, first), np.maximum.reduceat(doc, first)


#: Names of the sampled tuples are shortened to so many bits: they only rule out, and are sent for every text.
SHORT = 40
_RUN = "chunk long, part int, names binary, docs binary"


def _send(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["chunk", "part", "names", "docs"])


def _sample_runs(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, sizes, packed, copies in zip(*batch.columns):
                text = _Text(ids.as_py(), sizes.as_py(), packed.as_py(), copies.as_py())
                at = text.sampled(length - COVER_OF + 1)
                name = names(text.bytes, at, length - COVER_OF + 1) >> np.uint64(64 - SHORT)
                name, low, high = _table(name, text.ids[text.document(at)])
                if len(name):
                    # a flag instead of the documents: whether the chunk alone has several
                    rows = [(chunk.as_py(), k, _pack(name[a:b]), np.packbits(low[a:b] != high[a:b]).tobytes()) for k, a, b in _runs(name << np.uint64(64 - SHORT), ranges)]
                    yield _send(rows)

    return run


def _shared_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run, which of its names several documents have. Runs of a range stand together."""

    def answer(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        runs = [_unpack(r[2]) for r in rows]
        several = [np.unpackbits(np.frombuffer(r[3], np.uint8), count=len(n)).astype(bool) for r, n in zip(rows, runs)]
        every = np.sort(np.concatenate(runs))
        twice = every[1:][every[1:] == every[:-1]]
        twice = twice[np.concatenate(([True], np.diff(twice) != 0))] if len(twice) else twice
        out = []
        for (chunk, part, _, _), name, own in zip(rows, runs, several):
            at = np.minimum(np.searchsorted(twice, name), max(0, len(twice) - 1))
            bits = own | (twice[at] == name if len(twice) else False)
            out.append((chunk, part, np.packbits(bits).tobytes(), b""))
        return _send(out)

    yield from _by_range(batches, answer)


def _by_range(batches: Iterator[pa.RecordBatch], answer) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if rows and rows[-1][1] != row[1]:
                yield answer(rows)
                rows = []
            rows.append(row)
    if rows:
        yield answer(rows)


def _bits_of(parts: list[dict], name: np.ndarray, ranges: int) -> np.ndarray:
    """The answers to a chunk's runs as one flag for each of its sorted names."""
    bits = np.zeros(len(name), bool)
    got = {p["part"]: p["bits"] for p in parts}
    for k, a, b in _runs(name, ranges):
        bits[a:b] = np.unpackbits(np.frombuffer(got[k], np.uint8), count=b - a).astype(bool)
    return bits


def _window_names(text: _Text, parts: list[dict] | None, length: int, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows near the sampled positions whose name is shared, and their names."""
    short = length - COVER_OF + 1
    at = text.sampled(short)
    name = names(text.bytes, at, short) >> np.uint64(64 - SHORT)
    order, first, group = _groups(name)
    bits = _bits_of(parts or [], name[order[first]] << np.uint64(64 - SHORT), ranges)
    near = at[order[bits[group]]]
    window = text.windows(near, length)
    return window, names(text.bytes, window, length)


def _window_runs(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, ids, sizes, packed, copies, parts in zip(*batch.columns):
                text = _Text(ids.as_py(), sizes.as_py(), packed.as_py(), copies.as_py())
                window, name = _window_names(text, parts.as_py(), length, ranges)
                name, low, _ = _table(name, text.ids[text.document(window)])
                if len(name):
                    rows = []
                    for k, a, b in _runs(name, ranges):
                        docs, place = np.unique(low[a:b], return_inverse=True)
                        place = place.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32)
                        planes = np.ascontiguousarray(place.view(np.uint8).reshape(b - a, -1).T).tobytes()
                        rows.append((chunk.as_py(), k, _pack(name[a:b]), len(ids := _pack(docs)).to_bytes(8, "little") + ids + zstandard.compress(planes, 1)))
                    yield _send(rows)

    return run


def _docs_of(data: bytes, n: int) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    docs = _unpack(data[8 : 8 + size]).view(np.int64)
    planes = np.frombuffer(zstandard.decompress(data[8 + size :]), np.uint8).reshape(-1, n)
    return docs[np.ascontiguousarray(planes.T).view(np.uint16 if len(planes) == 2 else np.uint32).ravel()]


def _earlier(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run, which of its names a document before the run's own smallest has."""

    def answer(rows: list[tuple[int, int, bytes, bytes]]) -> pa.RecordBatch:
        runs = [_unpack(r[2]) for r in rows]
        docs = [_docs_of(r[3], len(n)) for r, n in zip(rows, runs)]
        name, least, _ = _table(np.concatenate(runs), np.concatenate(docs))
        out = [(r[0], r[1], np.packbits(least[np.searchsorted(name, n)] < d).tobytes(), b"") for r, n, d in zip(rows, runs, docs)]
        return _send(out)

    yield from _by_range(batches, answer)


_OUT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string"
_OUT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string())])


def _remove(length: int, ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, sizes, packed, copies, shared, earlier in zip(*batch.columns):
                keys = ids.as_py()
                text = _Text(keys, sizes.as_py(), packed.as_py(), copies.as_py())
                covered = np.zeros(len(text.bytes), bool)
                if shared.as_py():
                    window, name = _window_names(text, shared.as_py(), length, ranges)
                    order, first, group = _groups(name)
                    if len(order):
                        doc = text.ids[text.document(window)][order]
                        low = np.minimum.reduceat(doc, first)
                        before = _bits_of(earlier.as_py() or [], name[order[first]], ranges)
                        hit = window[order[before[group] | (low[group] < doc)]]
                        covered = _covered(hit, hit + length, len(text.bytes))
                for a, b in zip(text.starts[text.copy].tolist(), text.ends[text.copy].tolist()):
                    covered[a:b] = b - a >= length
                data = np.frombuffer(text.bytes, np.uint8)
                out = []
                for key, a, b in zip(keys, text.starts.tolist(), text.ends.tolist()):
                    own = covered[a:b]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0])))).reshape(-1, 2).tolist()
                    out.append((key, b - a, int(np.count_nonzero(own)), [dict(start=x, stop=y) for x, y in edges], hashlib.sha256(data[a:b][~own].tobytes()).hexdigest()))
                for k in range(0, len(out), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 1000]), _OUT_ARROW)], schema=_OUT_ARROW)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 50, chunk_bytes: int = 2 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, spans, kept_sha256``.

    Texts count as UTF-8 bytes. Every byte that lies in a string of ``length`` bytes (20 at
    least) which also starts in a document with a smaller id is removed; strings don't cross
    documents and are judged on the input. ``spans``: the removed runs (start, stop);
    ``kept_sha256``: the digest of the bytes that are left. A null text is empty. A row without
    an id comes after all others. Rows that repeat an id don't remove each other's bytes, as
    their ids are equal. An empty table gives an empty result.
    """
    if length < COVER_OF + 7:
        raise ValueError(f"length must be {COVER_OF + 7} at least")
    small_batches(spark, 16 << 20)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # numbered by Spark, as a task can run several partitions
    chunks = written(source.mapInArrow(_chunks(chunk_bytes), _CHUNK).withColumn("chunk", F.monotonically_increasing_id()), "suffix-chunks")
    ranges = max(16, int(chunks.count()) // 4)  # so a range has about as many names as four chunks
    short = length - COVER_OF + 1

    row = F.posexplode(F.arrays_zip("ids", "digests")).alias("place", "row")
    own = chunks.select("chunk", row).select("chunk", "place", F.coalesce("row.ids", F.lit(_LAST)).alias("id"), F.col("row.digests").alias("digest"))
    # written, so that a join with a digest of many copies can be split
    least = written(own.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").drop("most"), "suffix-least", per_core=1)
    copies = written(own.join(least, "digest").where("id > least").groupBy("chunk").agg(F.collect_list("place").alias("copies")), "suffix-copies", per_core=1)

    def met(runs: DataFrame, answer, name: str) -> DataFrame:
        """The answers to the runs, one row for each chunk."""
        dealt = runs.repartition(ranges, "part").sortWithinPartitions("part")
        bits = dealt.mapInArrow(answer, _RUN).select("chunk", "part", F.col("names").alias("bits"))
        return written(bits.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias(name)), f"suffix-{name}", per_core=1)

    first = chunks.drop("digests").join(copies, "chunk", "left").select("chunk", "ids", "sizes", "packed", "copies")
    shared = met(first.mapInArrow(_sample_runs(length, ranges), _RUN), _shared_names, "shared")
    free_shuffles(spark)
    again = first.join(shared, "chunk", "left").select("chunk", "ids", "sizes", "packed", "copies", "shared")
    earlier = met(again.mapInArrow(_window_runs(length, ranges), _RUN), _earlier, "earlier")
    free_shuffles(spark)
    last = again.join(earlier, "chunk", "left").select("ids", "sizes", "packed", "copies", "shared", "earlier")
    return last.mapInArrow(_remove(length, ranges), _OUT)
