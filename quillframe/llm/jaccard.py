"""N-gram Jaccard join over token-combination prefixes.

Tokens are 64-bit hashes of word shingles, in one global order from rare to frequent. Two sets
whose similarity reaches the threshold share at least k tokens of their extended prefixes (the
first ``n - ceil(t n) + k``). So a set is indexed by each rare token of its extended prefix and
by each pair (k = 2) of its frequent ones; two similar sets share a rare token there or else a
pair. Sets of more than ``pairs_up_to`` tokens have too many pairs: where the larger set of a
pair is of that size, both are indexed by their frequent tokens one by one. The order and the
classes come from a counter table of fixed size; they decide costs only, never the result.

Equal sets are one class from the start, and a list holds the classes of one key. Classes are
then linked in steps, so that a large group of similar sets needn't be expanded into its pairs:

1. *blocks*: each class of a list of ``block_from`` or more goes to one of its largest lists,
   dealt into blocks of bounded size; a task links the sets of a block exactly, and passes over
   those that are linked already. Lists with several components are dealt again;
2. *candidates*: lists that hold several components are compared by size and by a parity sketch,
   whose distance never exceeds that of the sets. Lists of two are first folded to distinct
   pairs, lists with the same smallest class come to few tasks, each of which names a pair once
   however many keys it shares, and pairs that a block has compared are passed over. Of a long
   list only what is outside its largest component is compared with the others, in cells of
   bounded size;
3. *verification* of what is left, by the sets themselves.

Components are found by passing on the smallest label, with pointer jumping.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_shuffles, slices, small_batches, written

#: The counter table: 2**SLOT_BITS counters, in blocks.
SLOT_BITS, BLOCK = 21, 1 << 16
#: 64-bit words of a sketch, and of one for a set of more than SKETCH_LONG tokens.
SKETCH_WORDS, SKETCH_MORE, SKETCH_LONG = 8, 64, 1000
#: Lists of at most so many rows are compared many at a time.
SHORT_LIST = 32
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


class Shingler:
    """Sets of hashed word shingles, from the bytes of whole batches of texts.

    A word's hash is a polynomial of a random number for each of its bytes modulo 2**64: prefix
    sums of number times power give those of all words at once, and the inverse power of a
    word's place makes them independent of it. A shingle's hash mixes those of its words.
    """

    SPACE = np.zeros(256, bool)
    SPACE[[9, 10, 11, 12, 13, 32]] = True
    TABLE = np.random.default_rng(20).integers(1, 1 << 64, 256, np.uint64)
    TABLE[65:91] = TABLE[97:123]  # A-Z as a-z
    BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self, width: int, block: int = 1 << 16):
        self.width, self.block = width, block
        self.power = self.back = np.empty(0, np.uint64)

    def _powers(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, self.block + 1)
            for name, base in (("power", self.BASE), ("back", pow(self.BASE, -1, 1 << 64))):
                made = np.full(n, base, np.uint64)
                made[0] = 1
                with np.errstate(over="ignore"):
                    setattr(self, name, np.cumprod(made, dtype=np.uint64))

    def _words(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the words of ``data`` and their places; no word goes across one of the places ``cuts``."""
        n = len(data)
        space = self.SPACE[data]
        edge = np.empty(n + 1, bool)  # whether a word can't go on from the byte before
        edge[1:] = True
        edge[1:-1] = space[:-1] | space[1:]
        edge[0] = True
        edge[cuts] = True
        first = np.flatnonzero(edge[:-1] & ~space)
        last = np.flatnonzero(edge[1:] & ~space)
        self._powers(n)
        with np.errstate(over="ignore"):
            x = self.TABLE[data]
            x *= self.power[:n]
            total = np.cumsum(x, dtype=np.uint64)
            out = (total[last] - total[first] + x[first]) * self.back[first]
            out = (out ^ (last - first).astype(np.uint64)) * _MIX[1]
            out ^= out >> np.uint64(32)
        return out, first

    def _cut(self, data: np.ndarray, at: np.ndarray, a: int) -> int:
        """A place behind ``a`` where no word goes on: up to a block away, further within a longer word."""
        b = a + self.block
        if b >= len(data):
            return len(data)
        white = np.flatnonzero(self.SPACE[data[a:b]])
        back = max(int(at[np.searchsorted(at, b, "right") - 1]), a + int(white[-1]) + 1 if len(white) else 0)
        if back > a:
            return back
        end = int(at[np.searchsorted(at, b)])  # of the text
        while b < end:
            white = np.flatnonzero(self.SPACE[data[b : b + self.block]])
            if len(white):
                return min(end, b + int(white[0]))
            b += self.block
        return end

    def _joined(self, words: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.full(len(words) - width + 1, width, np.uint64)
            for k in range(width):
                out = (out ^ words[k : len(words) - width + 1 + k]) * _MIX[k % 4]
                out ^= out >> np.uint64(29)
        return out

    def sets_of(self, texts: pa.Array) -> list[np.ndarray]:
        """The distinct shingles of each text in order, as 64-bit hashes; none for null and blank ones.

        Words are what stands between ASCII white space, A-Z lower-cased. ``texts``: strings, or
        binary in UTF-8.
        """
        if texts.null_count:
            texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) else b"")
        if not len(texts):
            return []
        _, places, held = texts.buffers()
        at = np.frombuffer(places, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(held, np.uint8)[at[0] : at[-1]] if held is not None and at[-1] > at[0] else np.empty(0, np.uint8)
        at = at - at[0]
        words, starts = [], []
        a = 0
        while a < len(data):
            b = self._cut(data, at, a)
            cuts = at[np.searchsorted(at, a) : np.searchsorted(at, b, "right")] - a
            hashes, where = self._words(data[a:b], cuts)
            words.append(hashes)
            starts.append(where + a)
            a = b
        word = np.concatenate(words) if words else np.empty(0, np.uint64)
        start = np.concatenate(starts) if starts else np.empty(0, np.int64)
        edges = np.searchsorted(start, at).tolist()
        joined = self._joined(word, self.width) if len(word) >= self.width else np.empty(0, np.uint64)
        out = []
        for a, b in zip(edges, edges[1:]):
            if b - a >= self.width:
                s = np.sort(joined[a : b - self.width + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            else:
                out.append(self._joined(word[a:b], b - a) if b > a else np.empty(0, np.uint64))
        return out


def sketch(tokens: np.ndarray, words: int | None = None) -> np.ndarray:
    """One parity bit for each of 64 * ``words`` cells; two sketches differ in no more bits than the sets in tokens."""
    words = words or (SKETCH_WORDS if len(tokens) <= SKETCH_LONG else SKETCH_MORE)
    with np.errstate(over="ignore"):
        cell = (tokens * _MIX[3]) >> np.uint64(64 - (64 * words - 1).bit_length())
    odd = np.bincount(cell.astype(np.int64), minlength=64 * words).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    """Rows of SKETCH_MORE words as the sketches of SKETCH_WORDS words of the same sets: eight cells become one."""
    return np.packbits(np.bitwise_count(bits.view(np.uint8)) & 1, axis=1).view(np.uint64)


def slot_of(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def index_keys(tokens: np.ndarray, level: np.ndarray, frequent: int, percent: int, pairs_up_to: int) -> np.ndarray:
    """The keys of a set. ``level``: the class of each slot; from ``frequent`` on a token counts as frequent."""
    n = len(tokens)
    if 100 * n < percent * (n + 1):  # only an equal set reaches the threshold
        return np.empty(0, np.uint64)
    need = -(-percent * n // 100)
    # the order: by class, then by the token (its high bits, which say the class)
    order = (level[slot_of(tokens)].astype(np.uint64) << np.uint64(56)) | (tokens >> np.uint64(8))
    first = np.sort(order)[: min(n, n - need + 2)]
    split = int(np.searchsorted(first, np.uint64(min(frequent, 255)) << np.uint64(56)))
    if frequent > 255:
        split = len(first)
    out = [first[:split]]
    often = first[split:]
    with np.errstate(over="ignore"):
        if n <= pairs_up_to and len(often) > 1:
            a, b = np.triu_indices(len(often), 1)
            out.append((often[a] * _MIX[0] ^ often[b]) * _MIX[1])
        if 100 * n >= percent * pairs_up_to:
            out.append((first[split : n - need + 1] ^ _MIX[2]) * _MIX[0])
    return np.unique(np.concatenate(out)) if len(often) else out[0]


def _near(a: int, b: int, both: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


def link_block(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between sets, by position, that join all components of the block.

    ``known``: labels; sets of a label count as linked. One link is given for each component that
    becomes part of another.
    """
    size = np.array([len(s) for s in sets], np.int64)
    bits = np.array([sketch(s, SKETCH_WORDS if size.max() <= SKETCH_LONG else SKETCH_MORE) for s in sets]).view(np.uint64)
    first: dict[int, int] = {}
    label = np.array([first.setdefault(k, i) for i, k in enumerate(known)]) if known else np.arange(len(sets))
    links = []
    for i in range(1, len(sets)):
        while True:
            other = np.flatnonzero(label[:i] != label[i])
            if not len(other):
                break
            far = np.bitwise_count(bits[other] ^ bits[i]).sum(axis=1, dtype=np.int64)
            small, large = np.minimum(size[other], size[i]), np.maximum(size[other], size[i])
            fits = other[((100 + percent) * far <= (100 - percent) * (small + large)) & (100 * small >= percent * large)]
            hit = next((j for j in fits[::-1].tolist() if _near(size[i], size[j], overlap(sets[i], sets[j]), percent)), None)
            if hit is None:
                break
            links.append((i, hit))
            low, high = sorted((label[i], label[hit]))
            label[label == high] = low
    return links


def _count_slots(width: int):
    """Counters of the partition's tokens, in compressed blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        count = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in slices(batches, 256):
            held = [slot_of(s) for s in shingler.sets_of(batch.column(0)) if len(s)]
            if held:
                np.add.at(count, np.concatenate(held), 1)
        part = TaskContext.get().partitionId() % 64
        squeeze = zstandard.ZstdCompressor(level=1).compress
        parts = [(k, part, squeeze(count[at : at + BLOCK].tobytes())) for k, at in enumerate(range(0, len(count), BLOCK)) if count[at : at + BLOCK].any()]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), (pa.int32(), pa.int32(), pa.binary()))], names=["block", "part", "counts"])

    return run


def _add_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the blocks of counters that a partition holds."""
    sums: dict[int, np.ndarray] = {}
    for batch in slices(batches, 16):
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            more = np.frombuffer(zstandard.decompress(counts), np.int64)
            sums[block] = sums[block] + more if block in sums else more
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([0] * len(sums), pa.int32()), pa.array([zstandard.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())], names=["block", "part", "counts"])


def token_levels(source: DataFrame, width: int, often: int) -> tuple[np.ndarray, int]:
    """The class of each slot (the logarithm of its counter) and the class from which tokens are frequent.

    Frequent are tokens of slots with at least ``often`` more documents than the median slot: up
    to about the size of a cell, comparing a list costs less than indexing its sets by pairs.
    """
    kind = "block int, part int, counts binary"
    partial = source.select("text").mapInArrow(_count_slots(width), kind).repartition(64, "block", "part").mapInArrow(_add_slots, kind)
    total = partial.repartition(32, "block").mapInArrow(_add_slots, kind)
    count = np.zeros(1 << SLOT_BITS, np.int64)
    for row in total.toLocalIterator():  # a table of fixed size
        count[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] += np.frombuffer(zstandard.decompress(row["counts"]), np.int64)
    level = np.round(4 * np.log2(1 + count)).astype(np.uint8)
    return level, int(np.ceil(4 * np.log2(1 + np.median(count) + often)))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), kind))


_ROWS = "doc_id long, uid long, n long, digest binary, keys array<long>, bits binary, packed binary"


def _index(width: int, shared, frequent: int, percent: int, pairs_up_to: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, level = Shingler(width), shared.value
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 256):
            sets = shingler.sets_of(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    _lists([index_keys(s, level, frequent, percent, pairs_up_to).view(np.int64) for s in sets], pa.int64()),
                    pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                    pa.array([squeeze(t.as_buffer()) if t.is_valid else None for t in batch.column(1).cast(pa.binary())], pa.binary()),
                    *batch.columns[3:],
                ],
                names=["doc_id", "uid", "n", "digest", "keys", "bits", "packed", *batch.schema.names[3:]],
            )

    return run


def _unpacked(shingler: Shingler, packed: list[bytes]) -> list[np.ndarray]:
    return shingler.sets_of(pa.array([zstandard.decompress(p) for p in packed], pa.binary()))


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _blocks(width: int, percent: int):
    """Links between the components of each block, from the smallest label to the others; rows of a block stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        block, sets, known = None, [], []

        def linked() -> list[tuple[int, int]]:
            root: dict[int, int] = {}

            def of(x: int) -> int:
                while x in root:
                    x = root[x]
                return x

            for i, j in link_block(sets, percent, known) if len(sets) > 1 else ():
                low, high = sorted((of(known[i]), of(known[j])))
                if low != high:
                    root[high] = low
            return [(of(x), x) for x in root]

        for batch in slices(batches, 256):
            out: list[tuple[int, int]] = []
            for own, label, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _unpacked(shingler, batch.column(2).to_pylist())):
                if own != block:
                    out += linked()
                    block, sets, known = own, [], []
                sets.append(s)
                known.append(label)
            if out:
                yield _links(out)
        if out := linked():
            yield _links(out)

    return run


class _Rows:
    """Rows of lists as columns: list, class, label, size, blocks, side and sketches."""

    def __init__(self, batch: pa.RecordBatch):
        col = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
        num = lambda name: col[name].to_numpy(zero_copy_only=False)
        self.cls, self.label, self.n, self.side = num("cls"), num("label"), num("n"), num("side")
        self.blocks = [num(c) for c in col if c.startswith("block")]
        same = np.ones(len(self.cls), bool)
        for name in ("fam", "part", "key"):
            x = num(name)
            same[1:] &= x[1:] == x[:-1]
        same[:1] = False
        self.list = np.cumsum(~same) - 1
        bits = col["bits"]
        at = np.frombuffer(bits.buffers()[1], np.int32)[bits.offset : bits.offset + len(bits) + 1].astype(np.int64)
        data = np.frombuffer(bits.buffers()[2], np.uint8)
        long = np.diff(at) > 8 * SKETCH_WORDS
        self.bits = np.empty((len(at) - 1, SKETCH_WORDS), np.uint64)
        few, many = np.flatnonzero(~long), np.flatnonzero(long)
        self.bits[few] = data[at[few][:, None] + np.arange(8 * SKETCH_WORDS)].view(np.uint64)
        self.more = data[at[many][:, None] + np.arange(8 * SKETCH_MORE)].view(np.uint64)  # of long sets
        self.bits[many] = folded(self.more)
        self.place = np.full(len(long), -1)
        self.place[many] = np.arange(len(many))

    def candidates(self, i: np.ndarray, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of rows (i, j) those that may reach the threshold and that no block has compared."""
        keep = self.label[i] != self.label[j]
        for block in self.blocks:  # 0: in none
            keep &= (block[i] != block[j]) | (block[i] == 0)
        small, large = np.minimum(self.n[i], self.n[j]), np.maximum(self.n[i], self.n[j])
        keep &= 100 * small >= percent * large
        i, j = i[keep], j[keep]
        far = np.bitwise_count(self.bits[i] ^ self.bits[j]).sum(axis=1, dtype=np.int64)
        both = np.flatnonzero((self.place[i] >= 0) & (self.place[j] >= 0))
        for at in range(0, len(both), 4096):
            k = both[at : at + 4096]
            far[k] = np.bitwise_count(self.more[self.place[i[k]]] ^ self.more[self.place[j[k]]]).sum(axis=1, dtype=np.int64)
        keep = (100 + percent) * far <= (100 - percent) * (self.n[i] + self.n[j])
        return i[keep], j[keep]

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The candidates of all lists, as pairs of rows."""
        size = np.bincount(self.list)
        own = size[self.list]
        short = np.flatnonzero(own <= SHORT_LIST)
        lists = self.list[short]
        for lag in range(1, int(own[short].max(initial=1))):
            k = np.flatnonzero(lists[lag:] == lists[:-lag])
            yield self.candidates(short[k], short[k + lag], percent)
        for k in np.flatnonzero(size > SHORT_LIST):
            a, b = np.searchsorted(self.list, [k, k + 1])
            side, label = self.side[a:b], self.label[a:b]
            values, first, counts = np.unique(label, return_inverse=True, return_counts=True)
            # of a whole list, what is outside its largest component; of a cell, what was dealt so
            x = a + np.flatnonzero((side == 1) | (side == 0) & (first != counts.argmax()))
            y = a + np.flatnonzero(side != 1)
            for at in range(0, len(x), 64):
                part = x[at : at + 64]
                yield self.candidates(np.repeat(part, len(y)), np.tile(y, len(part)), percent)


def _candidates(percent: int, rows: int = 1 << 14):
    """Pairs (a, b) of classes with their labels, of lists whose rows stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            held = _Rows(table.combine_chunks().to_batches()[0])
            out: list[tuple[int, int, int, int]] = []
            for i, j in held.pairs(percent):
                for a, b, la, lb in zip(held.cls[i].tolist(), held.cls[j].tolist(), held.label[i].tolist(), held.label[j].tolist()):
                    if a > b:
                        a, b, la, lb = b, a, lb, la
                    if (a, b) not in seen:
                        if len(seen) > 1 << 18:
                            seen.clear()  # a pair may then be named again
                        seen.add((a, b))
                        out.append((a, b, la, lb))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b", "la", "lb"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in slices(batches, rows):
            if size >= rows:  # up to the last list, which may go on
                last = tuple(held[-1].column(k)[-1].as_py() for k in range(3))
                if tuple(batch.column(k)[0].as_py() for k in range(3)) != last:
                    yield from found(pa.Table.from_batches(held))
                    held, size = [], 0
                else:
                    whole = pa.Table.from_batches(held)
                    ends = [whole.column(k).to_numpy() for k in range(3)]
                    cut = int(np.flatnonzero(np.logical_or.reduce([e != v for e, v in zip(ends, last)]))[-1]) + 1 if any((e != v).any() for e, v in zip(ends, last)) else 0
                    if cut:
                        yield from found(whole.slice(0, cut))
                        held, size = whole.slice(cut).combine_chunks().to_batches(), whole.num_rows - cut
            held.append(batch)
            size += batch.num_rows
        if held:
            yield from found(pa.Table.from_batches(held))

    return run


def _verify(width: int, percent: int):
    """Links (a, b) between components, from pairs of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        done: set[tuple[int, int]] = set()
        for batch in slices(batches, 64):
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            one, two = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            open_ = [k for k, p in enumerate(pairs) if p not in done]
            distinct = {p: None for k in open_ for p in (one[k], two[k])}  # a text may stand in several pairs
            sets = dict(zip(distinct, _unpacked(shingler, list(distinct))))
            out = []
            for k in open_:
                x, y = sets[one[k]], sets[two[k]]
                if pairs[k] not in done and _near(len(x), len(y), overlap(x, y), percent):
                    out.append(pairs[k])
                    done.add(pairs[k])
            if out:
                yield _links(out)

    return run


def components(links: DataFrame) -> DataFrame:
    """``node, label``: the smallest node that each node of the links (a, b) can reach.

    A step takes the smallest label of a node's neighbours and then follows the labels once.
    After every other step the labels are written, and only a number comes to the driver.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b")
    label = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label"))

    def step(label: DataFrame) -> DataFrame:
        heard = both.join(label, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        low = label.join(heard, "node").select("node", F.least("label", "heard").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("label").alias("up"))
        return low.join(up, "low", "left").select("node", F.least("low", F.coalesce("up", "low")).alias("label"))

    while True:
        new = step(step(label)).join(label.withColumnRenamed("label", "old"), "node")
        new = written(new, "components", per_core=1)
        changed = new.where("label <> old").count()
        label = new.select("node", "label")
        if not changed:
            return label


def _merged(label: DataFrame | None, found: DataFrame) -> DataFrame:
    """The labels (``cls, label``) after the components ``found`` of labels; a class that isn't named is its own label."""
    if label is None:
        return found.withColumnRenamed("node", "cls")
    more = found.select("node", F.col("label").alias("new"))
    return label.join(more, F.col("label") == F.col("node"), "full").select(F.coalesce("cls", "node").alias("cls"), F.coalesce("new", "label").alias("label"))


def _labelled(df: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return df.withColumn("label", F.col("cls"))
    return df.join(label.hint("merge"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))


def _open(entry: DataFrame, label: DataFrame | None) -> DataFrame:
    """The entries of lists that hold several components, with their component."""
    named = _labelled(entry, label)
    if label is None:
        return named
    mixed = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    return named.join(mixed.hint("merge"), "key", "left_semi")


def similarity_components(spark: SparkSession, docs: DataFrame, percent: int = 85, width: int = 4, often: int = 2048, pairs_up_to: int = 1000, block_from: int = 16, block_rows: int = 512, turns: int = 2, cell_rows: int = 2048, family_rows: int = 1 << 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``; other columns are not read.

    A text's set: its distinct shingles of ``width`` words, A-Z lower-cased, words being what
    stands between ASCII white space; of fewer words the whole sequence. Two rows link when
    their sets' Jaccard similarity is at least ``percent`` / 100; a component's id is its smallest
    doc_id. Null, empty and blank texts have the empty set and link with nothing. A row without
    an id links like any other, but names no component: one of such rows alone has a null
    component id. Rows that repeat an id are rows of their own. Empty tables give empty results.

    ``block_from``, ``block_rows``, ``turns``, ``cell_rows`` and ``family_rows`` decide costs, never the result.
    Equality of shingles is equality of their 64-bit hashes.
    """
    rows, member = _linked(spark, docs, percent, width, often, pairs_up_to, block_from, block_rows, turns, cell_rows, family_rows, id_col, text_col)
    smallest = member.groupBy("component").agg(F.min("least").alias("component_id"))
    of_digest = member.join(smallest, "component").select("digest", "component_id")
    return (
        rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
        .join(of_digest, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def distinct_documents(spark: SparkSession, docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text", **costs) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which one of each component stays (see :func:`similarity_components`).

    It is the one with the smallest id, null ids last, and of rows that repeat it the first as
    Spark numbers them. Rows without words all stay.
    """
    settings = dict(often=2048, pairs_up_to=1000, block_from=16, block_rows=512, turns=2, cell_rows=2048, family_rows=1 << 14) | costs
    rows, member = _linked(spark, docs, percent, width, *settings.values(), id_col, text_col, carry=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("first")
    worded = rows.where("n > 0").select("doc_id", "uid", "digest").groupBy("digest").agg(first)  # of equal sets, then of components
    best = worded.join(member.select("digest", "component"), "digest").groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.uid").alias("uid"))
    kept = written(best.union(rows.where("n = 0").select("uid")), "jaccard-kept", per_core=2)
    del member, worded, best
    free_shuffles(spark)
    found = rows.select("uid", "packed", "rest").join(kept.hint("merge"), "uid", "left_semi")
    at, schema = docs.columns.index(text_col), docs.schema

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rest = batch.column(1)
            columns = rest.flatten()[:-1]
            texts = pa.array([None if p is None else zstandard.decompress(p) for p in batch.column(0).to_pylist()], pa.binary()).cast(pa.string())
            columns.insert(at, texts)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return found.select("packed", "rest").mapInArrow(whole, schema)


def _linked(spark: SparkSession, docs: DataFrame, percent: int, width: int, often: int, pairs_up_to: int, block_from: int, block_rows: int, turns: int, cell_rows: int, family_rows: int, id_col: str, text_col: str, carry: bool = False) -> tuple[DataFrame, DataFrame]:
    """The written rows, and the component of each set (``digest, least, component``). ``carry``: keep the other columns in ``rest``."""
    small_batches(spark)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    level, frequent = token_levels(source, width, often)
    kind = T.DataType.fromDDL(_ROWS)
    if carry:
        others = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(x for x in docs.columns if x != text_col)]
        source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.struct(*others, F.lit(0).alias("none")).alias("rest"))
        kind = kind.add("rest", source.schema["rest"].dataType)
    # numbered by Spark: a task can run several partitions, so its own number isn't enough
    numbered = source.withColumn("uid", F.monotonically_increasing_id()).select("doc_id", "text", "uid", *["rest"] * carry)
    rows = written(numbered.mapInArrow(_index(width, spark.sparkContext.broadcast(level), frequent, percent, pairs_up_to), kind), "jaccard-rows")

    # Equal sets are one class, named after one of its rows.
    named = written(rows.where("n > 0").groupBy("digest").agg(F.min("uid").alias("cls"), F.min("doc_id").alias("least")), "jaccard-named", per_core=2)
    classes = written(rows.select(F.col("uid").alias("cls"), "n", "keys", "bits").where("size(keys) > 0").join(named.select("cls").hint("merge"), "cls", "left_semi"), "jaccard-classes", per_core=2)
    entries = classes.select("cls", F.explode("keys").alias("key"))
    lists = written(entries.groupBy("key").agg(F.count("*").alias("m"), F.min("cls").alias("fam"), F.max("cls").alias("high")).where("m > 1"), "jaccard-lists", per_core=2)
    free_shuffles(spark)
    # lists with the same smallest class are a family, in as many parts as its rows need
    long = lists.where("m > 2").select("key", "m", "fam")
    parts = long.groupBy("fam").agg(F.ceil(F.sum("m") / family_rows).alias("parts"))
    family = F.xxhash64("fam", F.pmod(F.xxhash64("key"), F.col("parts"))).alias("fam")
    longer = entries.join(long.join(parts, "fam").select("key", "m", family).hint("merge"), "key").select("key", "m", "fam", "cls")
    # lists of two, each pair of classes once
    two = lists.where("m = 2").select("fam", "high").distinct().withColumn("key", F.xxhash64("fam", "high"))
    two = two.select("key", F.lit(2).cast("long").alias("m"), F.col("key").alias("fam"), F.explode(F.array("fam", "high")).alias("cls"))
    entry = written(longer.unionByName(two), "jaccard-entries", per_core=2)
    del entries, lists, long, parts, longer, two
    free_shuffles(spark)

    # Blocks of long lists, several times: by a large list of a class and, for lists with several components, another one.
    packed = rows.select(F.col("uid").alias("cls"), "packed")
    hot = entry.where(F.col("m") >= block_from)
    texts = written(packed.join(hot.select("cls").distinct().hint("merge"), "cls", "left_semi"), "jaccard-texts", per_core=2)
    attributes = classes.select("cls", "n", "bits")
    label: DataFrame | None = None
    for turn in range(turns):
        own = _open(hot, label)
        # first the largest list, then one of about the largest, another one each time
        mix = F.xxhash64("key", F.lit(turn)) if turn else F.col("m")
        best = F.max(F.struct(F.ceil(F.log2("m")).alias("level"), mix.alias("mix"), "key"))
        home = own.groupBy("cls", "label").agg(best.alias("best")).select("cls", "label", F.col("best.key").alias("home"))
        salts = home.groupBy("home").agg(F.ceil(F.count("*") / block_rows).alias("salts"))
        dealt = written(home.join(salts, "home").select("cls", "label", F.xxhash64("home", F.pmod(F.xxhash64("cls", F.lit(turn)), "salts")).alias("block")), "jaccard-dealt", per_core=1)
        block = texts.join(dealt.hint("merge"), "cls").select("block", "label", "packed").repartition("block").sortWithinPartitions("block")
        found = written(block.mapInArrow(_blocks(width, percent), "a long, b long").distinct(), "jaccard-links", per_core=1)
        # a class is in one block, and at first a component of its own, so these links say the components
        joined = components(found) if turn else found.select(F.col("b").alias("node"), F.col("a").alias("label")).union(found.select("a", "a")).distinct()
        label = written(_merged(label, joined), "jaccard-labels", per_core=1)
        attributes = attributes.join(dealt.select("cls", F.col("block").alias(f"block{turn}")).hint("merge"), "cls", "left").fillna(0, [f"block{turn}"])
        del own, home, salts, dealt, block, found, joined
        free_shuffles(spark)
    del texts, hot

    # The candidates of lists with several components.
    mixed = _open(entry, label)
    whole = mixed.where(F.col("m") <= cell_rows).select("fam", F.lit(0).cast("long").alias("part"), "key", "cls", "label", F.lit(0).alias("side"))
    long = mixed.where(F.col("m") > cell_rows)
    largest = long.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("top"), F.sum("count").alias("all"))
    largest = largest.select("key", F.col("top.label").alias("top"), F.ceil(F.col("all") / cell_rows).alias("down"), F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.count")) / cell_rows)).alias("across"))
    cells = long.join(largest, "key")
    # a cell: some of what is outside the largest component, and some of all
    where = lambda salt, n: F.pmod(F.xxhash64("cls", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    side = lambda of, k: of.select("fam", (F.col("j") * F.col("across") + F.col("i") + 1).alias("part"), "key", "cls", "label", F.lit(k).alias("side"))
    outside = side(cells.where("label <> top").withColumn("i", where(1, "across")).withColumn("j", every("down")), 1)
    inside = side(cells.withColumn("j", where(2, "down")).withColumn("i", every("across")), 2)
    listed = whole.unionByName(outside).unionByName(inside).join(attributes.hint("merge"), "cls")
    names = ["fam", "part", "key", "cls", "label", "side", "n", "bits", *[f"block{t}" for t in range(turns)]]
    listed = listed.select(*names).repartition("fam", "part").sortWithinPartitions("fam", "part", "key")
    pairs = written(listed.mapInArrow(_candidates(percent), "a long, b long, la long, lb long").distinct(), "jaccard-pairs", per_core=1)
    del entry, classes, attributes, mixed, whole, long, largest, cells, outside, inside, listed
    free_shuffles(spark)

    # Their verification.
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    needed = written(packed.join(wanted.hint("merge"), "cls", "left_semi"), "jaccard-texts", per_core=2)
    of = lambda n: needed.select(F.col("cls").alias(n), F.col("packed").alias(f"p{n}")).hint("merge")
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("la", "lb", "pa", "pb", "a", "b").repartition("a", F.pmod(F.hash("b"), F.lit(16))).sortWithinPartitions("a")
    rest = written(both.mapInArrow(_verify(width, percent), "a long, b long").distinct(), "jaccard-links", per_core=1)
    label = written(_merged(label, components(rest)), "jaccard-labels", per_core=1)
    del pairs, wanted, needed, both, rest
    free_shuffles(spark)

    return rows, _labelled(named, label).select("digest", "least", F.col("label").alias("component"))
