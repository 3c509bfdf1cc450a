"""Exact deduplication with skew-safe combining.

Every stage compares the full content, digests only route rows:

1. *local*: each input partition folds its equal texts into one entry (content, winner,
   members) and writes it to a table in the shared folder;
2. *salted*: entries meet by (digest, salt), where the salt follows the input partition. A digest
   has one salt for each ``salt_entries`` of its entries;
3. *global*: the salt winners of a digest that has several meet and give the winner.

Members never travel with the content. They are joined back by their entry's key, of which
there is one for each partition and text, so no join key is hotter than one input partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import with_row_key, written

WHITE_SPACE = b" \t\n\x0b\x0c\r"
_ENTRY = "digest binary, content binary, n long, best long, row binary, cnt long, members array<long>, rows array<binary>"
_ENTRY_ARROW = pa.schema(
    [("digest", pa.binary()), ("content", pa.binary()), ("n", pa.int64()), ("best", pa.int64()), ("row", pa.binary()), ("cnt", pa.int64()), ("members", pa.list_(pa.int64())), ("rows", pa.list_(pa.binary()))]
)


def _fold(held_bytes: int):
    """The local stage; it lets go of its entries when they hold ``held_bytes`` of content."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            out: list[tuple] = []
            weight = 0
            for content, (n, best, row, members, rows) in held.items():
                small = squeeze(content)
                out.append((hashlib.sha256(content).digest(), small, n, best, row, len(members) + 1, members, rows))
                weight += len(small) + 16 * len(members)
                if weight > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ENTRY_ARROW)], schema=_ENTRY_ARROW)
                    out, weight = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ENTRY_ARROW)], schema=_ENTRY_ARROW)
            held.clear()
            size = 0

        for batch in batches:
            for key, text, row in zip(batch.column(0), batch.column(1), batch.column(2)):
                key, text, row = key.as_py(), text.as_py() or "", row.as_py()
                content = text.encode("utf-8", "surrogatepass").translate(None, WHITE_SPACE)
                entry = held.get(content)
                if entry is None:
                    held[content] = [len(text), key, row, [], []]
                    size += len(content)
                    if size > held_bytes:
                        yield from flush()
                elif (-len(text), key is None, key or 0) < (-entry[0], entry[1] is None, entry[1] or 0):
                    entry[3].append(entry[1])
                    entry[4].append(entry[2])
                    entry[0], entry[1], entry[2] = len(text), key, row
                else:
                    entry[3].append(key)
                    entry[4].append(row)
        yield from flush()

    return entries


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, salt_entries: int = 64, held_bytes: int = 48 << 20) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting space, tab, line feed, vertical tab, form
    feed and carriage return. Of equal texts the one with the most code points stays, then the
    one with the smallest id. A null text counts as empty, so all null, empty and blank texts
    are one group. A null id loses against any other. Of rows that repeat an id and a text one
    stays. An empty table gives an empty result; other columns are not read.

    ``row_col``: a binary key of each row, returned as ``row``, by which rows can be told apart
    whose ids repeat. ``salt_entries``: the entries of a digest that meet in one group;
    the winners of its groups meet afterwards. ``held_bytes``: the content that a task holds
    before it passes its entries on; equal texts that are passed on separately meet again in the
    salted stage, so the result doesn't depend on it.
    """
    number = F.col(row_col).cast("binary") if row_col else F.lit(None).cast("binary")
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), number.alias("row"))
    # numbered by Spark: its numbers say the partition, and no two tasks share one
    entries = written(source.mapInArrow(_fold(held_bytes), _ENTRY).withColumn("uid", F.monotonically_increasing_id()), "exact")
    rank = F.struct((-F.col("n")).alias("n"), F.col("best").isNull().alias("no_id"), F.col("best"), F.col("uid"))
    # Digests of many entries: at most one in ``salt_entries`` entries, mostly few or none.
    salts = F.ceil(F.col("entries") / salt_entries).alias("salts")
    hot = written(entries.groupBy("digest").agg(F.count("*").alias("entries")).where(F.col("entries") > salt_entries).select("digest", salts), "hot", per_core=1)
    salted = (
        entries.select("digest", "content", "uid", "cnt", rank.alias("rank"))
        .join(hot, "digest", "left")
        .select("digest", "content", "uid", "cnt", "rank", F.coalesce("salts", F.lit(1)).alias("salts"))
        .withColumn("salt", F.pmod(F.shiftright("uid", 33), F.col("salts")))
        .repartition("digest", "salt")
        .groupBy("digest", "salts", "salt", "content")
        .agg(F.min("rank").alias("top"), F.sum("cnt").alias("group_size"), F.collect_list("uid").alias("uids"))
    )
    equal = Window.partitionBy("digest", "content")
    merged = salted.where("salts > 1").repartition("digest").select("uids", F.min("top").over(equal).alias("top"), F.sum("group_size").over(equal).alias("group_size"))
    winners = salted.where("salts = 1").select("uids", "top", "group_size").unionByName(merged).select(F.explode("uids").alias("uid"), "top", "group_size")
    kind = "array<struct<id:bigint,row:binary,kept:boolean>>"
    members = F.transform(F.arrays_zip(F.col("members").alias("id"), F.col("rows").alias("row")), lambda m: F.struct(m["id"].alias("id"), m["row"].alias("row"), F.lit(False).alias("kept")))
    first = F.array(F.struct(F.col("best").alias("id"), F.col("row"), (F.col("uid") == F.col("top.uid")).alias("kept")))
    out = (
        entries.select("uid", "digest", "best", "row", "members", "rows")
        .join(winners, "uid")
        .select(F.explode(F.concat(first.cast(kind), members.cast(kind))).alias("one"), F.col("top.best").alias("keep_id"), "group_size", F.lower(F.hex("digest")).alias("text_sha256"))
        .select(F.col("one.id").alias("doc_id"), "keep_id", "group_size", F.col("one.kept").alias("kept"), "text_sha256", F.col("one.row").alias("row"))
    )
    return out if row_col else out.drop("row")


def unique_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all their columns, that :func:`exact_dedup` keeps."""
    key = "row"
    while key.lower() in {c.lower() for c in df.columns}:
        key += "_"
    rows = with_row_key(df, key)
    kept = written(exact_dedup(rows, id_col, text_col, key).where("kept").select(F.col("row").alias(key)), "kept", per_core=2)
    return rows.join(kept.hint("merge"), key, "left_semi").select(*[rows[f"`{c}`"] for c in df.columns])  # both sides grow with the corpus
