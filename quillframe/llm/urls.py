"""URL filters over a sorted array of digests.

Rules ("host/path" strings with a verdict) become one file: their 64-bit xxhash keys in sorted
order, then the verdicts and the full strings. Spark ships the file to the executors, each task
maps it into memory, looks up the candidates of a batch with one vectorised binary search, and
confirms every hit against the stored string, so that colliding keys can't decide.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, write_bytes

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_MAGIC = 0x3152_4C55  # the first field of the file


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(rule: str) -> int:
    return xxhash.xxh64_intdigest(rule.encode())


class Index:
    """The file of rules, mapped into memory."""

    def __init__(self, path: str):
        head = np.memmap(path, np.int64, "r", 0, 5)
        if head[0] != _MAGIC:
            raise ValueError(f"{path} is no file of rules")
        n, lengths, hosts, blob = (int(x) for x in head[1:])
        self.keys = np.memmap(path, np.uint64, "r", 40, n) if n else np.empty(0, np.uint64)
        self.ends = np.memmap(path, np.int64, "r", 40 + 8 * n, n + 1)
        at = 40 + 8 * n + 8 * (n + 1)
        self.lengths = np.memmap(path, np.int64, "r", at, lengths).tolist() if lengths else []  # of the rules' paths
        self.hosts = np.memmap(path, np.int64, "r", at + 8 * lengths, hosts).tolist() if hosts else []  # of their hosts
        at += 8 * (lengths + hosts)
        self.codes = np.memmap(path, np.uint8, "r", at, n) if n else np.empty(0, np.uint8)
        self.blob = np.memmap(path, np.uint8, "r", at + n, blob) if blob else np.empty(0, np.uint8)

    @staticmethod
    def pack(rules: Iterable[tuple[str, str, str]]) -> bytes:
        """``rules``: (verdict, host, path). A later rule replaces an equal earlier one."""
        kept: dict[str, tuple[int, int]] = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"no such verdict: {verdict}")
            kept[host + path] = (verdict == "block", len(path))
        order = sorted(kept, key=lambda r: (key_of(r), r))
        texts = [r.encode() for r in order]
        lengths = sorted({kept[r][1] for r in order})
        hosts = sorted({len(r) - kept[r][1] for r in order})
        return b"".join(
            x.tobytes()
            for x in (
                np.array([_MAGIC, len(order), len(lengths), len(hosts), sum(map(len, texts))], np.int64),
                np.array([key_of(r) for r in order], np.uint64),
                np.cumsum([0, *map(len, texts)]).astype(np.int64),
                np.array(lengths, np.int64),
                np.array(hosts, np.int64),
                np.array([kept[r][0] for r in order], np.uint8),
            )
        ) + b"".join(texts)

    def candidates(self, host: str, path: str) -> list[str]:
        """Every string that a fitting rule can have, the longest first; of equal length, the longer host first.

        There are no more than the rules' lengths of hosts times those of paths, however long the URL is.
        """
        ends = [h for h in self.hosts if h == len(host) > 0 or 0 < h < len(host) and host[-h - 1] == "."]
        found = [(h + n, h) for h in ends for n in self.lengths if n <= len(path)]
        return [host[len(host) - h :] + path[: size - h] for size, h in sorted(found, reverse=True)]

    def find(self, wanted: list[str]) -> np.ndarray:
        """For each string the position of its rule, or -1."""
        keys = np.fromiter(map(key_of, wanted), np.uint64, len(wanted))
        at = np.searchsorted(self.keys, keys)
        out = np.full(len(wanted), -1, np.int64)
        near = np.flatnonzero(at < len(self.keys))
        for i in near[self.keys[at[near]] == keys[near]].tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == keys[i]:  # strings whose keys collide stand side by side
                if self.blob[self.ends[j] : self.ends[j + 1]].tobytes() == wanted[i].encode():
                    out[i] = j
                    break
                j += 1
        return out


def url_filter(spark: SparkSession, df: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    A rule (verdict, host, path) fits its host and all subdomains, where the URL's path starts
    with the rule's. The longest fitting rule decides; where none fits, ``rule`` is null and
    ``verdict`` is ``default``. A null URL or one without ``://`` has an empty host and path and
    so fits no rule. Repeated rows stay repeated; an empty table gives an empty result.
    """
    path = shared_path(spark, "urls")
    write_bytes(spark, path, Index.pack(rules))
    spark.sparkContext.addFile(path)
    name = posixpath.basename(path)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            wanted: dict[str, int] = {}
            rows = [[wanted.setdefault(c, len(wanted)) for c in index.candidates(h, p)] for h, p in zip(hosts, paths)]
            found = index.find(list(wanted))
            names = list(wanted)
            rule: list[str | None] = []
            verdict: list[str] = []
            for row in rows:
                hit = next((k for k in row if found[k] >= 0), None)
                rule.append(None if hit is None else names[hit])
                verdict.append(default if hit is None else ("block" if index.codes[found[hit]] else "allow"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    url = F.col(url_col).cast("string")
    parsed = df.select(F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    return parsed.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
