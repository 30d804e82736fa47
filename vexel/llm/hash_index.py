"""A sharded index of 128-bit hashes: minimal perfect hashing into compact fingerprint and value arrays.

Keys are dealt to shards of about SHARD_KEYS by their high word. A shard's function is a cascade of bit arrays: a key
whose place in the first array is its alone stays there, the others go on to the next array. A key's number is the rank
of its bit, so n keys fill arrays of exactly n cells. A fingerprint, the key's low word, tells members from others.

Spark writes the shards, one row each, as a table partitioned by shard in the shared folder; workers open the shards
that their batch needs and keep a bounded number of bytes of them.
"""

from __future__ import annotations

import collections
import re

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

#: Keys a shard (about), bytes of shards a worker keeps, cells a key in each bit array.
SHARD_KEYS, KEPT_BYTES, ROOM = 250_000, 96 << 20, 2


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path that Spark takes too, and the place there. Paths without a scheme are refused, since
    Spark may take them for another file system's."""
    if "://" not in path:
        raise ValueError(f"{path} has no scheme, such as file:///")
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def _place(keys: np.ndarray, level: int, cells: int) -> np.ndarray:
    h = (keys ^ np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return ((h ^ (h >> np.uint64(29))) % np.uint64(cells)).astype(np.int64)


class PerfectHash:
    """Numbers distinct uint64 keys 0 to n-1; any other key gets some number or -1."""

    def __init__(self, cells: np.ndarray, words: np.ndarray):
        self.cells, self.words = cells, words
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.first = np.concatenate([[0], np.cumsum(cells)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        cells, words, level = [], [], 0
        while len(keys):
            if level > 100:
                raise ValueError("equal keys")
            n = -(-max(64, ROOM * len(keys)) // 64) * 64
            at = _place(keys, level, n)
            alone = np.bincount(at, minlength=n) == 1
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            cells.append(n)
            keys, level = keys[~alone[at]], level + 1
        return cls(np.array(cells, np.int64), np.concatenate(words) if words else np.zeros(0, np.uint64))

    def number(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, n in enumerate(self.cells.tolist()):
            at = _place(keys[left], level, n) + self.first[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[left[hit]] = (self.before[at >> 6] + below)[hit]
            left = left[~hit]
            if not len(left):
                break
        return out


class HashIndex:
    """What workers need to look keys up: where the shards are, how many keys each has, and which values they hold.

    values: for each its numpy type; larger numbers than it holds become its largest.
    """

    def __init__(self, path: str, sizes: np.ndarray, values: dict[str, str]):
        self.path, self.sizes, self.values = path, sizes, values

    @classmethod
    def build(cls, spark: SparkSession, keys: DataFrame, total: int, values: dict[str, str], shard_keys: int = SHARD_KEYS) -> HashIndex:
        """keys: distinct (hi, lo) longs and the values; total: how many."""
        shards = -(-total // shard_keys)
        path = scratch(spark, "hash-index")
        if not shards:
            return cls(path, np.zeros(0, np.int64), values)

        def shard(key, rows: pd.DataFrame) -> pd.DataFrame:
            hi = rows["hi"].to_numpy(np.int64).view(np.uint64)
            lo = rows["lo"].to_numpy(np.int64).view(np.uint64)
            perfect = PerfectHash.build(hi ^ (lo << np.uint64(1)))
            order = np.argsort(perfect.number(hi ^ (lo << np.uint64(1))))
            arrays = {"cells": perfect.cells, "words": perfect.words, "fingerprint": lo[order]}
            arrays |= {v: np.minimum(rows[v].to_numpy(np.int64), np.iinfo(kind).max).astype(kind)[order] for v, kind in values.items()}
            return pd.DataFrame({"shard": [key[0]], "keys": [len(rows)]} | {c: [a.tobytes()] for c, a in arrays.items()})

        names = ["cells", "words", "fingerprint", *values]
        dealt = keys.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int")).groupBy("shard")
        dealt.applyInPandas(shard, "shard int, keys long, " + ", ".join(f"{c} binary" for c in names)).write.partitionBy("shard").option("compression", "zstd").parquet(path)
        sizes = np.zeros(shards, np.int64)
        for r in spark.read.schema("keys long, shard int").parquet(path).collect():
            sizes[r["shard"]] = r["keys"]
        if sizes.sum() != total:
            raise RuntimeError(f"{path} has {sizes.sum()} of {total} keys")
        return cls(path, sizes, values)

    def find(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which keys (uint64 pairs) are members, and the values of all keys (0 for others)."""
        found, out = np.zeros(len(hi), bool), {v: np.zeros(len(hi), np.int64) for v in self.values}
        if not len(self.sizes) or not len(hi):
            return found, out
        shard = np.mod(hi.view(np.int64), len(self.sizes))
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for at in np.split(order, cuts[1:]):
            number = int(shard[at[0]])
            if not self.sizes[number]:
                continue
            part = _open(self.path, number, int(self.sizes[number]), self.values)
            cell = part["perfect"].number(hi[at] ^ (lo[at] << np.uint64(1)))
            hit = (cell >= 0) & (part["fingerprint"][cell] == lo[at])
            found[at] = hit
            for v in self.values:
                out[v][at[hit]] = part[v][cell[hit]]
        return found, out


_kept: collections.OrderedDict[tuple[str, int], dict] = collections.OrderedDict()


def _open(path: str, shard: int, keys: int, values: dict[str, str]) -> dict:
    """A shard's arrays, all of its keys; the least recently used shards go when KEPT_BYTES are passed."""
    if (path, shard) in _kept:
        _kept.move_to_end((path, shard))
        return _kept[path, shard]
    system, base = file_system(path)
    files = [f.path for f in system.get_file_info(fs.FileSelector(f"{base}/shard={shard}")) if f.base_name.endswith(".parquet")]
    rows = []
    for file in files:
        with system.open_input_file(file) as source:
            rows += pq.ParquetFile(source).read().to_pylist()
    if [r["keys"] for r in rows] != [keys]:
        raise RuntimeError(f"shard {shard} of {path} has {[r['keys'] for r in rows]} keys, not {keys}")
    row = rows[0]
    part = {v: np.frombuffer(row[v], kind) for v, kind in values.items()} | {"fingerprint": np.frombuffer(row["fingerprint"], np.uint64)}
    part |= {"perfect": PerfectHash(np.frombuffer(row["cells"], np.int64), np.frombuffer(row["words"], np.uint64)), "bytes": sum(len(x) for x in row.values() if isinstance(x, bytes))}
    _kept[path, shard] = part
    while len(_kept) > 1 and sum(p["bytes"] for p in _kept.values()) > KEPT_BYTES:
        _kept.popitem(last=False)
    return part
