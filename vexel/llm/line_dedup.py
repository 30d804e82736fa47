"""Line dedup: a sharded minimal perfect hash over line hashes, probed by documents instead of a join.

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys long enough and found in enough
documents lose all their lines except in the largest doc_id that holds them. One pass counts, for every key of the
corpus, the documents that hold it; keys of enough documents enter the index with count and largest doc_id; a
second pass probes the index from inside each document, so neither lines nor texts are joined or shuffled.

Lines are known by 128-bit hashes: half deals them to shards, and half is the fingerprint that the index compares.

Defined results: null text counts as empty, one empty line; a null doc_id is smaller than any other; rows that repeat
a doc_id count as documents of their own, and all rows of the largest doc_id keep their lines; an empty table gives an
empty result; other columns are ignored; a very long text is held as its lines, with 16 bytes of hash for each long one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import slices, texts_of
from .common import NO_ID, staged, table
from .hash_index import HashIndex

#: Code points of a key, and documents that hold it, from which its lines are dropped.
LEAST_CHARS, LEAST_DOCS = 40, 5
BLANK = " \t\n\x0b\x0c\r"


def line_hashes(text: str, least_chars: int) -> tuple[list[str], list[int], bytes]:
    """The text's lines; the places of those whose key is long enough; and their 16-byte hashes."""
    lines, at, hashes = text.split("\n"), [], []
    for i, line in enumerate(lines):
        if len(line) >= least_chars and len(key := line.strip(BLANK)) >= least_chars:
            at.append(i)
            hashes.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))
    return lines, at, b"".join(hashes)


def _pairs(hashes: bytes) -> np.ndarray:
    return np.frombuffer(hashes, np.uint64).reshape(-1, 2)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def line_index(spark: SparkSession, docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> HashIndex:
    """Index of the keys found in `least_docs` or more documents: n (documents, 255 at most) and last (the largest doc_id)."""

    def keys(batches):
        for batch in slices(batches):
            ids = [NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()]
            each = [np.unique(_pairs(line_hashes(t, least_chars)[2]), axis=0) for t in texts_of(batch).to_pylist()]
            both = np.concatenate(each).view(np.int64)
            yield pa.record_batch({"hi": both[:, 0], "lo": both[:, 1], "doc_id": np.repeat(np.array(ids, np.int64), [len(x) for x in each])})

    found = _rows(docs).mapInArrow(keys, "hi long, lo long, doc_id long").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    repeated = staged(spark, found.where(F.col("n") >= least_docs), "line-keys")
    return HashIndex.build(spark, repeated, repeated.count(), {"n": "uint8", "last": "int64"})


def drop_lines(docs: DataFrame, index: HashIndex, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, and text (the kept lines) or kept_sha256 as asked for."""

    def probe(batches):
        for batch in slices(batches):
            ids = np.array([NO_ID if i is None else i for i in batch.column("doc_id").to_pylist()], np.int64)
            each = [line_hashes(t, least_chars) for t in texts_of(batch).to_pylist()]
            many = [len(at) for _, at, _ in each]
            both = _pairs(b"".join(h for _, _, h in each))
            found, value = index.find(np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]))
            gone = found & (value["n"] >= min(least_docs, 255)) & (value["last"] != np.repeat(ids, many))
            kept, dropped, start = [], [], 0
            for (lines, at, _), n in zip(each, many):
                drop = {at[k] for k in np.flatnonzero(gone[start : start + n])}
                kept.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else "\n".join(lines))
                dropped.append(len(drop))
                start += n
            out = {"doc_id": batch.column("doc_id"), "n_lines": pa.array([len(x) for x, _, _ in each], pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}
            made = {"text": lambda: kept, "kept_sha256": lambda: [hashlib.sha256(k.encode()).hexdigest() for k in kept]}
            yield pa.record_batch(out | {c: pa.array(made[c](), pa.string()) for c in columns})

    return _rows(docs).mapInArrow(probe, "doc_id long, n_lines long, n_dropped long" + "".join(f", {c} string" for c in columns))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return drop_lines(docs, line_index(spark, docs), columns=("kept_sha256",))


ORACLE = {
    "op5_line_dedup": r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents),
k AS (SELECT doc_id, n, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, n, line, f.key IS NOT NULL AND k.doc_id <> f.last AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
