"""Documents of several vectors, scored by late interaction: for each query vector the best document vector, summed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distances as D
from .search import PART, SLICE, TILE, by_length, together, top


def sign_words(vectors: np.ndarray) -> np.ndarray:
    """Bits of what is not below zero, as 64-bit words."""
    bits = np.packbits(~(vectors < 0), axis=1, bitorder="little")
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.int64)


def similarity(metric: str, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Of all query vectors (lines) to all vectors (columns), at nine digits: IP (also for names unknown), cosine with norms of at
    least 1e-8, negated squared L2, or sign-bit agreement."""
    if metric in ("hamming", "jaccard"):
        far = D.matrix_distance(metric, sign_words(queries), sign_words(vectors))
        return D.rounded(2.0 * (vectors.shape[1] - far) - vectors.shape[1] if metric == "hamming" else 1 - far)
    columns = np.ascontiguousarray(vectors.T)
    if metric == "l2":
        return D.rounded(-D.exact("l2_sq", queries, columns))
    same = D.exact("ip", queries, columns, similar=True)
    return D.rounded(same / (np.maximum(D.norms(columns), 1e-8) * np.maximum(D.norms(queries.T), 1e-8)[:, None]) if metric == "cosine" else same)


def maxsim(tokens: DataFrame, queries: DataFrame, metric: str = "ip") -> DataFrame:
    """query_id, id, score. tokens: (id, vec), a row a vector; queries: (query_id, pos, q).

    Query vectors are collected, and broadcast in parts of whole queries. The vectors of a document come one after another in one task,
    which keeps the best so far of the document that it reads, so a document may be of any length. Pairs without a similarity (null
    vectors, other lengths) count for nothing; a score without any is null."""
    spark, parts = tokens.sparkSession, []
    table = queries.select("query_id", "pos", "q").toArrow().sort_by([("query_id", "ascending"), ("pos", "ascending")]).combine_chunks()
    if table.num_rows:
        ids, pos, q = (table[c].chunk(0) for c in ("query_id", "pos", "q"))
        new, cuts = _changes(ids), [0]
        for start in np.flatnonzero(new)[1:].tolist():
            if start - cuts[-1] >= PART:
                cuts.append(start)
        for first, n in zip(cuts, np.diff([*cuts, len(ids)]).tolist()):
            some = slice(first, first + n)
            parts.append(spark.sparkContext.broadcast((ids.slice(first, n), by_length(q.slice(first, n)), np.flatnonzero(new[some]), np.flatnonzero(new[some] | _changes(pos)[some]))))
    schema = T.StructType([queries.schema["query_id"], tokens.schema["id"], T.StructField("score", T.DoubleType())])

    def best_of(rows, starts, part):
        """Best similarity of each query vector (lines) to the vectors of each document (columns); -inf without any."""
        ids, groups, _, _ = part
        out = np.full((len(ids), len(starts)), -np.inf)
        of = np.repeat(np.arange(len(starts)), np.diff([*starts, rows.num_rows]))
        for length, at, vectors in by_length(rows.column("vec")):
            for n, places, q in groups:
                if n != length or n < 0:
                    continue
                docs, cut = np.unique(of[at], return_index=True)
                for i in range(0, len(places), step := max(1, TILE // len(at))):
                    near = np.maximum.reduceat(similarity(metric, q[i : i + step], vectors), cut, axis=1)
                    some = np.ix_(places[i : i + step], docs)
                    out[some] = np.maximum(out[some], near)
        return out

    def scores(part, ids, best):
        query_ids, _, of_query, of_pos = part
        if len(of_pos) != len(best):
            best = np.maximum.reduceat(best, of_pos, axis=0)
        at = np.searchsorted(of_pos, of_query)
        none = np.isneginf(best)
        total = D.rounded(np.add.reduceat(np.where(none, 0.0, best), at, axis=0), 6)
        null = np.logical_and.reduceat(none, at, axis=0)
        line, column = np.divmod(np.arange(total.size), total.shape[1])
        return pa.RecordBatch.from_arrays([query_ids.take(pa.array(of_query[line])), ids.take(pa.array(column)), pa.array(total.ravel(), mask=null.ravel())], names=schema.names)

    def run(batches):
        held = None  # the document that is being read: its id, and the best of it for each part
        step = max(1, min(SLICE, (1 << 23) // max((len(p.value[0]) for p in parts), default=1)))
        for rows in (batch.slice(i, step) for batch in batches for i in range(0, batch.num_rows, step)):
            ids = rows.column("id")
            starts = np.flatnonzero(_changes(ids))
            docs = ids.take(pa.array(starts))
            kept = []
            for k, part in enumerate(p.value for p in parts):
                best = best_of(rows, starts, part)
                if held is not None and held[0].equals(docs.slice(0, 1)):
                    best[:, 0] = np.maximum(best[:, 0], held[1][k])
                elif held is not None:
                    yield scores(part, held[0], held[1][k][:, None])
                kept.append(best[:, -1].copy())
                if len(starts) > 1:
                    yield scores(part, docs.slice(0, len(docs) - 1), best[:, :-1])
            held = docs.slice(len(docs) - 1), kept
        if held is not None:
            for k, part in enumerate(p.value for p in parts):
                yield scores(part, held[0], held[1][k][:, None])

    near = tokens.select("id", "vec").repartition(3 * spark.sparkContext.defaultParallelism, "id").sortWithinPartitions("id")
    return near.mapInArrow(lambda batches: together(run(batches)), schema)


def _changes(ids: pa.Array) -> np.ndarray:
    """Which differ from the one before; the first does."""
    codes = pc.dictionary_encode(ids, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]


def search(tokens: DataFrame, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    return top(maxsim(tokens, queries, metric).withColumn("distance", -F.col("score")), k).select("query_id", "rank", "id", "score")


def by_ids(tokens: DataFrame, queries: DataFrame, wanted: DataFrame, metric: str = "ip") -> DataFrame:
    """Scores of requested documents (ord, id) in order; null for unknown or empty ones."""
    scored = maxsim(tokens.join(wanted.select("id").distinct(), "id", "left_semi"), queries, metric)
    asked = wanted.crossJoin(F.broadcast(queries.select("query_id").distinct()))
    return asked.join(scored, ["query_id", "id"], "left").select("query_id", "ord", "id", "score")
