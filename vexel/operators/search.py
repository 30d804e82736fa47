"""Exact search: top-k, radius, rerank, paging, lookups. Queries are a table too.

Base tables are (id, vec); query tables are (query_id, q). Results are long: one row per hit, no padding. Ties go to the
smaller id. Filters are semi- and anti-joins below the ranking, so a filtered search still returns k hits.

`scored` takes all distances where the rows are: queries are collected and broadcast in parts, each row meets the numbers of
the parts, and tasks score batches of rows with whole parts, in the order of SQL's sums. No pair of vectors is ever a row.
Each task ranks what it read, and about k rows a query and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distances as D

#: Queries that are broadcast at once by joins, and to tasks that score.
BLOCK, PART = 2048, 1 << 16
#: Queries from which rows are dealt out evenly before they are scored, which then costs less than scoring them.
MANY = 256
#: Rows and pairs that are scored at once, and results that are handed on at once, about.
SLICE, TILE, EMITTED = 4096, 1 << 15, 1 << 16
#: Metrics of bit vectors.
BITS = ("hamming", "jaccard")


def in_blocks(queries: DataFrame, run: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """The union of run(part) over parts of the queries that are small enough to broadcast."""
    parts = -(-queries.count() // block) or 1
    if parts == 1:
        return run(F.broadcast(queries))
    cut = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    return reduce(DataFrame.unionByName, (run(F.broadcast(queries.where(cut == i))) for i in range(parts)))


def top(scored: DataFrame, k: int, by: str = "distance", per: str = "query_id", tie: str = "id") -> DataFrame:
    """The k least of each query, with rank from 1. The filter on the window lets Spark limit before the shuffle."""
    window = Window.partitionBy(per).orderBy(F.col(by).asc_nulls_last(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def excluding(base: DataFrame, excluded: DataFrame | None, allowed: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """base without excluded ids, with allowed ids only, and where a predicate holds, before any ranking."""
    if excluded is not None:
        base = base.join(excluded.select("id").distinct(), "id", "left_anti")
    if allowed is not None:
        base = base.join(allowed.select("id").distinct(), "id", "left_semi")
    return base if where is None else base.where(where)


def rounded(distance: Column) -> Column:
    """Distances are compared at nine digits, so that equal ones tie whatever the order of summation."""
    return F.round(distance, 9) + F.lit(0.0)


def by_length(column: pa.Array, dtype=np.float64) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and matrix of the vectors of each length; length -1: of those that are null or have a null in them."""
    if not len(column):
        return []
    n = np.asarray(column.value_lengths().fill_null(-1))
    values, kept = column.flatten(), n
    start = np.cumsum(np.maximum(n, 0)) - np.maximum(n, 0)
    if values.null_count:
        nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        kept, values = np.where(nulls[start + np.maximum(n, 0)] > nulls[start], -1, n), values.fill_null(0)
    numbers = values.to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    out = []
    for length in np.unique(kept):
        at = np.flatnonzero(kept == length)
        out.append((int(length), at, numbers.reshape(len(n), -1) if len(at) == len(n) and length > 0 else numbers[start[at, None] + np.arange(max(length, 0))]))
    return out


def order_of(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of the ids."""
    if pa.types.is_integer(ids.type) and not ids.null_count:
        return ids.to_numpy(zero_copy_only=False)
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)


def among(far: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and columns of the k least of each line, ties to the smaller id; NaN is greater than any number."""
    mask = np.ones(far.shape, bool)
    if far.shape[1] > k:
        most = np.partition(far, k - 1, 1)[:, k - 1 : k]
        mask = (far <= most) | np.isnan(most)
    line, column = np.nonzero(mask)
    at = np.lexsort((order[column], far[line, column], line))
    line, column = line[at], column[at]
    nth = np.arange(len(line)) - np.searchsorted(line, line)
    return line[nth < k], column[nth < k]


class Nearest:
    """The k least of each line of what was added. About `most` rows are held."""

    def __init__(self, k: int, most: int = 1 << 20):
        self.k, self.most, self.held, self.n = k, most, [], 0

    def add(self, line: np.ndarray, ids: pa.Array, far: np.ndarray) -> None:
        self.held.append((line, ids, far))
        self.n += len(line)
        if self.n > 2 * self.most:
            self._prune()

    def _prune(self) -> None:
        line, ids, far = np.concatenate([h[0] for h in self.held]), pa.concat_arrays([h[1] for h in self.held]), np.concatenate([h[2] for h in self.held])
        at = np.lexsort((order_of(ids), far, line))
        nth = np.arange(len(line)) - np.searchsorted(line[at], line[at])
        at = at[nth < self.k]
        self.held, self.n = [(line[at], ids.take(pa.array(at)), far[at])], len(at)

    def taken(self, least: int = 0) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """What is held, if that is more than `least` rows."""
        if self.n > least:
            self._prune()
            yield self.held[0]
            self.held, self.n = [], 0


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of EMITTED or more, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= EMITTED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def asked_in_parts(queries: DataFrame, dtype, visits=None) -> tuple[list, int]:
    """Broadcasts of (ids, groups) of at most PART queries, and the number of queries. A group has the length of its vectors, places,
    matrix, norms and, with visits, which lines visit which list."""
    table, out = queries.select("query_id", "q").toArrow(), []
    for first in range(0, table.num_rows, PART):
        part = table.slice(first, PART).combine_chunks()
        groups = [(n, at, q, D.norms(q.T) if dtype == np.float64 else None, visits(q) if visits else None) for n, at, q in by_length(_whole(part["q"]), dtype)]
        out.append(queries.sparkSession.sparkContext.broadcast((_whole(part["query_id"]), groups)))
    return out, table.num_rows


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def dealt(base: DataFrame, asked: int, *by: str) -> DataFrame:
    """base in even parts, of rows that are near by `by`, if so many queries are asked that this costs less than scoring."""
    n = 3 * base.sparkSession.sparkContext.defaultParallelism
    return base if asked < MANY else base.repartitionByRange(n, *by) if by else base.repartition(n)


def scored(base: DataFrame, queries: DataFrame, metric: str, similar: bool = False, k: int | None = None, limit: float | None = None, visits: Callable[[np.ndarray], dict] | None = None) -> DataFrame:
    """query_id, id, distance (nine digits) of all pairs of a query and a row; with limit, of those up to it; with k, of the k nearest
    of each query that each task finds. visits: which lines of a matrix of queries visit which list; only their pairs with rows of
    that `list` count. Vectors of different lengths, or with nulls, have no distance (null; a cosine similarity of 0)."""
    spark, dtype, listed = base.sparkSession, np.int64 if metric in BITS else np.float64, visits is not None
    parts, asked = asked_in_parts(queries, dtype, visits)
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", base.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    unknown = np.nan if metric != "cosine" else float(not similar)

    def tiles(batch, number):
        """Places of queries and rows of the part's pairs, and their distances, a tile at a time."""
        _, groups = parts[number].value
        for length, at, vectors in by_length(batch.column("vec"), dtype):
            lists = batch.column("list").to_numpy()[at] if listed else np.zeros(len(at), np.int8)
            order = np.argsort(lists, kind="stable")
            for same in np.split(order, np.flatnonzero(np.diff(lists[order])) + 1):
                for some in (same[i : i + SLICE] for i in range(0, len(same), SLICE)):
                    columns = np.ascontiguousarray(vectors[some].T)
                    sizes = D.norms(columns) if metric == "cosine" else None
                    for n, places, q, norms, lines in groups:
                        mine = lines.get(int(lists[some[0]]), ()) if listed else range(len(places))
                        for i in range(0, len(mine), step := max(1, TILE // len(some))):
                            now = np.asarray(mine[i : i + step])
                            if n != length or n < 0:
                                yield places[now], at[some], np.full((len(now), len(some)), unknown), metric != "cosine"
                            else:
                                far = D.exact(metric, q[now], columns, similar, (norms[now], sizes) if metric == "cosine" else None)
                                yield places[now], at[some], D.rounded(far), False

    def found(batches):
        best = Nearest(k) if k is not None else None
        for batch in batches:
            numbers = batch.column("_part").to_numpy()
            for number in np.unique(numbers):
                rows = batch if len(parts) == 1 else batch.filter(pa.array(numbers == number))
                ids, asked_ids = rows.column("id"), parts[number].value[0]
                order = order_of(ids) if best else None
                for query, row, far, null in tiles(rows, int(number)):
                    if best:
                        line, column = among(far, order[row], k) if k > 0 else (np.zeros(0, int),) * 2
                        best.add(int(number) * PART + query[line], ids.take(pa.array(row[column])), far[line, column])
                        continue
                    if limit is not None:
                        line, column = np.nonzero(far <= limit)
                        if not len(line):
                            continue
                    else:
                        line, column = np.divmod(np.arange(far.size), far.shape[1])
                    value = pa.nulls(len(line), pa.float64()) if null else pa.array(far[line, column])
                    yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(query[line])), ids.take(pa.array(row[column])), value], names=schema.names)
            if best:
                yield from ranked(best.taken(best.most))
        if best:
            yield from ranked(best.taken())

    def ranked(taken):
        for line, ids, far in taken:
            asked_ids = pa.concat_arrays([p.value[0] for p in parts])
            yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(line)), ids, pa.array(far, mask=np.isnan(far))], names=schema.names)

    if listed:
        base = base.where(F.col("list").isin(sorted({x for part in parts for group in part.value[1] for x in group[-1]})))
    rows = dealt(base.select("id", "vec", *(["list"] if listed else [])), asked, *(["list", "id"] if listed else []))
    met = rows.crossJoin(F.broadcast(spark.range(len(parts)).select(F.col("id").alias("_part"))))
    return met.mapInArrow(lambda batches: together(found(batches)), schema)


def distance_lines(base: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    """query_id and line: a query's distances (nine digits) to all rows, in order of id. Rows are sorted over tasks, which make pieces of
    lines, and a line is put together from its pieces."""
    parts, _ = asked_in_parts(queries, np.int64 if metric in BITS else np.float64)
    dtype, spark = np.int64 if metric in BITS else np.float64, base.sparkSession
    schema = T.StructType([queries.schema["query_id"], T.StructField("first", base.schema["id"].dataType), T.StructField("n", T.LongType()), T.StructField("line", T.ArrayType(T.DoubleType()))])

    def pieces(batches):
        count = 0
        for rows in (batch.slice(i, SLICE) for batch in batches for i in range(0, batch.num_rows, SLICE)):
            known = [(n, at, np.ascontiguousarray(vectors.T)) for n, at, vectors in by_length(rows.column("vec"), dtype)]
            for part in parts:
                ids, groups = part.value
                for n, places, q, _, _ in groups:
                    for i in range(0, len(places), step := max(1, TILE // rows.num_rows)):
                        far, null = np.full((len(q[i : i + step]), rows.num_rows), float(metric == "cosine")), np.full(rows.num_rows, metric != "cosine")
                        for length, at, columns in known:
                            if length == n >= 0:
                                far[:, at], null[at] = D.rounded(D.exact(metric, q[i : i + step], columns)), False
                        lines = pa.ListArray.from_arrays(pa.array(np.arange(len(far) + 1, dtype=np.int32) * rows.num_rows), pa.array(far.ravel(), mask=np.tile(null, len(far)) if null.any() else None))
                        first = rows.column("id").take(pa.array(np.zeros(len(far), np.int64)))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(places[i : i + step])), first, pa.array(np.full(len(far), count)), lines], names=schema.names)
            count += 1

    n = 3 * spark.sparkContext.defaultParallelism
    made = base.select("id", "vec").repartitionByRange(n, "id").sortWithinPartitions("id").mapInArrow(pieces, schema).repartition("query_id")
    return made.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "n", "line"))), lambda e: e["line"])).alias("line"))


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """query_id, rank, id, distance of the k nearest."""
    return top(scored(base, queries, metric, k=k), k).select("query_id", "rank", "id", "distance")


def query_blocks(queries: DataFrame, dtype=np.float64) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, BLOCK (about) at a time."""
    parts = -(-queries.count() // BLOCK)
    cut = F.pmod(F.xxhash64("query_id"), F.lit(max(1, parts)))
    out = []
    for i in range(parts):
        rows = queries.where(cut == i).select("query_id", "q").collect()
        if rows:
            out.append((np.array([r["query_id"] for r in rows], np.int64), np.array([r["q"] for r in rows], dtype)))
    return out


def over_blocks(base: DataFrame, blocks: list, run: Callable, k: int) -> DataFrame:
    """The k best of what run(ids, block) yields from base's Arrow batches, for all blocks of queries."""
    schema = "query_id long, id long, distance double"
    found = [base.mapInArrow(run(ids, block), schema) for ids, block in blocks]
    empty = base.sparkSession.createDataFrame([], schema)
    return top(reduce(DataFrame.unionByName, found, empty) if len(found) != 1 else found[0], k).select("query_id", "rank", "id", "distance")


def least(far: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines and columns of the k least of each line, ties to the smaller id, however many rows tie. inf never counts."""
    mask = np.isfinite(far)
    if far.shape[1] > k > 0:
        mask &= far <= np.partition(far, k - 1, 1)[:, k - 1 : k]
    line, column = np.nonzero(mask)
    order = np.lexsort((ids[column], far[line, column], line))
    line, column = line[order], column[order]
    nth = np.arange(len(line)) - np.searchsorted(line, line)
    return line[nth < k], column[nth < k]


def knn_blocks(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The same by matrix products in Arrow batches: each batch yields its k best a query. Queries are collected, BLOCK
    at a time at most."""
    blocks = query_blocks(queries, np.int64 if metric in BITS else np.float64)
    return over_blocks(base.select("id", "vec"), blocks, lambda ids, block: _block_search(ids, block, k, metric), k)


def vectors_of(batch: pa.RecordBatch, column: str = "vec", dtype=np.float64) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(batch.num_rows, -1)


def block_nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line (query), column (row) and distance of the k nearest rows of each query, ties to the smaller id."""
    if metric == "l2":  # matrix products cancel: what may be among the k, within their error, is computed from differences
        sq = D.matrix_distance("l2_sq", queries, rows)
        error = 8 * (rows.shape[1] + 4) * np.finfo(float).eps * ((queries**2).sum(1)[:, None] + (rows**2).sum(1)[None])
        far, n = np.full(sq.shape, np.inf), min(k, sq.shape[1]) - 1
        limit = np.sqrt(np.partition(sq + error, n, 1)[:, n : n + 1]) + 1e-9
        line, column = np.nonzero(np.sqrt(np.maximum(sq - error, 0)) <= limit)
        for a in range(0, len(line), 1 << 16):
            i, j = line[a : a + (1 << 16)], column[a : a + (1 << 16)]
            far[i, j] = np.sqrt(D.folded_square(rows[j], queries[i]))
    else:
        far = D.matrix_distance(metric, queries, rows)
    far = D.rounded(far)
    line, column = least(far, ids, k)
    return line, column, far[line, column]


def _block_search(query_ids: np.ndarray, queries: np.ndarray, k: int, metric: str):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy()
                line, column, far = block_nearest(queries, vectors_of(batch, dtype=queries.dtype), ids, k, metric)
                yield pa.record_batch({"query_id": query_ids[line], "id": ids[column], "distance": far})

    return run


def range_search(base: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """L2: all with distance <= radius. IP and cosine: all with similarity >= radius."""
    limit = {"ip": -radius, "cosine": 1.0 - radius}.get(metric, radius)
    return scored(base, queries, metric, limit=limit + 1e-9 * (metric == "cosine"))


def limits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits of each query: what a running sum turns into the offsets of a packed result."""
    return queries.select("query_id").join(hits.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))


def rerank(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact distances of candidates (query_id, id), by joins on both keys, and the k nearest of them."""
    vectors = candidates.select("query_id", "id").distinct().join(base.select("id", "vec"), "id")
    scored = in_blocks(queries, lambda q: vectors.join(q, "query_id")).select("query_id", "id", rounded(D.distance(metric, "vec", "q")).alias("distance"))
    return top(scored, k).select("query_id", "rank", "id", "distance")


def page(hits: DataFrame, first: int, size: int) -> DataFrame:
    """Ranks first..first+size-1: one page of a search's iterator."""
    return hits.where(F.col("rank").between(first, first + size - 1))


def by_ids(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """Vectors in the order of the request (ord, id); unknown ids are absent."""
    return wanted.join(base, "id").select("ord", "id", "vec")


def distance_by_ids(base: DataFrame, wanted: DataFrame, metric: str = "l2") -> DataFrame:
    """Distances of requested pairs (a, b), by two equi-joins."""
    left = base.select(F.col("id").alias("a"), F.col("vec").alias("va"))
    right = base.select(F.col("id").alias("b"), F.col("vec").alias("vb"))
    return wanted.join(left, "a").join(right, "b").select("a", "b", rounded(D.distance(metric, "va", "vb")).alias("distance"))


def scan_is_better(rows: int, excluded: int, k: int) -> bool:
    """Whether a scan beats a graph walk: k is at least half of all rows, 93 % are excluded, or k is half of the rest."""
    return k >= 0.5 * rows or excluded >= 0.93 * rows or k >= 0.5 * (rows - excluded)
