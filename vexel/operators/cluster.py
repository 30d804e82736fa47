"""K-means and the inverted-file family.

Centroids are few (nlist) and broadcast; rows never move to be assigned. Inverted lists are rows with a list number, and
probing is an equi-join on it, which prunes partitions when the table is partitioned by list.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distances as D
from .search import BITS, TILE, block_nearest, rounded, scored, top, vectors_of

#: Rows that a model is fitted on, at most (about). Every row is then assigned and encoded.
SAMPLE = 50_000


def sampled(base: DataFrame, limit: int = SAMPLE, dtype=np.float64) -> np.ndarray:
    """At most about `limit` vectors, chosen by a hash of their id, in order of id."""
    share = min(1.0, limit / max(1, base.count()))
    rows = base.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.lit(share * 1_000_000)).select("id", "vec").collect()
    return np.array([r["vec"] for r in sorted(rows, key=lambda r: r["id"])], dtype)


def assign(base: DataFrame, centroids: DataFrame, metric: str = "l2", probes: int = 1) -> DataFrame:
    """id, vec, list and distance of the nearest `probes` centroids (list, c); ties go to the lower list. Centroids are
    collected, a row a list; rows stay where they lie."""
    known = sorted(centroids.select("list", "c").collect())
    lists, dtype = np.array([r["list"] for r in known], np.int32), np.int64 if metric in BITS else np.float64
    centres = np.array([r["c"] for r in known], dtype)
    schema = T.StructType([base.schema["id"], base.schema["vec"], T.StructField("list", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows and len(lists):
                line, column, far = block_nearest(vectors_of(batch, dtype=dtype), centres, lists, probes, metric)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(line)) for c in ("id", "vec")), pa.array(lists[column]), pa.array(far)], names=schema.names)

    return base.select("id", "vec").mapInArrow(run, schema)


def assign_blocks(base: DataFrame, centroids: np.ndarray, metric: str = "l2", column: str = "vec") -> DataFrame:
    """base with `list`, the number of the nearest centroid, by matrix products where the rows are: no shuffle."""
    schema = T.StructType([*base.schema.fields, T.StructField("list", T.IntegerType())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = vectors_of(batch, column, centroids.dtype)
                near = np.round(D.matrix_distance(metric, rows, centroids), 9).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int32())], names=[*batch.schema.names, "list"])

    return base.mapInArrow(run, schema)


def lloyd_step(assigned: DataFrame, digits: int = 9) -> DataFrame:
    """New centroids (list, c): the means of the rows of each list."""
    each = assigned.select("list", F.posexplode("vec").alias("i", "x"))
    means = each.groupBy("list", "i").agg(F.round(F.avg("x"), digits).alias("x"))
    return means.groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))


def plus_plus(rows: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Seeds: each next one is drawn with the squared distance to the nearest so far as its weight; of a few drawn, the
    one that leaves least distance is taken."""
    chosen = [rows[rng.integers(len(rows))]]
    far = ((rows - chosen[0]) ** 2).sum(1)
    tries = 2 + int(np.log(k))
    while len(chosen) < k:
        total = far.sum()
        drawn = rng.choice(len(rows), tries, p=far / total) if total > 0 else rng.integers(len(rows), size=1)
        left = np.minimum(far, D.matrix_distance("l2_sq", rows[drawn], rows))
        best = int(left.sum(1).argmin())
        chosen.append(rows[drawn[best]])
        far = left[best]
    return np.array(chosen)


def kmeans(rows: np.ndarray, k: int, seed: int = 42, rounds: int = 25, close: float = 1e-4, spherical: bool = False, batch: int | None = None, jitter: bool = True) -> np.ndarray:
    """Lloyd's rounds on a bounded sample; with `batch`, mini-batches instead. An empty list takes a member of the largest."""
    rng = np.random.default_rng(seed)
    if len(rows) <= k:
        return np.concatenate([rows, rows[rng.integers(len(rows), size=k - len(rows))]]) if len(rows) else rows
    centroids, seen = plus_plus(rows, k, rng), np.zeros(k)
    for _ in range(rounds if batch is None else 4 * rounds):
        part = rows if batch is None or batch >= len(rows) else rows[rng.choice(len(rows), batch, replace=False)]
        near = (-(part @ centroids.T) if spherical else D.matrix_distance("l2_sq", part, centroids)).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, part)
        if batch is None:
            new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        else:
            seen += n
            new = centroids + np.where(seen[:, None] > 0, (sums - n[:, None] * centroids) / np.maximum(seen, 1)[:, None], 0)
        for empty in np.flatnonzero(n == 0) if jitter and batch is None else ():
            new[empty] = part[rng.choice(np.flatnonzero(near == n.argmax()))] + rng.normal(0, 1e-4, part.shape[1])
        if spherical:
            new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        moved = np.abs(new - centroids).max()
        centroids = new
        if moved < close:
            break
    return centroids


def bit_kmeans(rows: np.ndarray, k: int, seed: int = 42) -> np.ndarray:
    """Centroids of bit vectors (64-bit words): the majority of each bit in the lists that kmeans finds."""
    if not len(rows):
        return rows
    bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little").astype(np.float64)
    return np.ascontiguousarray(np.packbits(kmeans(bits, k, seed) >= 0.5, axis=1, bitorder="little")).view(np.int64)


def as_table(spark, centroids: np.ndarray) -> DataFrame:
    kind, plain = ("long", int) if centroids.dtype.kind == "i" else ("double", float)
    return spark.createDataFrame([(i, [plain(x) for x in c]) for i, c in enumerate(centroids)], f"list int, c array<{kind}>")


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum(F.col("distance") * F.col("distance")).alias("inertia"))


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int, metric: str = "l2") -> DataFrame:
    """query_id, q, list: the lists that each query visits."""
    scored = queries.crossJoin(F.broadcast(centroids)).select("query_id", "q", "list", rounded(D.distance(metric, "q", "c")).alias("d"))
    window = Window.partitionBy("query_id").orderBy("d", "list")
    return scored.withColumn("n", F.row_number().over(window)).where(F.col("n") <= nprobe).select("query_id", "q", "list")


def visiting(centroids: DataFrame, metric: str, chosen) -> Callable[[np.ndarray], dict]:
    """For `scored`: of a matrix of queries, the lines that visit each list. Centroids are collected; chosen: of distances to them, in order
    of list, which (a mask) each line visits."""
    rows = sorted(centroids.collect(), key=lambda r: r["list"])
    lists = np.array([r["list"] for r in rows], np.int64)
    centres = np.array([r["c"] for r in rows], np.int64 if metric in BITS else np.float64)

    def visits(queries: np.ndarray) -> dict:
        if not len(lists) or queries.shape[1] != centres.shape[1]:
            return {}
        found = []
        for i in range(0, len(queries), step := max(1, TILE // len(lists))):
            line, column = np.nonzero(chosen(D.exact(metric, queries[i : i + step], np.ascontiguousarray(centres.T)), rows))
            found.append((line + i, column))
        line, column = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(column, kind="stable")
        line, column = line[order], column[order]
        cut = np.flatnonzero(np.diff(column)) + 1
        return {int(lists[c[0]]): part for part, c in zip(np.split(line, cut), np.split(column, cut)) if len(c)}

    return visits


def _nearest_lists(nprobe: int):
    def chosen(far: np.ndarray, rows: list) -> np.ndarray:
        mask = np.zeros(far.shape, bool)
        np.put_along_axis(mask, np.argsort(D.rounded(far), axis=1, kind="stable")[:, :nprobe], True, 1)
        return mask

    return chosen


def ivf_search(lists: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, metric: str = "l2") -> DataFrame:
    """The k nearest of the visited lists. lists: (list, id, vec, ...)."""
    visits = visiting(centroids, metric, _nearest_lists(nprobe))
    return top(scored(lists, queries, metric, k=k, visits=visits), k).select("query_id", "rank", "id", "distance")


def reach(lists: DataFrame, centroids: DataFrame, metric: str = "l2") -> DataFrame:
    """list, c and the distance of its farthest row: what says which lists a radius can't reach."""
    far = lists.join(F.broadcast(centroids), "list").groupBy("list").agg(F.max(D.distance(metric, "vec", "c")).alias("reach"))
    return centroids.join(far, "list")


def pruned_range(lists: DataFrame, queries: DataFrame, reaches: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """All rows within the radius, read only from lists that can hold some: a metric's triangle inequality says which."""
    visits = visiting(reaches, metric, lambda far, rows: far <= np.array([r["reach"] for r in rows]) + radius + 1e-6)
    return scored(lists, queries, metric, limit=radius, visits=visits)


def ivf_range_probed(lists: DataFrame, queries: DataFrame, centroids: DataFrame, radius: float, nprobe: int, metric: str = "l2") -> DataFrame:
    """All rows within the radius in the lists that each query visits."""
    return scored(lists, queries, metric, limit=radius, visits=visiting(centroids, metric, _nearest_lists(nprobe)))


def ivf_range(lists: DataFrame, queries: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """All rows of all lists within the radius; vec may be what codes give back."""
    return scored(lists, queries, metric, limit=radius)
