"""The index a user holds: train, add, search, range search, save, load; and a registry of named ones."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distances as D
from .operators import cluster, graph, lsh, multivector, quantize, search, sparse
from .sources import store
from .types import DType, IndexConfig, Metric, adaptive_ef


class NotTrained(RuntimeError):
    """A search or an addition before training."""


_IVF = {"ivf_flat", "ivf_flat_cc", "ivf_sq8", "ivf_sq_cc", "ivf_pq", "ivf_usq", "ivf_turboquant"}
#: Kinds whose codes are of what a list's centroid leaves over.
_RESIDUAL = {"ivf_sq8", "ivf_sq_cc", "ivf_pq"}
_SCANNED = {"hnsw_sq", "hnsw_pq", "hnsw_prq", "scann"}
_GRAPH = {"hnsw", "diskann", "aisaq", "rhtsdg", "bin_hnsw"}
_FLAT = {"flat", "bin_flat"}


def _model(config: IndexConfig, rows):
    """The quantizer of a kind, fitted on a sample; None for kinds that keep vectors."""
    kind = config.kind
    if kind in ("ivf_sq8", "ivf_sq_cc", "hnsw_sq"):
        return quantize.Scalar.fit(rows)
    if kind in ("ivf_pq", "hnsw_pq", "scann"):
        return quantize.Product.fit(rows, config.m, config.nbits, config.seed)
    if kind == "hnsw_prq":
        return quantize.Split.fit(rows, 4, 2, config.nbits, config.seed)
    if kind == "ivf_usq":
        return quantize.Uniform.fit(rows, config.extra.get("bits", 4), config.seed)
    return quantize.Turbo.fit(rows, config.extra.get("bits", 4), seed=config.seed) if kind == "ivf_turboquant" else None


class VectorIndex:
    """Vectors (id, vec, any scalars) under one kind of index. Searches are lazy; training is a job on a bounded sample.

    Rows get their list and code when they are added, and are stored with them, as are centroids, model and graphs, so a
    loaded index is the one that was saved. Graphs are built when they are first needed after an addition. Every
    approximate kind reranks its candidates exactly. Filters hold below the ranking, or, in a graph, where its walk ends.
    """

    def __init__(self, spark: SparkSession, config: IndexConfig):
        self.spark, self.config = spark, config
        self.binary = config.kind.startswith("bin") or config.metric.value in search.BITS
        self.rows: DataFrame | None = None
        self.deleted: DataFrame | None = None
        self.graphs: DataFrame | None = None
        self.centroids, self.model, self.trained = None, None, config.kind in _FLAT

    def train(self, base: DataFrame) -> VectorIndex:
        kind, metric = self.config.kind, self.config.metric.value
        if kind not in _FLAT:
            rows = cluster.sampled(base.select("id", "vec"), dtype=np.int64 if self.binary else np.float64)
            cells = self.config.nlist if kind in _IVF or kind == "bin_ivf_flat" else graph.cells_for(base.count())
            cells = max(1, min(cells, len(rows)))
            self.centroids = cluster.bit_kmeans(rows, cells, self.config.seed) if self.binary else cluster.kmeans(rows, cells, self.config.seed, spherical=metric != "l2")
            if len(rows):
                near = D.matrix_distance(metric, rows, self.centroids).argmin(1)
                self.model = _model(self.config, rows - self.centroids[near] if kind in _RESIDUAL else rows)
        self.trained = True
        return self

    def add(self, base: DataFrame) -> VectorIndex:
        if not self.trained:
            raise NotTrained(self.config.kind)
        vec = F.col("vec") if self.binary else F.transform("vec", lambda x: x.cast("double")).alias("vec")
        base = base.select("id", vec, *[c for c in base.columns if c not in ("id", "vec")])
        if self.centroids is not None:
            base = cluster.assign_blocks(base, self.centroids, self.config.metric.value)
        if self.model is not None:
            base = quantize.encoded(base, self.model, tuple(base.columns), self._centres())
        self.rows, self.graphs = base if self.rows is None else self.rows.unionByName(base), None
        return self

    def _centres(self):
        return self.centroids if self.config.kind in _RESIDUAL else None

    def remove(self, ids: DataFrame) -> VectorIndex:
        ids = ids.select("id")
        self.deleted = ids if self.deleted is None else self.deleted.union(ids)
        return self

    def reset(self) -> None:
        self.rows = self.deleted = self.graphs = None

    def has_id(self, ids: DataFrame) -> DataFrame:
        """ids with `found`: whether the index has them."""
        there = self._live().select("id").distinct().withColumn("found", F.lit(True))
        return ids.select("id").join(there, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("found"))

    def reconstruct(self, wanted: DataFrame) -> DataFrame:
        """ord, id and vec of requested rows (ord, id) as their codes give them back, or as they are where there are none."""
        rows = wanted.join(self._live(), "id")
        if self.model is None:
            return rows.select("ord", "id", "vec")
        model, centres = self.model, self._centres()

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    back = model.decode(quantize.codes_of(batch)) + (centres[batch.column("list").to_numpy()] if centres is not None else 0.0)
                    yield pa.RecordBatch.from_arrays([batch.column("ord"), batch.column("id"), pa.array([list(map(float, x)) for x in back], pa.list_(pa.float64()))], names=["ord", "id", "vec"])

        return rows.select(F.col("ord").cast("long").alias("ord"), "id", "list", "code").mapInArrow(run, "ord long, id long, vec array<double>")

    def _live(self, excluded=None, allowed=None, where: Column | None = None) -> DataFrame:
        if self.rows is None:
            raise NotTrained("nothing was added")
        return search.excluding(search.excluding(self.rows, self.deleted), excluded, allowed, where)

    def _graphs(self) -> DataFrame:
        if self.graphs is None:
            self.graphs = graph.build(self.rows.select("list", "id", "vec"), self.config.degree, self.config.metric.value).persist()
        return self.graphs

    @property
    def count(self) -> int:
        return 0 if self.rows is None else self._live().count()

    def search(self, queries: DataFrame, k: int, nprobe: int | None = None, excluded: DataFrame | None = None, allowed: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """query_id, rank, id, distance. queries: (query_id, q)."""
        rows, metric, kind = self._live(excluded, allowed, where), self.config.metric.value, self.config.kind
        nprobe = min(nprobe or self.config.nprobe, len(self.centroids)) if self.centroids is not None else 0
        if kind in _FLAT:
            return search.knn_blocks(rows, queries, k, metric)
        if kind in _GRAPH:
            filtered = any(x is not None for x in (self.deleted, excluded, allowed, where))
            if filtered:
                total, left = self.rows.count(), rows.count()
                if search.scan_is_better(total, total - left, k):
                    return search.knn_blocks(rows, queries, k, metric)
            return graph.walk(self._graphs(), queries, k, adaptive_ef(self.config.ef, k), metric, self.centroids, nprobe, rows if filtered else None)
        if self.model is None:
            return cluster.ivf_search(rows.select("list", "id", "vec"), queries, cluster.as_table(self.spark, self.centroids), k, nprobe, metric)
        pool = self.config.rerank * k
        if kind in _SCANNED:
            found = quantize.code_search(rows.select("id", "code"), queries, self.model, pool, metric)
        else:
            found = quantize.ivf_code_search(rows.select("list", "id", "code"), queries, self.centroids, self.model, pool, nprobe, metric, kind in _RESIDUAL)
        return search.rerank(found, rows, queries, k, metric)

    def range_search(self, queries: DataFrame, radius: float, **filters) -> DataFrame:
        """All hits. Where lists are cells of a metric space, only those that the radius reaches are read."""
        rows, metric = self._live(**filters), self.config.metric.value
        if self.centroids is None or metric not in ("l2", "hamming"):
            return search.range_search(rows, queries, radius, metric)
        reaches = cluster.reach(self.rows, cluster.as_table(self.spark, self.centroids), metric)
        return cluster.pruned_range(rows.select("list", "id", "vec"), queries, reaches, radius, metric)

    def iterate(self, queries: DataFrame, first: int, size: int, **filters) -> DataFrame:
        """One page of a search's ranks."""
        return search.page(self.search(queries, first + size - 1, **filters), first, size)

    def get(self, wanted: DataFrame) -> DataFrame:
        return search.by_ids(self._live(), wanted)

    def save(self, path: str) -> None:
        """Rows with lists and codes, deleted ids, graphs, centroids and model."""
        parts = {"vectors": self.rows if self.rows is not None else self.spark.createDataFrame([], "id long, vec array<double>")}
        if self.deleted is not None:
            parts["deleted"] = self.deleted.distinct()
        if self.config.kind in _GRAPH and self.rows is not None:
            parts["graphs"] = self._graphs()
        told = {"centroids": self.centroids, "model": self.model}
        store.save(path, self.config, parts, {k: quantize.as_json(v) for k, v in told.items() if v is not None} | {"trained": self.trained})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        config, parts, told = store.load(spark, path)
        index = cls(spark, config)
        index.centroids, index.model = (quantize.from_json(told.get(k)) for k in ("centroids", "model"))
        index.rows, index.deleted, index.graphs, index.trained = parts["vectors"], parts.get("deleted"), parts.get("graphs"), told["trained"]
        return index


class SparseIndex:
    """Postings (id, term, w) under inner product, cosine or one of two BM25 dialects."""

    def __init__(self, postings: DataFrame | None = None, metric: str = "ip", drop_ratio: float = 0.0):
        if metric not in ("ip", "cosine", "bm25", "bm25_fixed"):
            raise ValueError(metric)
        self.postings, self.metric, self.drop_ratio = postings, metric, drop_ratio

    def add(self, postings: DataFrame) -> SparseIndex:
        self.postings = postings if self.postings is None else self.postings.unionByName(postings)
        return self

    def save(self, path: str) -> None:
        self.postings.write.mode("overwrite").parquet(f"{path}/postings")

    def search(self, queries: DataFrame, k: int, excluded: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """query_id, rank, id, score. queries: (query_id, term, qw). Only positive scores; statistics are of all rows."""
        kept = queries if not self.drop_ratio else sparse.drop_terms(queries, self.drop_ratio)
        if self.metric in ("bm25", "bm25_fixed") and excluded is None and allowed is None:
            return (sparse.bm25_search if self.metric == "bm25" else sparse.bm25_fixed)(self.postings, kept, k)
        if self.metric in ("bm25", "bm25_fixed"):
            every = (sparse.bm25_search if self.metric == "bm25" else sparse.bm25_fixed)(self.postings, kept, 2**31 - 1)
            scored = search.excluding(every, excluded, allowed).drop("rank")
            return sparse.best(scored, k)
        rows = search.excluding(self.postings, excluded, allowed)
        return sparse.cosine_search(rows, kept, k) if self.metric == "cosine" else sparse.best(sparse.dot(rows, kept), k)

    def get(self, ids: DataFrame) -> DataFrame:
        return self.postings.join(ids.select("id").distinct(), "id", "left_semi")


class MinHashIndex:
    """Sets of items as signatures, found by equal bands and ranked by signature distance."""

    def __init__(self, items: DataFrame | None = None, size: int = 16, rows: int = 4):
        self.size, self.rows = size, rows
        self.sigs = None if items is None else lsh.signatures(items, size)

    def add(self, items: DataFrame) -> MinHashIndex:
        """items: (id, item) of sets that aren't there yet."""
        sigs = lsh.signatures(items, self.size)
        self.sigs = sigs if self.sigs is None else self.sigs.unionByName(sigs)
        return self

    @property
    def count(self) -> int:
        return 0 if self.sigs is None else self.sigs.count()

    def get(self, ids: DataFrame) -> DataFrame:
        """id and sig of the requested ids that there are."""
        return self.sigs.join(ids.select("id").distinct(), "id", "left_semi")

    def save(self, path: str) -> None:
        """Signatures in a folder that tells their size and the rows of a band."""
        self.sigs.write.mode("overwrite").parquet(f"{path}/size={self.size}/rows={self.rows}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> MinHashIndex:
        stored = spark.read.parquet(path)
        told = stored.select("size", "rows").first()
        index = cls(size=told["size"], rows=told["rows"])
        index.sigs = stored.select("id", "sig")
        return index

    def search(self, items: DataFrame, k: int) -> DataFrame:
        """items: (id, item) of the queries; their id becomes query_id."""
        asked = lsh.signatures(items, self.size)
        found = lsh.candidates(lsh.bands(self.sigs, self.rows), lsh.bands(asked, self.rows))
        return lsh.jaccard_search(found, self.sigs, asked, k)


class MultiVectorIndex:
    """Documents of several vectors (id, vec: one row a vector), scored by late interaction."""

    def __init__(self, tokens: DataFrame, metric: str = "ip"):
        self.tokens, self.metric = tokens, metric

    def search(self, queries: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
        return multivector.search(search.excluding(self.tokens, excluded), queries, k, self.metric)

    def by_ids(self, queries: DataFrame, wanted: DataFrame) -> DataFrame:
        return multivector.by_ids(self.tokens, queries, wanted, self.metric)


class Registry:
    """Named indexes, of vectors, postings or sets as their kind says."""

    def __init__(self, spark: SparkSession):
        self.spark, self.indexes = spark, {}

    def create(self, name: str, config: IndexConfig) -> VectorIndex:
        if name in self.indexes:
            raise ValueError(f"index {name!r} exists")
        if config.kind.startswith("sparse"):
            self.indexes[name] = SparseIndex(metric=config.extra.get("metric", "ip"), drop_ratio=config.extra.get("drop_ratio", 0.0))
        elif config.kind == "minhash_lsh":
            self.indexes[name] = MinHashIndex(size=config.extra.get("size", 16), rows=config.extra.get("rows", 4))
        else:
            self.indexes[name] = VectorIndex(self.spark, config)
        return self.indexes[name]

    def get(self, name: str):
        return self.indexes[name]

    def drop(self, name: str) -> None:
        del self.indexes[name]

    def names(self) -> list[str]:
        return sorted(self.indexes)


def index(spark: SparkSession, kind: str, dim: int, metric: str = "l2", **options) -> VectorIndex:
    metric = Metric.parse(metric)
    dtype = DType.BINARY if metric.value in search.BITS else DType.FLOAT
    return VectorIndex(spark, replace(IndexConfig(kind, dim, metric, options.pop("dtype", dtype)), **options))
