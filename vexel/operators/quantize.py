"""Quantizers. Models are fitted on a bounded sample; every row is encoded where it lies, and searched by its code.

A model has encode(rows) -> codes (uint8, a line a row) and decode(codes) -> rows. A search decodes a batch of codes and
takes distances to the queries by matrix products, so all models share one search, followed by an exact rerank.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distances as D
from .cluster import kmeans
from .search import in_blocks, least, over_blocks, query_blocks, rerank, top, vectors_of

# scalar quantization as columns: one range for all dimensions


def value_range(base: DataFrame) -> tuple[float, float]:
    row = base.agg(F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
    return row[0], row[1]


def sq_encode(vec: str, low: float, high: float, bits: int = 8) -> Column:
    """Codes 0..2^bits-1, halves rounded away from zero."""
    most = (1 << bits) - 1
    scale = most / (high - low) if high > low else 1.0
    return F.expr(f"transform({vec}, x -> CAST(floor(least(greatest((x - {low!r}D) * {scale!r}D, 0D), {most}D) + 0.5D) AS INT))")


def sq_decode(code: str, low: float, high: float, bits: int = 8) -> Column:
    scale = ((1 << bits) - 1) / (high - low) if high > low else 1.0
    return F.expr(f"transform({code}, c -> least(greatest(c / {scale!r}D + {low!r}D, {low!r}D), {high!r}D))")


def pack_nibbles(code: str) -> Column:
    """4-bit codes two to a byte, the first in the low half."""
    return F.expr(f"transform(sequence(0, (size({code}) - 1) div 2), i -> get({code}, 2 * i) + 16 * coalesce(get({code}, 2 * i + 1), 0))")


# product quantization as joins: codebook rows are (sub, code, c)


def subvectors(base: DataFrame, m: int) -> DataFrame:
    width = f"(size(vec) div {m})"
    return base.select("id", F.posexplode(F.expr(f"transform(sequence(0, {m - 1}), s -> slice(vec, s * {width} + 1, {width}))")).alias("sub", "sv"))


def pq_encode(base: DataFrame, codebook: DataFrame, m: int, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """Columns `keep` and codes: of each sub-vector the nearest entry, the lower one of equal ones. The codebook is collected;
    rows are encoded where they lie."""
    entries = sorted(codebook.select("sub", "code", "c").collect())
    numbers = [np.array([r["code"] for r in entries if r["sub"] == s], np.int32) for s in range(m)]
    books = [np.array([r["c"] for r in entries if r["sub"] == s], np.float64) for s in range(m)]
    schema = T.StructType([*(base.schema[c] for c in keep), T.StructField("codes", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in batches:
            if batch.num_rows and entries:
                parts = vectors_of(batch).reshape(batch.num_rows, m, -1)
                far = (np.round(((parts[:, s, None] - b[None]) ** 2).sum(2), 9) for s, b in enumerate(books))
                codes = np.stack([n[f.argmin(1)] for n, f in zip(numbers, far)], 1)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1, dtype=np.int32) * m), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), listed], names=schema.names)

    return base.select(*dict.fromkeys([*keep, "vec"])).mapInArrow(run, schema)


def pq_scores(codes: DataFrame, codebook: DataFrame, queries: DataFrame, m: int, visits: DataFrame | None = None) -> DataFrame:
    """query_id, id, distance: a table of (sub, code) distances for each query, looked up by every code, summed in order; with
    visits (query_id, list), only by the codes (list, ...) that a query visits."""
    size = (codebook.agg(F.max("code")).first()[0] or 0) + 1

    def run(part: DataFrame) -> DataFrame:
        lut = subvectors(part.select(F.col("query_id").alias("id"), F.col("q").alias("vec")), m).join(F.broadcast(codebook), "sub")
        lut = lut.groupBy(F.col("id").alias("query_id")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("sub") * size + F.col("code"), F.round(D.l2_sq("sv", "c"), 9)))).alias("of"))
        lut = lut.select("query_id", F.expr(f"transform(sequence(0, {m * size - 1}), i -> element_at(of, i))").alias("lut"))
        pairs = codes.crossJoin(F.broadcast(lut)) if visits is None else codes.join(F.broadcast(visits.join(lut, "query_id")), "list")
        return pairs.select("query_id", "id", F.round(F.sqrt(F.expr(f"aggregate(transform(codes, (c, s) -> get(lut, s * {size} + c)), 0D, (a, x) -> a + x)")), 9).alias("distance"))

    return in_blocks(queries, run)


def pq_search(codes: DataFrame, codebook: DataFrame, queries: DataFrame, k: int, m: int) -> DataFrame:
    return top(pq_scores(codes, codebook, queries, m), k).select("query_id", "rank", "id", "distance")


# models


@dataclass
class Scalar:
    low: float
    high: float
    bits: int = 8

    @classmethod
    def fit(cls, rows: np.ndarray, bits: int = 8) -> Scalar:
        return cls(float(rows.min()), float(rows.max()), bits)

    def encode(self, rows):
        most = (1 << self.bits) - 1
        scale = most / (self.high - self.low) if self.high > self.low else 1.0
        return np.floor(np.clip((rows - self.low) * scale, 0, most) + 0.5).astype(np.uint8)

    def decode(self, codes):
        scale = ((1 << self.bits) - 1) / (self.high - self.low) if self.high > self.low else 1.0
        return np.clip(codes / scale + self.low, self.low, self.high)


@dataclass
class Half:
    kind: str  # float16 or bfloat16

    def encode(self, rows):
        return np.ascontiguousarray(D.round_half(rows, self.kind)).view(np.uint8).reshape(len(rows), -1)

    def decode(self, codes):
        return np.ascontiguousarray(codes).view(np.float32).astype(np.float64)


@dataclass
class Product:
    """Sub-spaces, each with its own codebook (m, entries, width)."""

    books: np.ndarray

    @classmethod
    def fit(cls, rows: np.ndarray, m: int = 8, bits: int = 8, seed: int = 42) -> Product:
        rounds = 10 if len(rows) < 10_000 else 25 if len(rows) < 100_000 else 50
        parts = rows.reshape(len(rows), m, -1)
        return cls(np.array([kmeans(parts[:, s], min(1 << bits, max(1, len(rows))), seed + s, rounds) for s in range(m)]))

    def encode(self, rows):
        parts = rows.reshape(len(rows), len(self.books), -1)
        return np.stack([D.matrix_distance("l2_sq", parts[:, s], b).argmin(1) for s, b in enumerate(self.books)], 1).astype(np.uint8)

    def decode(self, codes):
        return np.concatenate([b[codes[:, s]] for s, b in enumerate(self.books)], 1)


@dataclass
class Weighted:
    """Product codes of rows whose dimensions are weighted by how much the queries use them (anisotropic coding)."""

    scale: np.ndarray
    inner: Product

    @classmethod
    def fit(cls, rows: np.ndarray, queries: np.ndarray | None = None, m: int = 8, bits: int = 8, seed: int = 42) -> Weighted:
        used = np.ones(rows.shape[1]) if queries is None or not len(queries) else (queries**2).mean(0)
        scale = np.sqrt(np.maximum(used / max(used.mean(), 1e-12), 1e-6))
        return cls(scale, Product.fit(rows * scale, m, bits, seed))

    def encode(self, rows):
        return self.inner.encode(rows * self.scale)

    def decode(self, codes):
        return self.inner.decode(codes) / self.scale


@dataclass
class Rotated:
    """Another model after a rotation (optimized product quantization): rows and queries are turned alike."""

    turn: np.ndarray
    inner: Product

    @classmethod
    def fit(cls, rows: np.ndarray, m: int = 8, bits: int = 8, rounds: int = 4, seed: int = 42) -> Rotated:
        turn = np.eye(rows.shape[1])
        for i in range(rounds):
            turned = rows @ turn
            inner = Product.fit(turned, m, bits, seed)
            if i < rounds - 1:
                u, _, vt = np.linalg.svd(rows.T @ inner.decode(inner.encode(turned)))
                turn = u @ vt
        return cls(turn, inner)

    def encode(self, rows):
        return self.inner.encode(rows @ self.turn)

    def decode(self, codes):
        return self.inner.decode(codes) @ self.turn.T


@dataclass
class Residual:
    """Stages, each quantizing what the ones before left over. stages: 1 + product = coarse list and residual codes."""

    stages: list

    @classmethod
    def fit(cls, rows: np.ndarray, stages: int = 4, bits: int = 8, seed: int = 42) -> Residual:
        return cls._fit(rows, [lambda r, i=i: Product.fit(r, 1, bits, seed + 100 * i) for i in range(stages)])

    @classmethod
    def fit_coarse(cls, rows: np.ndarray, nlist: int = 16, m: int = 8, bits: int = 8, seed: int = 42, optimized: bool = False) -> Residual:
        coarse = lambda r: Product(kmeans(r, min(nlist, len(r)), seed)[None])
        fine = (lambda r: Rotated.fit(r, m, bits, seed=seed)) if optimized else (lambda r: Product.fit(r, m, bits, seed))
        return cls._fit(rows, [coarse, fine])

    @classmethod
    def _fit(cls, rows, makers) -> Residual:
        out, left = [], rows
        for make in makers:
            out.append(make(left))
            left = left - out[-1].decode(out[-1].encode(left))
        return cls(out)

    def encode(self, rows):
        codes, left = [], rows
        for stage in self.stages:
            codes.append(stage.encode(left))
            left = left - stage.decode(codes[-1])
        return np.concatenate(codes, 1)

    def decode(self, codes):
        at, total = 0, 0.0
        for stage in self.stages:
            width = len(getattr(stage, "inner", stage).books)
            total = total + stage.decode(codes[:, at : at + width])
            at += width
        return total


@dataclass
class Split:
    """Product of residual quantizers: each part of the dimensions has its own stages."""

    parts: list[Residual]

    @classmethod
    def fit(cls, rows: np.ndarray, splits: int = 4, stages: int = 2, bits: int = 8, seed: int = 42) -> Split:
        return cls([Residual.fit(p, stages, bits, seed + i) for i, p in enumerate(np.split(rows, splits, 1))])

    def encode(self, rows):
        return np.concatenate([q.encode(p) for q, p in zip(self.parts, np.split(rows, len(self.parts), 1))], 1)

    def decode(self, codes):
        return np.concatenate([q.decode(c) for q, c in zip(self.parts, np.split(codes, len(self.parts), 1))], 1)


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix with a fixed seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _floats(codes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(codes).view(np.float32).astype(np.float64)


@dataclass
class Uniform:
    """Centred, rotated and normalised rows on a uniform grid of `bits` (1, 2, 4, 8) a value, with norm and a quality
    factor (the code's product with the row it stands for) beside the code."""

    mean: np.ndarray
    turn: np.ndarray
    bits: int = 4

    @classmethod
    def fit(cls, rows: np.ndarray, bits: int = 4, seed: int = 42) -> Uniform:
        return cls(rows.mean(0), rotation(rows.shape[1], seed), bits)

    def _grid(self, unit):
        top_code = (1 << self.bits) - 1
        reach = np.maximum(np.abs(unit).max(1, keepdims=True), 1e-12) if self.bits > 1 else np.full((len(unit), 1), 1.0)
        return np.clip(np.floor((unit / reach + 1) * (top_code + 1) / 2), 0, top_code).astype(np.uint8)

    def _level(self, codes):
        return (codes + 0.5) * 2 / (1 << self.bits) - 1

    def encode(self, rows):
        turned = (rows - self.mean) @ self.turn
        norm = np.linalg.norm(turned, axis=1, keepdims=True)
        unit = turned / np.maximum(norm, 1e-12)
        codes = self._grid(unit)
        level = self._level(codes)
        quality = (unit * level).sum(1, keepdims=True) / np.maximum((level**2).sum(1, keepdims=True), 1e-12)
        return np.concatenate([codes, np.concatenate([norm, quality], 1).astype(np.float32).view(np.uint8)], 1)

    def decode(self, codes):
        side = _floats(codes[:, -8:])
        return (self._level(codes[:, :-8]) * side[:, 1:] * side[:, :1]) @ self.turn.T + self.mean


@dataclass
class Affine:
    """Centred and rotated rows with a scale and an offset each (hierarchical vector quantization), refined by least squares."""

    mean: np.ndarray
    turn: np.ndarray
    bits: int = 4
    rounds: int = 3

    @classmethod
    def fit(cls, rows: np.ndarray, bits: int = 4, seed: int = 42) -> Affine:
        return cls(rows.mean(0), rotation(rows.shape[1], seed), bits)

    def encode(self, rows):
        x, most = (rows - self.mean) @ self.turn, (1 << self.bits) - 1
        low = x.min(1, keepdims=True)
        scale = np.maximum((x.max(1, keepdims=True) - low) / most, 1e-12)
        for _ in range(self.rounds):
            codes = np.clip(np.floor((x - low) / scale + 0.5), 0, most)
            mean_c, mean_x = codes.mean(1, keepdims=True), x.mean(1, keepdims=True)
            spread = ((codes - mean_c) ** 2).sum(1, keepdims=True)
            scale = np.where(spread > 0, ((codes - mean_c) * (x - mean_x)).sum(1, keepdims=True) / np.maximum(spread, 1e-12), scale)
            scale = np.maximum(scale, 1e-12)
            low = mean_x - scale * mean_c
        codes = np.clip(np.floor((x - low) / scale + 0.5), 0, most).astype(np.uint8)
        return np.concatenate([codes, np.concatenate([scale, low], 1).astype(np.float32).view(np.uint8)], 1)

    def decode(self, codes):
        side = _floats(codes[:, -8:])
        return (codes[:, :-8] * side[:, :1] + side[:, 1:]) @ self.turn.T + self.mean


def gaussian_levels(bits: int, rounds: int = 200) -> np.ndarray:
    """Lloyd-Max levels of a standard normal variable, on a fine grid of it."""
    x = np.linspace(-6, 6, 20_001)
    weight = np.exp(-(x**2) / 2)
    levels = np.quantile(np.repeat(x, np.maximum(1, weight * 50).astype(int)), (np.arange(1 << bits) + 0.5) / (1 << bits))
    for _ in range(rounds):
        near = np.searchsorted((levels[1:] + levels[:-1]) / 2, x)
        total = np.bincount(near, weight, 1 << bits)
        levels = np.where(total > 0, np.bincount(near, weight * x, 1 << bits) / np.maximum(total, 1e-300), levels)
    return levels


@dataclass
class Turbo:
    """Rotated rows, whose values are nearly normal, on the best levels for that. With `signs`, one bit less and the
    signs of random projections of the residual, which make products unbiased."""

    turn: np.ndarray
    levels: np.ndarray
    sketch: np.ndarray | None = None

    @classmethod
    def fit(cls, rows: np.ndarray, bits: int = 4, signs: bool = False, seed: int = 42) -> Turbo:
        dim = rows.shape[1]
        return cls(rotation(dim, seed), gaussian_levels(bits - signs) / np.sqrt(dim), np.random.default_rng(seed + 1).normal(size=(dim, dim)) if signs else None)

    def encode(self, rows):
        norm = np.linalg.norm(rows, axis=1, keepdims=True)
        x = rows / np.maximum(norm, 1e-12) @ self.turn
        codes = np.searchsorted((self.levels[1:] + self.levels[:-1]) / 2, x).astype(np.uint8)
        side = [norm]
        if self.sketch is not None:
            left = x - self.levels[codes]
            side.append(np.linalg.norm(left, axis=1, keepdims=True))
            codes = np.concatenate([codes, (left @ self.sketch.T >= 0).astype(np.uint8)], 1)
        return np.concatenate([codes, np.concatenate(side, 1).astype(np.float32).view(np.uint8)], 1)

    def decode(self, codes):
        dim = len(self.turn)
        if self.sketch is None:
            return self.levels[codes[:, :dim]] @ self.turn.T * _floats(codes[:, dim:])
        side = _floats(codes[:, 2 * dim :])
        signs = codes[:, dim : 2 * dim] * 2.0 - 1
        left = np.sqrt(np.pi / 2) / dim * side[:, 1:] * (signs @ self.sketch)
        return (self.levels[codes[:, :dim]] + left) @ self.turn.T * side[:, :1]


@dataclass
class Principal:
    """Projection of centred rows on the first directions of a sample; `inner` may quantize what it gives."""

    mean: np.ndarray
    axes: np.ndarray
    inner: object = None

    @classmethod
    def fit(cls, rows: np.ndarray, dim: int, inner=None) -> Principal:
        mean = rows.mean(0)
        _, _, vt = np.linalg.svd(rows - mean, full_matrices=False)
        model = cls(mean, vt[:dim])
        if inner is not None:
            model.inner = inner(model.project(rows))
        return model

    def project(self, rows):
        return (rows - self.mean) @ self.axes.T

    def encode(self, rows):
        low = self.project(rows)
        return self.inner.encode(low) if self.inner is not None else np.ascontiguousarray(low.astype(np.float32)).view(np.uint8).reshape(len(rows), -1)

    def decode(self, codes):
        low = self.inner.decode(codes) if self.inner is not None else _floats(codes)
        return low @ self.axes + self.mean


def fit_pair(rows: np.ndarray, queries: np.ndarray, dim: int) -> tuple[Principal, Principal]:
    """Projections of rows and of queries, each fitted on its own side."""
    return Principal.fit(rows, dim), Principal.fit(queries, dim)


def encoded(base: DataFrame, model, keep: tuple[str, ...] = ("id",), centroids: np.ndarray | None = None) -> DataFrame:
    """base's columns `keep` and `code` (binary), encoded in Arrow batches; with centroids, of what the row's list leaves
    over (base has `list` then)."""
    read = [*dict.fromkeys([*keep, "vec", *(["list"] if centroids is not None else [])])]
    dim = None if centroids is None else centroids.shape[1]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                left = rows if dim is None else rows - centroids[batch.column("list").to_numpy()]
                codes = np.ascontiguousarray(model.encode(left))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([c.tobytes() for c in codes], pa.binary())], names=[*keep, "code"])

    schema = T.StructType([*(base.schema[c] for c in keep), T.StructField("code", T.BinaryType())])
    return base.select(*read).mapInArrow(run, schema)


def decoded(codes: DataFrame, model) -> DataFrame:
    """codes (…, code) with vec, what the code gives back, in place of it."""
    keep = [c for c in codes.columns if c != "code"]

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                back = np.ascontiguousarray(model.decode(codes_of(batch)), np.float64)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(back) + 1, dtype=np.int32) * back.shape[1]), pa.array(back.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), vec], names=[*keep, "vec"])

    schema = T.StructType([*(codes.schema[c] for c in keep), T.StructField("vec", T.ArrayType(T.DoubleType()))])
    return codes.select(*keep, "code").mapInArrow(run, schema)


def codes_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def code_search(codes: DataFrame, queries: DataFrame, model, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest by what the codes decode to. Queries are collected, a block at a time."""

    def search(ids, block):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    far = np.round(D.matrix_distance(metric, block, model.decode(codes_of(batch))), 9) + 0.0
                    number = batch.column("id").to_numpy()
                    line, column = least(far, number, k)
                    yield pa.record_batch({"query_id": ids[line], "id": number[column], "distance": far[line, column]})

        return run

    return over_blocks(codes.select("id", "code"), query_blocks(queries), search, k)


def two_stage(base: DataFrame, queries: DataFrame, model, k: int, factor: int = 4, metric: str = "l2") -> DataFrame:
    """Coarse search of codes for factor * k candidates a query, then the exact rerank."""
    return rerank(code_search(encoded(base, model), queries, model, factor * k, metric), base, queries, k, metric)


def visits_of(block: np.ndarray, centroids: np.ndarray, nprobe: int, metric: str) -> np.ndarray:
    """Which lists (columns) each query (line) visits: its nprobe nearest centroids, the lower of equal ones."""
    order = np.argsort(np.round(D.matrix_distance(metric, block, centroids), 9), axis=1, kind="stable")[:, :nprobe]
    visits = np.zeros((len(block), len(centroids)), bool)
    np.put_along_axis(visits, order, True, 1)
    return visits


def ivf_code_search(codes: DataFrame, queries: DataFrame, centroids: np.ndarray, model, k: int, nprobe: int, metric: str = "l2", residual: bool = False) -> DataFrame:
    """Like code_search, in the lists that each query visits. codes: (list, id, code); lists nobody visits aren't read.
    residual: codes are of what the list's centroid leaves over."""
    blocks = query_blocks(queries)
    visited = np.zeros(len(centroids), bool)
    for _, block in blocks:
        visited |= visits_of(block, centroids, nprobe, metric).any(0)

    def search(ids, block):
        visits = visits_of(block, centroids, nprobe, metric)

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    lists, number = batch.column("list").to_numpy(), batch.column("id").to_numpy()
                    rows = model.decode(codes_of(batch)) + (centroids[lists] if residual else 0.0)
                    far = np.round(D.matrix_distance(metric, block, rows), 9) + 0.0
                    far[~visits[:, lists]] = np.inf
                    line, column = least(far, number, k)
                    yield pa.record_batch({"query_id": ids[line], "id": number[column], "distance": far[line, column]})

        return run

    read = codes.where(F.col("list").isin([int(x) for x in np.flatnonzero(visited)])).select("list", "id", "code")
    return over_blocks(read, blocks, search, k)


# models as text, so that an index can be stored: class names and fields, arrays as base64

MODELS = {c.__name__: c for c in (Scalar, Half, Product, Weighted, Rotated, Residual, Split, Uniform, Affine, Turbo, Principal)}


def as_json(model):
    if isinstance(model, np.ndarray):
        return {"dtype": model.dtype.str, "shape": model.shape, "bytes": base64.b64encode(np.ascontiguousarray(model).tobytes()).decode()}
    if isinstance(model, list):
        return [as_json(x) for x in model]
    if type(model).__name__ in MODELS:
        return {"model": type(model).__name__, "fields": {f.name: as_json(getattr(model, f.name)) for f in fields(model)}}
    return model


def from_json(told):
    if isinstance(told, list):
        return [from_json(x) for x in told]
    if isinstance(told, dict) and "model" in told:
        return MODELS[told["model"]](**{k: from_json(v) for k, v in told["fields"].items()})
    if isinstance(told, dict):
        return np.frombuffer(base64.b64decode(told["bytes"]), np.dtype(told["dtype"])).reshape(told["shape"])
    return told
