"""Queries over clustered, quantized and binary vectors.

Models that SQL can express are defined by rows: centroids are the rows whose id is a multiple of 50 below 3200 (64 at
most), codebooks the sub-vectors of rows whose id is a multiple of 31 (16 of them). All rows are assigned and encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import distances as D
from ..operators import cluster, quantize, search
from .inputs import L2_SQ, PAIRS, Q, V, fold, queries, ranked, rounded, sql_distance, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K, NPROBE, M, POOL = 10, 8, 32, 160
W = 64 // M


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def centroids(base: DataFrame) -> DataFrame:
    return base.where("id % 50 = 0 AND id < 3200").select(F.expr("CAST(id div 50 AS INT)").alias("list"), F.col("vec").alias("c"))


C = "c AS (SELECT CAST(id // 50 AS INT) AS list, vec AS c FROM v WHERE id % 50 = 0 AND id < 3200)"
A = f"a AS (SELECT id, vec, list, distance FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, list) AS r FROM (SELECT id, vec, list, {rounded(sql_distance('l2', 'vec', 'c'))} AS distance FROM v CROSS JOIN c)) WHERE r = 1)"
PROBE = f"b AS (SELECT query_id, q, list FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, list) AS r FROM (SELECT query_id, q, list, {rounded(sql_distance('l2', 'q', 'c'))} AS d FROM q CROSS JOIN c)) WHERE r <= {NPROBE})"
IVF = f"WITH {V}, {Q}, {C}, {A}, {PROBE}"


@query("kmeans_assign", f"WITH {V}, {C}, {A} SELECT id, list, distance FROM a")
def kmeans_assign(spark, sf):
    base = vectors(spark, sf)
    return cluster.assign(base, centroids(base)).select("id", "list", "distance")


@query("kmeans_step", f"WITH {V}, {C}, {A}, e AS (SELECT list, generate_subscripts(vec, 1) AS i, unnest(vec) AS x FROM a), m AS (SELECT list, i, round(avg(x), 6) + 0.0 AS x FROM e GROUP BY ALL) SELECT list, list(x ORDER BY i) AS c FROM m GROUP BY list")
def kmeans_step(spark, sf):
    base = vectors(spark, sf)
    return cluster.lloyd_step(cluster.assign(base, centroids(base)), 6).withColumn("c", F.transform("c", lambda x: x + 0.0))


def _fitted(**options):
    def run(spark, sf):
        base = vectors(spark, sf)
        model = cluster.kmeans(cluster.sampled(base.select("id", "vec")), 16, **options)
        return cluster.assign_blocks(base.select("id", "vec"), model).groupBy("list").agg(F.count("*").alias("n"))

    return run


QUERIES |= {"kmeans_lloyd": _fitted(close=1e-2), "kmeans_fast": _fitted(rounds=5, close=1e-3), "kmeans_pp": _fitted(jitter=False), "kmeans_full_scan": _fitted(), "kmeans_spherical": _fitted(spherical=True), "kmeans_mini_batch": _fitted(batch=1024)}


@query("ivf_flat_knn", f"{IVF}, s AS (SELECT query_id, id, {rounded(sql_distance('l2', 'vec', 'q'))} AS distance FROM a JOIN b USING (list)) {ranked('s', K)}")
def ivf_flat_knn(spark, sf):
    base = vectors(spark, sf)
    return cluster.ivf_search(cluster.assign(base, centroids(base)).drop("distance"), queries(base), centroids(base), K, NPROBE)


@query("ivf_flat_filtered", f"{IVF}, s AS (SELECT query_id, id, {rounded(sql_distance('l2', 'vec', 'q'))} AS distance FROM a JOIN b USING (list) WHERE id % 3 <> 0) {ranked('s', K)}")
def ivf_flat_filtered(spark, sf):
    base = vectors(spark, sf)
    lists = cluster.assign(search.excluding(base, base.where("id % 3 = 0")), centroids(base)).drop("distance")
    return cluster.ivf_search(lists, queries(base), centroids(base), K, NPROBE)


# scalar quantization

_RANGE = "g AS (SELECT min(list_min(vec)) AS lo, max(list_max(vec)) AS hi FROM {src})"


def _codes(bits: int, vec: str = "vec") -> str:
    most = (1 << bits) - 1
    return f"list_transform({vec}, lambda x: CAST(floor(least(greatest((x - lo) * ({most} / (hi - lo)), 0), {most}) + 0.5) AS INT))"


def _decoded(bits: int, code: str) -> str:
    return f"list_transform({code}, lambda c: least(greatest(c / ({(1 << bits) - 1} / (hi - lo)) + lo, lo), hi))"


@query("sq8_encode", f"WITH {V}, {_RANGE.format(src='v')} SELECT id, array_to_string({_codes(8)}, ',') AS code FROM v, g")
def sq8_encode(spark, sf):
    base = vectors(spark, sf)
    return base.select("id", F.array_join(quantize.sq_encode("vec", *quantize.value_range(base)), ",").alias("code"))


@query("sq4_encode", f"WITH {V}, {_RANGE.format(src='v')}, e AS (SELECT id, {_codes(4)} AS code FROM v, g) SELECT id, array_to_string(list_transform(range(0, 32), lambda i: code[2 * i + 1] + 16 * code[2 * i + 2]), ',') AS code FROM e")
def sq4_encode(spark, sf):
    base = vectors(spark, sf)
    coded = base.select("id", quantize.sq_encode("vec", *quantize.value_range(base), bits=4).alias("code"))
    return coded.select("id", F.array_join(quantize.pack_nibbles("code"), ",").alias("code"))


_SQ8 = f"{_RANGE.format(src='v')}, e AS (SELECT id, vec, {_codes(8)} AS code, lo, hi FROM v, g), x AS (SELECT id, vec, {_decoded(8, 'code')} AS dec FROM e)"


def _sq8(base: DataFrame) -> DataFrame:
    low, high = quantize.value_range(base)
    coded = base.withColumn("code", quantize.sq_encode("vec", low, high))
    return coded.withColumn("dec", quantize.sq_decode("code", low, high))


@query("sq8_roundtrip_error", f"WITH {V}, {_SQ8} SELECT id, round({fold('vec', 'dec', L2_SQ)}, 6) AS error FROM x")
def sq8_roundtrip_error(spark, sf):
    return _sq8(vectors(spark, sf)).select("id", F.round(D.l2_sq("vec", "dec"), 6).alias("error"))


@query("sq8_knn", f"WITH {V}, {Q}, {_SQ8}, s AS (SELECT query_id, id, {rounded(sql_distance('l2', 'dec', 'q'))} AS distance FROM x CROSS JOIN q) {ranked('s', K)}")
def sq8_knn(spark, sf):
    base = vectors(spark, sf)
    return search.knn(_sq8(base).select("id", F.col("dec").alias("vec")), queries(base), K)


@query("refine_rerank", f"WITH {V}, {Q}, {_SQ8}, s AS (SELECT query_id, id, {rounded(sql_distance('l2', 'dec', 'q'))} AS distance FROM x CROSS JOIN q), t AS ({ranked('s', 40)}), u AS (SELECT t.query_id, t.id, {rounded(sql_distance('l2', 'vec', 'q'))} AS distance FROM t JOIN v USING (id) JOIN q USING (query_id)) {ranked('u', K)}")
def refine_rerank(spark, sf):
    base = vectors(spark, sf)
    coarse = search.knn(_sq8(base).select("id", F.col("dec").alias("vec")), queries(base), 40)
    return search.rerank(coarse, base, queries(base), K)


_RES = f"r AS (SELECT id, list, c, list_transform(list_zip(vec, c), lambda z: z[1] - z[2]) AS vec FROM a JOIN c USING (list)), {_RANGE.format(src='r')}, e AS (SELECT id, list, c, {_codes(8)} AS code, lo, hi FROM r, g), x AS (SELECT id, list, list_transform(list_zip({_decoded(8, 'code')}, c), lambda z: z[1] + z[2]) AS dec FROM e)"


def _ivf_sq8(base: DataFrame) -> DataFrame:
    """Lists of rows as their residual codes give them back."""
    cells = cluster.assign(base, centroids(base)).join(F.broadcast(centroids(base)), "list")
    left = cells.select("id", "list", "c", F.expr("zip_with(vec, c, (x, y) -> x - y)").alias("vec"))
    low, high = quantize.value_range(left)
    coded = left.withColumn("code", quantize.sq_encode("vec", low, high)).withColumn("dec", quantize.sq_decode("code", low, high))
    return coded.select("list", "id", F.expr("zip_with(dec, c, (x, y) -> x + y)").alias("vec"))


@query("ivf_sq8_knn", f"{IVF}, {_RES}, s AS (SELECT query_id, id, {rounded(sql_distance('l2', 'dec', 'q'))} AS distance FROM x JOIN b USING (list)) {ranked('s', K)}")
def ivf_sq8_knn(spark, sf):
    base = vectors(spark, sf)
    return cluster.ivf_search(_ivf_sq8(base), queries(base), centroids(base), K, NPROBE)


@query("range_ivf_sq8", f"{IVF}, {_RES}, s AS (SELECT query_id, id, {rounded(sql_distance('l2', 'dec', 'q'))} AS distance FROM x CROSS JOIN q) SELECT * FROM s WHERE distance BETWEEN 2.0 AND 4.0")
def range_ivf_sq8(spark, sf):
    base = vectors(spark, sf)
    return cluster.ivf_range(_ivf_sq8(base), queries(base), 4.0).where("distance >= 2.0")


@query("range_ivf_probed", f"{IVF}, s AS (SELECT query_id, id, {rounded(sql_distance('l2', 'vec', 'q'))} AS distance FROM a JOIN b USING (list)) SELECT * FROM s WHERE distance <= 4.0")
def range_ivf_probed(spark, sf):
    base = vectors(spark, sf)
    return cluster.ivf_range_probed(cluster.assign(base, centroids(base)).drop("distance"), queries(base), centroids(base), 4.0, NPROBE)


# product quantization

_PQ = f"""k AS (SELECT CAST(s AS INT) AS sub, CAST(id // 31 AS INT) AS code, vec[s * {W} + 1 : s * {W} + {W}] AS c FROM v, range(0, {M}) t(s) WHERE id % 31 = 0 AND id < 496),
sv AS (SELECT id, CAST(s AS INT) AS sub, vec[s * {W} + 1 : s * {W} + {W}] AS sv FROM v, range(0, {M}) t(s)),
pc AS (SELECT id, sub, code FROM (SELECT id, sub, code, row_number() OVER (PARTITION BY id, sub ORDER BY d, code) AS r FROM (SELECT id, sub, code, round({fold('sv', 'c', L2_SQ)}, 9) AS d FROM sv JOIN k USING (sub))) WHERE r = 1)"""
_ADC = f"""lq AS (SELECT query_id, sub, code, round({fold('sv', 'c', L2_SQ)}, 9) AS d FROM (SELECT query_id, CAST(s AS INT) AS sub, q[s * {W} + 1 : s * {W} + {W}] AS sv FROM q, range(0, {M}) t(s)) JOIN k USING (sub)),
adc AS (SELECT query_id, id, round(sqrt(list_sum(list(d ORDER BY sub))), 9) AS distance FROM pc JOIN lq USING (sub, code) GROUP BY query_id, id)"""


def codebook(base: DataFrame) -> DataFrame:
    rows = base.where("id % 31 = 0 AND id < 496").select(F.expr("CAST(id div 31 AS INT)").alias("id"), "vec")
    return quantize.subvectors(rows, M).select("sub", F.col("id").alias("code"), F.col("sv").alias("c"))


@query("pq_encode", f"WITH {V}, {_PQ} SELECT id, string_agg(code, ',' ORDER BY sub) AS codes FROM pc GROUP BY id")
def pq_encode(spark, sf):
    base = vectors(spark, sf)
    return quantize.pq_encode(base, codebook(base), M).select("id", F.array_join("codes", ",").alias("codes"))


def _adc(base: DataFrame, k: int) -> DataFrame:
    return quantize.pq_search(quantize.pq_encode(base, codebook(base), M), codebook(base), queries(base), k, M)


@query("pq_adc_knn", f"WITH {V}, {Q}, {_PQ}, {_ADC} {ranked('adc', K)}")
def pq_adc_knn(spark, sf):
    return _adc(vectors(spark, sf), K)


@query("scann_two_stage", f"WITH {V}, {Q}, {_PQ}, {_ADC}, t AS ({ranked('adc', POOL)}), u AS (SELECT t.query_id, t.id, {rounded(sql_distance('l2', 'vec', 'q'))} AS distance FROM t JOIN v USING (id) JOIN q USING (query_id)) {ranked('u', K)}")
def scann_two_stage(spark, sf):
    base = vectors(spark, sf)
    return search.rerank(_adc(base, POOL), base, queries(base), K)


@query("ivf_pq_knn", f"{IVF}, {_PQ}, {_ADC}, s AS (SELECT adc.query_id, adc.id, distance FROM (SELECT query_id, id, distance FROM adc) adc JOIN (SELECT id, list FROM a) l USING (id) JOIN (SELECT query_id, list FROM b) p ON p.query_id = adc.query_id AND p.list = l.list), t AS ({ranked('s', POOL)}), u AS (SELECT t.query_id, t.id, {rounded(sql_distance('l2', 'vec', 'q'))} AS distance FROM t JOIN v USING (id) JOIN q USING (query_id)) {ranked('u', K)}")
def ivf_pq_knn(spark, sf):
    base = vectors(spark, sf)
    lists = quantize.pq_encode(cluster.assign(base, centroids(base)), codebook(base), M, ("id", "list"))
    visits = cluster.probes(queries(base), centroids(base), NPROBE).select("query_id", "list")
    near = quantize.pq_scores(lists, codebook(base), queries(base), M, visits)
    return search.rerank(search.top(near, POOL), base, queries(base), K)


@query("range_ivf_pq", f"WITH {V}, {Q}, {_PQ}, {_ADC} SELECT query_id, id, distance FROM adc WHERE distance <= 4.0")
def range_ivf_pq(spark, sf):
    base = vectors(spark, sf)
    return quantize.pq_scores(quantize.pq_encode(base, codebook(base), M), codebook(base), queries(base), M).where("distance <= 4.0")


# binary vectors

_MED = "m AS (SELECT id, list_transform(vec, lambda x: CASE WHEN x > t THEN 1 ELSE -1 END) AS vec FROM (SELECT id, vec, list_sort(vec)[len(vec) // 2 + 1] AS t FROM v))"


def _binary(name: str, bits, source: str, metric: str, where: str = "TRUE"):
    ctes = f"WITH {V}, {_MED}, q AS (SELECT id AS query_id, vec AS q FROM {source} WHERE id % 100 = 0), s AS (SELECT query_id, id, {rounded(sql_distance(metric, 'vec', 'q'))} AS distance FROM {source} CROSS JOIN q WHERE {where})"

    @query(name, f"{ctes} {ranked('s', K)}")
    def run(spark, sf):
        base = vectors(spark, sf).select("id", bits("vec").alias("vec"))
        return search.knn(base.where(where), queries(base), K, metric)


_binary("bin_flat_knn", D.sign_bits, "v", "hamming")
_binary("bin_flat_bitset", D.sign_bits, "v", "hamming", "id % 4 <> 0")
_binary("binary_hamming_knn", D.median_bits, "m", "hamming")
_binary("binary_jaccard_knn", D.median_bits, "m", "jaccard")


def _binary_ivf(name: str, bits, source: str):
    ivf = IVF.replace(f"{V}, {Q}", f"{V}, {_MED}, q AS (SELECT id AS query_id, vec AS q FROM {source} WHERE id % 100 = 0)").replace("FROM v WHERE id % 50", f"FROM {source} WHERE id % 50").replace("FROM v CROSS JOIN c", f"FROM {source} CROSS JOIN c")
    ivf = ivf.replace(sql_distance("l2", "vec", "c"), sql_distance("hamming", "vec", "c")).replace(sql_distance("l2", "q", "c"), sql_distance("hamming", "q", "c"))

    @query(name, f"{ivf}, s AS (SELECT query_id, id, {rounded(sql_distance('hamming', 'vec', 'q'))} AS distance FROM a JOIN b USING (list)) {ranked('s', K)}")
    def run(spark, sf):
        base = vectors(spark, sf).select("id", bits("vec").alias("vec"))
        lists = cluster.assign(base, centroids(base), "hamming").drop("distance")
        return cluster.ivf_search(lists, queries(base), centroids(base), K, NPROBE, "hamming")


_binary_ivf("bin_ivf_knn", D.sign_bits, "v")
_binary_ivf("binary_ivf_knn", D.median_bits, "m")


# models fitted on a sample, searched by code, reranked exactly


def _model(fit, factor: int = 16):
    def run(spark, sf):
        base = vectors(spark, sf).select("id", "vec")
        return quantize.two_stage(base, queries(base), fit(cluster.sampled(base)), K, factor)

    return run


QUERIES |= {
    "sq8_two_stage": _model(quantize.Scalar.fit),
    "sq6_two_stage": _model(lambda r: quantize.Scalar.fit(r, 6)),
    "sq4_two_stage": _model(lambda r: quantize.Scalar.fit(r, 4)),
    "refine_fp16": _model(lambda r: quantize.Half("float16")),
    "refine_bf16": _model(lambda r: quantize.Half("bfloat16")),
    "pq_two_stage": _model(lambda r: quantize.Product.fit(r, 32, 6)),
    "anisotropic_two_stage": _model(lambda r: quantize.Weighted.fit(r, r[::10], 32, 6)),
    "opq_two_stage": _model(lambda r: quantize.Rotated.fit(r, 32, 6)),
    "residual_pq_two_stage": _model(lambda r: quantize.Residual.fit_coarse(r, 16, 32, 6)),
    "residual_opq_two_stage": _model(lambda r: quantize.Residual.fit_coarse(r, 16, 32, 6, optimized=True)),
    "rq_two_stage": _model(lambda r: quantize.Residual.fit(r, 12, 6), 32),
    "prq_two_stage": _model(lambda r: quantize.Split.fit(r, 16, 2, 5)),
    "hvq_two_stage": _model(quantize.Affine.fit),
    "usq1_two_stage": _model(lambda r: quantize.Uniform.fit(r, 1), 16),
    "usq4_two_stage": _model(quantize.Uniform.fit),
    "usq8_two_stage": _model(lambda r: quantize.Uniform.fit(r, 8)),
    "turboquant_two_stage": _model(quantize.Turbo.fit),
    "turboquant_prod_two_stage": _model(lambda r: quantize.Turbo.fit(r, signs=True)),
    "pca_sq8_two_stage": _model(lambda r: quantize.Principal.fit(r, 48, quantize.Scalar.fit), 16),
    "pca_usq_two_stage": _model(lambda r: quantize.Principal.fit(r, 48, quantize.Uniform.fit), 16),
}


def _ivf_model(fit, nlist: int = 16, nprobe: int = 12, factor: int = 16):
    def run(spark, sf):
        base = vectors(spark, sf).select("id", "vec")
        rows = cluster.sampled(base)
        lists, model = cluster.kmeans(rows, nlist), fit(rows)
        codes = quantize.encoded(cluster.assign_blocks(base, lists), model, ("id", "list"))
        return search.rerank(quantize.ivf_code_search(codes, queries(base), lists, model, factor * K, nprobe), base, queries(base), K)

    return run


QUERIES |= {"ivf_opq_knn": _ivf_model(lambda r: quantize.Rotated.fit(r, 32, 6)), "ivf_usq_knn": _ivf_model(quantize.Uniform.fit), "ivf_turboquant_knn": _ivf_model(quantize.Turbo.fit)}


@query("pca_project")
def pca_project(spark, sf):
    base = vectors(spark, sf).select("id", "vec")
    model = quantize.Principal.fit(cluster.sampled(base), 16)
    axes = F.array(*[F.array(*[F.lit(float(x)) for x in a]) for a in model.axes])
    mean = F.array(*[F.lit(float(x)) for x in model.mean])
    left = base.withColumn("_x", F.zip_with("vec", mean, lambda x, m: x - m)).withColumn("_a", axes)
    return left.select("id", F.expr("transform(_a, a -> round(aggregate(zip_with(a, _x, (x, y) -> x * y), 0D, (s, x) -> s + x), 6))").alias("projection"))
