"""Every query of the engine's own operators, and its SQL. Queries run over whole tables; k is the feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distances as D
from ..operators import evaluate, filters, search, warping
from . import catalog_graph, catalog_models, catalog_sparse
from .inputs import IP, L2_SQ, PAIRS, SCALARS, Q, V, flat_sql, fold, queries, ranked, rounded, scalars, series, sql_cosine, sql_distance, vectors

K = 10
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# distances


def _distance_query(name: str, metric: str, similar: bool, sql: str):
    @query(name, f"{PAIRS} SELECT query_id, id, {rounded(sql)} AS value FROM p")
    def run(spark, sf):
        base = vectors(spark, sf)
        return search.scored(base, queries(base), metric, similar).withColumnRenamed("distance", "value")


for _name, _metric, _similar, _sql in (
    ("dist_l2", "l2", False, sql_distance("l2", "vec", "q")),
    ("dist_l2_sq", "l2_sq", False, fold("vec", "q", L2_SQ)),
    ("dist_ip", "ip", True, fold("vec", "q", IP)),
    ("sim_cosine", "cosine", True, sql_cosine("vec", "q")),
    ("dist_cosine", "cosine", False, sql_distance("cosine", "vec", "q")),
    ("dist_l1", "l1", False, sql_distance("l1", "vec", "q")),
    ("dist_linf", "linf", False, sql_distance("linf", "vec", "q")),
):
    _distance_query(_name, _metric, _similar, _sql)


def _coded(spark, sf, metric: str, similar: bool = False) -> DataFrame:
    base = vectors(spark, sf).withColumn("vec", D.sign_bits("vec"))
    return search.scored(base, queries(base), metric, similar).withColumnRenamed("distance", "value")


for _name, _metric, _expr in (("dist_hamming", "hamming", "hamming"), ("dist_hamming_sign", "hamming", "hamming"), ("dist_jaccard_sign", "jaccard", "jaccard")):

    @query(_name, f"{PAIRS} SELECT query_id, id, {rounded(sql_distance(_metric, 'vec', 'q'))} AS value FROM p")
    def _bits(spark, sf, metric=_metric):
        return _coded(spark, sf, metric)


@query("sim_jaccard_bits", f"{PAIRS} SELECT query_id, id, {rounded('1 - (' + sql_distance('jaccard', 'vec', 'q') + ')')} AS value FROM p")
def sim_jaccard_bits(spark, sf):
    return _coded(spark, sf, "jaccard", True)


@query("pairwise_matrix", f"{PAIRS} SELECT query_id, list(d ORDER BY id) AS line FROM (SELECT query_id, id, {rounded(sql_distance('l2', 'vec', 'q'))} AS d FROM p) GROUP BY query_id")
def pairwise_matrix(spark, sf):
    base = vectors(spark, sf)
    return search.distance_lines(base, queries(base))


def _half(kind: str, metric: str = "l2"):
    def run(spark, sf):
        from ..operators.quantize import Half, code_search, encoded

        base, model = vectors(spark, sf), Half(kind)
        return code_search(encoded(base, model), queries(base), model, K, metric)

    return run


QUERIES["dist_l2_fp16"], QUERIES["dist_l2_bf16"] = _half("float16"), _half("bfloat16")
QUERIES["dist_ip_fp16"], QUERIES["dist_ip_bf16"] = _half("float16", "ip"), _half("bfloat16", "ip")


@query("sparse_to_dense", f"WITH {V} SELECT id, list_transform(vec, lambda x: CASE WHEN abs(x) > 0.5 THEN x ELSE 0.0 END) AS vec FROM v")
def sparse_to_dense(spark, sf):
    return vectors(spark, sf).withColumn("s", D.to_sparse("vec", 0.5)).select("id", D.to_dense("s", 64).alias("vec"))


@query("bitset_flip", f"WITH {V} SELECT id FROM v WHERE id % 3 <> 0")
def bitset_flip(spark, sf):
    base = vectors(spark, sf)
    return filters.flipped(base.where("id % 3 = 0"), base)


@query("bitset_remap", f"WITH {V}, m AS (SELECT id AS pos, id * 7 + 1 AS id FROM v) SELECT m.id FROM m JOIN v ON m.pos = v.id + 5 WHERE v.id % 3 = 0")
def bitset_remap(spark, sf):
    base = vectors(spark, sf)
    return filters.remapped(base.where("id % 3 = 0"), base.select(F.col("id").alias("pos"), (F.col("id") * 7 + 1).alias("id")), 5)


@query("bitset_next", f"WITH {V}, n AS (SELECT id, min(CASE WHEN id % 7 = 3 THEN id END) OVER (ORDER BY id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next FROM v) SELECT id, next FROM n WHERE next IS NOT NULL")
def bitset_next(spark, sf):
    base = vectors(spark, sf)
    return filters.next_set(base.where("id % 7 = 3"), base).where("next IS NOT NULL")


@query("dist_by_ids", f"WITH {V}, w AS (SELECT id AS a, id + 1 AS b FROM v) SELECT a, b, {rounded(sql_distance('l2', 'x.vec', 'y.vec'))} AS distance FROM w JOIN v x ON x.id = a JOIN v y ON y.id = b")
def dist_by_ids(spark, sf):
    base = vectors(spark, sf)
    return search.distance_by_ids(base, base.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


def _dtw(cost: str, band: bool = False, slope: float | None = None):
    def run(spark, sf):
        rows = series(spark, sf)
        asked = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("series").alias("q"))
        return warping.all_pairs(rows, asked, cost, (lambda n, m: abs(n - m) + max(n, m) // 10) if band else None, slope)

    return run


QUERIES |= {"dtw_l2": _dtw("l2"), "dtw_sakoe_chiba": _dtw("l2", band=True), "dtw_itakura": _dtw("l2", slope=2.0), "dtw_cosine": _dtw("cosine"), "dtw_ip": _dtw("ip")}


@query("binarize_median", f"""WITH {V}, t AS (SELECT id, vec, list_sort(vec)[len(vec) // 2 + 1] AS m FROM v)
SELECT id, CAST(len(list_filter(vec, lambda x: x > m)) AS BIGINT) AS n_set, CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN vec[i + 1] > m THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT) AS low FROM t""")
def binarize_median(spark, sf):
    code = vectors(spark, sf).select("id", D.median_bits("vec").alias("code"))
    return code.select("id", F.expr("aggregate(code, 0L, (s, w) -> s + bit_count(w))").alias("n_set"), F.expr("code[0] & 4294967295L").alias("low"))


@query("dense_to_sparse", f"WITH {V}, e AS (SELECT id, generate_subscripts(vec, 1) - 1 AS term, unnest(vec) AS w FROM v) SELECT id, CAST(term AS BIGINT) AS term, w FROM e WHERE abs(w) > 0.5")
def dense_to_sparse(spark, sf):
    return vectors(spark, sf).select("id", F.explode(D.to_sparse("vec", 0.5)).alias("e")).select("id", F.col("e.term").cast("long").alias("term"), "e.w")


# filters

FILTERS = {
    "filter_expr_eq": (("eq", "lang", "en"), "coalesce(lang = 'en', false)"),
    "filter_expr_range": (("and", ("ge", "n_chars", 500), ("lt", "n_chars", 3000)), "coalesce(n_chars >= 500, false) AND coalesce(n_chars < 3000, false)"),
    "filter_expr_in": (("in", "source", ["src1", "src2", "src3"]), "coalesce(source IN ('src1', 'src2', 'src3'), false)"),
    "filter_expr_not_missing": (("not", ("eq", "toxic", 1)), "NOT coalesce(toxic = 1, false)"),
    "filter_expr_unknown_field": (("or", ("not", ("eq", "nowhere", 1)), ("eq", "lang", 3)), "TRUE"),
    "filter_expr_nested": (("or", ("and", ("eq", "quality", 1), ("ne", "lang", "en")), ("gt", "n_chars", 8000)), "(coalesce(quality = 1, false) AND coalesce(lang <> 'en', false)) OR coalesce(n_chars > 8000, false)"),
}
for _name, (_tree, _sql) in FILTERS.items():

    @query(_name, f"WITH {SCALARS} SELECT id FROM s WHERE {_sql}")
    def _filter(spark, sf, tree=_tree):
        return filters.scan(scalars(spark, sf), tree).select("id")


@query("mv_scan", f"WITH {SCALARS} SELECT id, lang, n_chars FROM s WHERE coalesce(lang = 'de', false) AND coalesce(n_chars > 100, false)")
def mv_scan(spark, sf):
    return filters.scan(scalars(spark, sf), ("and", ("eq", "lang", "de"), ("gt", "n_chars", 100))).select("id", "lang", "n_chars")


@query("mv_filter", f"WITH {SCALARS}, w AS (SELECT 1000000 - id AS ord, id FROM s) SELECT ord, id FROM w WHERE id IN (SELECT id FROM s WHERE coalesce(quality = 1, false))")
def mv_filter(spark, sf):
    rows = scalars(spark, sf)
    wanted = rows.select((1000000 - F.col("id")).alias("ord"), "id")
    return filters.keep_order(wanted, rows, ("eq", "quality", 1)).select("ord", "id")


@query("mv_upsert", """WITH s AS (SELECT doc_id AS id, lang, n_chars FROM documents)
SELECT id, CASE WHEN id % 3 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM s WHERE NOT (id % 7 = 0)""")
def mv_upsert(spark, sf):
    rows = scalars(spark, sf).select("id", "lang", "n_chars")
    changed = rows.where("id % 3 = 0").select("id", F.lit("xx").alias("lang"), (F.col("n_chars") + 1).alias("n_chars"), F.lit(1).alias("version"), F.lit(False).alias("deleted"))
    gone = rows.where("id % 7 = 0").select("id", "lang", "n_chars", F.lit(2).alias("version"), F.lit(True).alias("deleted"))
    return filters.upsert(rows, changed.union(gone))


SETS = "WITH a AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 3 = 0)"


def _sets(spark, sf):
    ids = vectors(spark, sf).select("id")
    return ids.where("id % 2 = 0"), ids.where("id % 3 = 0"), ids


@query("bitset_or", f"{SETS} SELECT id FROM a UNION SELECT id FROM b")
def bitset_or(spark, sf):
    return filters.union(*_sets(spark, sf)[:2])


@query("bitset_and", f"{SETS} SELECT id FROM a INTERSECT SELECT id FROM b")
def bitset_and(spark, sf):
    return filters.intersection(*_sets(spark, sf)[:2])


@query("bitset_xor", f"{SETS} (SELECT id FROM a EXCEPT SELECT id FROM b) UNION ALL (SELECT id FROM b EXCEPT SELECT id FROM a)")
def bitset_xor(spark, sf):
    return filters.difference_both(*_sets(spark, sf)[:2])


@query("bitset_count", """SELECT CAST(count(*) FILTER (WHERE vec_id % 3 = 0) AS BIGINT) AS n_set, min(vec_id) FILTER (WHERE vec_id % 3 = 0) AS first_set, max(vec_id) FILTER (WHERE vec_id % 3 = 0) AS last_set,
min(vec_id) FILTER (WHERE vec_id % 3 <> 0) AS first_valid, avg(CAST(vec_id % 3 = 0 AS INT)) AS filter_ratio FROM embeddings""")
def bitset_count(spark, sf):
    _, b, ids = _sets(spark, sf)
    return filters.summary(b, ids)


@query("get_vectors_by_ids", f"WITH {V}, w AS (SELECT 1000000 - id AS ord, id * 2 AS id FROM v) SELECT ord, id, vec FROM w JOIN v USING (id)")
def get_vectors_by_ids(spark, sf):
    base = vectors(spark, sf)
    return search.by_ids(base, base.select((1000000 - F.col("id")).alias("ord"), (F.col("id") * 2).alias("id")))


@query("bin_remove_ids", f"WITH {V} SELECT id, CAST({fold('vec', 'vec', 'CASE WHEN z[1] >= 0 THEN 1 ELSE 0 END')} AS BIGINT) AS n_bits FROM v WHERE id % 4 <> 0")
def bin_remove_ids(spark, sf):
    base = vectors(spark, sf).select("id", D.sign_bits("vec").alias("code"))
    return search.excluding(base, base.where("id % 4 = 0")).select("id", F.expr("aggregate(code, 0L, (s, w) -> s + bit_count(w))").alias("n_bits"))


# exact search

for _metric in ("l2", "ip", "cosine"):

    @query(f"knn_flat_{_metric}", flat_sql(_metric, K))
    def _flat(spark, sf, metric=_metric):
        base = vectors(spark, sf)
        return search.knn(base, queries(base), K, metric)

    @query(f"knn_blocks_{_metric}", flat_sql(_metric, K))
    def _blocks(spark, sf, metric=_metric):
        base = vectors(spark, sf)
        return search.knn_blocks(base, queries(base), K, metric)


@query("knn_flat_bitset", flat_sql("l2", K, "id % 3 <> 0"))
def knn_flat_bitset(spark, sf):
    base = vectors(spark, sf)
    return search.knn(search.excluding(base, base.where("id % 3 = 0")), queries(base), K)


@query("knn_filter_ids", flat_sql("l2", K, "id % 5 = 1"))
def knn_filter_ids(spark, sf):
    base = vectors(spark, sf)
    return search.knn(search.excluding(base, None, allowed=base.where("id % 5 = 1")), queries(base), K)


@query("knn_filter_range", flat_sql("l2", K, "id BETWEEN 50 AND 400"))
def knn_filter_range(spark, sf):
    base = vectors(spark, sf)
    return search.knn(search.excluding(base, None, where=F.col("id").between(50, 400)), queries(base), K)


QUERIES["knn_filter_bitset"], ORACLES["knn_filter_bitset"] = QUERIES["knn_flat_bitset"], ORACLES["knn_flat_bitset"]

for _name, _metric, _radius, _where in (("range_flat_l2", "l2", 4.0, "distance <= 4.0"), ("range_flat_ip", "ip", 10.0, "distance <= -10.0"), ("range_flat_cosine", "cosine", 0.2, "distance <= 1.0 - 0.2 + 1e-9")):

    @query(_name, f"{PAIRS}, s AS (SELECT query_id, id, {rounded(sql_distance(_metric, 'vec', 'q'))} AS distance FROM p) SELECT * FROM s WHERE {_where}")
    def _range(spark, sf, metric=_metric, radius=_radius):
        base = vectors(spark, sf)
        return search.range_search(base, queries(base), radius, metric)


@query("range_flat_filter", f"{PAIRS}, s AS (SELECT query_id, id, {rounded(sql_distance('l2', 'vec', 'q'))} AS distance FROM p WHERE id % 2 = 1) SELECT * FROM s WHERE distance <= 4.0")
def range_flat_filter(spark, sf):
    base = vectors(spark, sf)
    return search.range_search(base.where("id % 2 = 1"), queries(base), 4.0)


@query("range_limits", f"{PAIRS} SELECT query_id, CAST(count(*) FILTER (WHERE {rounded(sql_distance('l2', 'vec', 'q'))} <= 4.0) AS BIGINT) AS n FROM p GROUP BY query_id")
def range_limits(spark, sf):
    base = vectors(spark, sf)
    return search.limits(search.range_search(base, queries(base), 4.0), queries(base))


@query("ann_iterator_page", f"SELECT * FROM ({flat_sql('l2', 30)}) WHERE rank BETWEEN 11 AND 20")
def ann_iterator_page(spark, sf):
    base = vectors(spark, sf)
    return search.page(search.knn(base, queries(base), 30), 11, 10)


# evaluation: an approximate result (rows of odd id only) against the truth

_APPROX = f"WITH t AS ({flat_sql('l2', K)}), r AS ({flat_sql('l2', K, 'id % 3 <> 1')})"


def _approx(spark, sf):
    base = vectors(spark, sf)
    return search.knn(base.where("id % 3 <> 1"), queries(base), K), search.knn(base, queries(base), K)


QUERIES["ground_truth"], ORACLES["ground_truth"] = QUERIES["knn_flat_l2"], ORACLES["knn_flat_l2"]


@query("recall_at_k", f"{_APPROX} SELECT r.query_id, sum(CASE WHEN t.id IS NULL THEN 0 ELSE 1 END) / CAST(least(count(*), {K}) AS DOUBLE) AS recall FROM r LEFT JOIN t ON r.query_id = t.query_id AND r.id = t.id GROUP BY r.query_id")
def recall_at_k(spark, sf):
    return evaluate.recall_at_k(*_approx(spark, sf), K)


@query("recall_micro", f"{_APPROX} SELECT sum(CASE WHEN r.id IS NULL THEN 0 ELSE 1 END) / CAST(count(*) AS DOUBLE) AS recall FROM t LEFT JOIN r ON r.query_id = t.query_id AND r.id = t.id")
def recall_micro(spark, sf):
    return evaluate.recall_micro(*_approx(spark, sf), K)


@query("recall_confidence", f"WITH e AS ({ORACLES['recall_at_k']}) SELECT query_id, CASE WHEN recall >= 0.8 THEN 'trusted' WHEN recall >= 0.5 THEN 'unreliable' ELSE 'recheck' END AS confidence FROM e")
def recall_confidence(spark, sf):
    return recall_at_k(spark, sf).select("query_id", evaluate.confidence(F.col("recall"), 0.8).alias("confidence"))


@query("validate_distances", f"WITH h AS ({flat_sql('l2', K)}), o AS (SELECT *, coalesce(distance >= lag(distance) OVER (PARTITION BY query_id ORDER BY rank), true) AS ok FROM h) SELECT query_id, bool_and(distance > -1 AND distance < 100) AS in_bounds, bool_and(distance >= 0) AS non_negative, bool_and(ok) AS monotone FROM o GROUP BY query_id")
def validate_distances(spark, sf):
    base = vectors(spark, sf)
    return evaluate.validate(search.knn(base, queries(base), K), -1, 100)


@query("distance_stats", f"WITH h AS ({flat_sql('l2', K)}) SELECT min(distance) AS min, max(distance) AS max, round(avg(distance), 6) AS mean, round(stddev_pop(distance), 6) AS std FROM h")
def distance_stats(spark, sf):
    base = vectors(spark, sf)
    return evaluate.distance_statistics(search.knn(base, queries(base), K))


@query("memory_estimate", "SELECT CAST(count(*) * 64 * 4 AS BIGINT) AS flat, CAST(count(*) * 4 + 100 * 64 AS BIGINT) AS ivf, CAST(count(*) * 16 * 2 * 4 + count(*) * 64 * 4 AS BIGINT) AS hnsw FROM embeddings")
def memory_estimate(spark, sf):
    made = evaluate.memory_estimate(F.col("n"), F.col("d"), 100, 16)
    return vectors(spark, sf).agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).select(*[c.cast("long").alias(n) for n, c in made.items()])


for _part in (catalog_sparse, catalog_models, catalog_graph):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
