"""Queries over proximity graphs: neighbours are looked for in each row's two nearest cells."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import distances as D
from ..operators import cluster, graph, quantize, search
from .catalog_models import C, centroids
from .inputs import V, queries, ranked, rounded, sql_distance, vectors

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K, DEGREE, ALPHA = 10, 12, 1.2
#: Hits of a range walk, and its radius.
WIDTH, RADIUS = 256, 4.0
CELLS = f"cells AS (SELECT id, vec, list FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, list) AS r FROM (SELECT id, vec, list, {rounded(sql_distance('l2', 'vec', 'c'))} AS d FROM v CROSS JOIN c)) WHERE r <= 2)"
EDGES = f"""n AS (SELECT DISTINCT x.id AS src, y.id AS dst, {rounded(sql_distance('l2', 'x.vec', 'y.vec'))} AS dist FROM cells x JOIN cells y ON x.list = y.list AND x.id <> y.id),
e AS ({ranked('n', DEGREE, 'src, rank, dst, dist', 'dist, dst', 'src')})"""
GRAPH = f"WITH {V}, {C}, {CELLS}, {EDGES}"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    base = vectors(spark, sf).select("id", "vec")
    cells = cluster.assign(base, centroids(base), probes=2)
    return base, graph.knn_edges(cells, DEGREE)


@query("knn_graph_edges", f"{GRAPH} SELECT src, rank, dst, dist FROM e")
def knn_graph_edges(spark, sf):
    return _graph(spark, sf)[1]


@query("nn_descent_edges", f"""{GRAPH}, n2 AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst UNION SELECT src, dst FROM e),
d AS (SELECT src, dst, {rounded(sql_distance('l2', 'x.vec', 'y.vec'))} AS dist FROM n2 JOIN v x ON x.id = src JOIN v y ON y.id = dst) {ranked('d', DEGREE, 'src, rank, dst, dist', 'dist, dst', 'src')}""")
def nn_descent_edges(spark, sf):
    base, edges = _graph(spark, sf)
    return graph.descend(edges, base, DEGREE)


@query("graph_levels")
def graph_levels(spark, sf):
    return graph.levels(vectors(spark, sf)).groupBy("level").agg(F.count("*").alias("n"))


@query("alpha_prune", f"{GRAPH}, h AS (SELECT DISTINCT a.src, a.dst FROM e a JOIN e b ON a.src = b.src AND b.rank < a.rank JOIN v x ON x.id = b.dst JOIN v y ON y.id = a.dst WHERE ({rounded(sql_distance('l2', 'x.vec', 'y.vec'))}) * {ALPHA} <= a.dist) SELECT src, rank, dst, dist FROM e WHERE (src, dst) NOT IN (SELECT src, dst FROM h)")
def alpha_prune(spark, sf):
    base, edges = _graph(spark, sf)
    return graph.alpha_prune(edges, base, ALPHA).select("src", "rank", "dst", "dist")


@query("reverse_edges", f"{GRAPH}, r AS (SELECT src, dst, dist FROM e UNION SELECT dst, src, dist FROM e) {ranked('r', 16, 'src, rank, dst, dist', 'dist, dst', 'src')}")
def reverse_edges(spark, sf):
    return graph.with_reverse(_graph(spark, sf)[1], 16)


@query("graph_delete_consolidate", f"""{GRAPH}, l AS (SELECT src, dst FROM e WHERE src % 7 <> 0 AND dst % 7 <> 0),
t AS (SELECT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src % 7 <> 0 AND a.dst % 7 = 0 AND b.dst % 7 <> 0 AND a.src <> b.dst) SELECT src, dst FROM l UNION SELECT src, dst FROM t""")
def graph_delete_consolidate(spark, sf):
    base, edges = _graph(spark, sf)
    return graph.consolidate(edges, base.where("id % 7 = 0"))


@query("graph_degree_stats", f"{GRAPH}, d AS (SELECT src, count(*) AS n FROM e GROUP BY src) SELECT CAST(count(*) AS BIGINT) AS nodes, CAST(sum(n) AS BIGINT) AS edges, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM d")
def graph_degree_stats(spark, sf):
    return graph.degree_stats(_graph(spark, sf)[1])


@query("graph_unreachable", f"{GRAPH} SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e)")
def graph_unreachable(spark, sf):
    base, edges = _graph(spark, sf)
    return graph.unreachable(edges, base)


@query("graph_reachable", f"{GRAPH.replace('WITH ', 'WITH RECURSIVE ', 1)}, r AS (SELECT min(id) AS id FROM v UNION SELECT dst FROM e JOIN r ON src = r.id) SELECT id FROM r")
def graph_reachable(spark, sf):
    base, edges = _graph(spark, sf)
    return graph.reachable(edges, base.agg(F.min("id").alias("id")))


@query("graph_repair", f"{GRAPH}, u AS (SELECT id FROM v WHERE id NOT IN (SELECT dst FROM e)) SELECT src, dst, dist FROM e UNION SELECT dst, src, dist FROM e WHERE rank = 1 AND src IN (SELECT id FROM u)")
def graph_repair(spark, sf):
    base, edges = _graph(spark, sf)
    return graph.repaired(edges, base)


def _over_codes(fit):
    """A graph of what codes give back, walked for a pool that is reranked exactly."""

    def run(spark, sf):
        base = vectors(spark, sf).select("id", "vec")
        rows = cluster.sampled(base)
        model, lists = fit(rows), cluster.kmeans(rows, max(4, graph.cells_for(base.count())))
        coded = quantize.decoded(quantize.encoded(base, model), model)
        stored = graph.build(cluster.assign_blocks(coded, lists).select("list", "id", "vec"), 24)
        return search.rerank(graph.walk(stored, queries(base), 4 * K, 160, centroids=lists, nprobe=8), base, queries(base), K)

    return run


QUERIES |= {
    "graph_sq_knn": _over_codes(quantize.Scalar.fit), "graph_pq_knn": _over_codes(lambda r: quantize.Product.fit(r, 32, 6)), "graph_prq_knn": _over_codes(lambda r: quantize.Split.fit(r, 32, 2, 6)),
    "graph_hvq_knn": _over_codes(quantize.Affine.fit), "graph_pca_usq_knn": _over_codes(lambda r: quantize.Principal.fit(r, 56, lambda x: quantize.Uniform.fit(x, 8))),
}


@query("graph_binary_knn")
def graph_binary_knn(spark, sf):
    base = vectors(spark, sf).select("id", D.sign_bits("vec").alias("vec"))
    lists = cluster.bit_kmeans(cluster.sampled(base, dtype=np.int64), max(4, graph.cells_for(base.count())))
    stored = graph.build(cluster.assign_blocks(base, lists, "hamming").select("list", "id", "vec"), 24, "hamming")
    return graph.walk(stored, queries(base), K, 160, "hamming", lists, 8)


@query("robust_prune")
def robust_prune(spark, sf):
    base, edges = _graph(spark, sf)
    return graph.robust_prune(edges, base, ALPHA, DEGREE)


def _walk(spark, sf, excluded: str | None = None) -> DataFrame:
    base = vectors(spark, sf).select("id", "vec")
    rows = search.excluding(base, base.where(excluded)) if excluded else base
    lists = cluster.kmeans(cluster.sampled(base), max(4, graph.cells_for(base.count())))
    stored = graph.build(cluster.assign_blocks(rows, lists).select("list", "id", "vec"), 24)
    return graph.walk(stored, queries(base), K, 160, centroids=lists, nprobe=8)


@query("graph_beam_knn")
def graph_beam_knn(spark, sf):
    return _walk(spark, sf)


@query("graph_beam_filtered")
def graph_beam_filtered(spark, sf):
    """Filtered search: a scan where that is cheaper, else a walk of the graph of what is allowed."""
    base = vectors(spark, sf).select("id", "vec")
    n, out = base.agg(F.count("*"), F.count_if(F.expr("id % 3 = 0"))).first()
    if search.scan_is_better(n, out, K):
        return search.knn(search.excluding(base, base.where("id % 3 = 0")), queries(base), K)
    return _walk(spark, sf, "id % 3 = 0")


@query("range_graph")
def range_graph(spark, sf):
    """A walk of WIDTH hits a query; a query that all of them are in range of may have more, and is answered by a scan."""
    base = vectors(spark, sf).select("id", "vec")
    lists = cluster.kmeans(cluster.sampled(base), max(4, graph.cells_for(base.count())))
    found = graph.graph_search(cluster.assign_blocks(base, lists).select("list", "id", "vec"), queries(base), WIDTH, ef=WIDTH).where(f"distance <= {RADIUS}").persist()
    full = [r["query_id"] for r in found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= WIDTH).collect()]
    exact = search.range_search(base, queries(base).where(F.col("query_id").isin(full)), RADIUS)
    numbered = exact.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")).cast("long"))
    return found.where(~F.col("query_id").isin(full)).unionByName(numbered.select(found.columns))
