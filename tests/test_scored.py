"""All pairs, nearest and range by tasks that score whole batches: against SQL to the last bit, in small parts, with odd vectors."""

import math
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.functions import distances as D
from vexel.operators import cluster, search
from vexel.plans import catalog

SF = "/root/testdata/sf0.001"
NAMED = ["dist_l2", "dist_l2_sq", "dist_ip", "dist_l1", "sim_cosine", "knn_flat_cosine", "knn_flat_ip", "knn_flat_bitset", "range_flat_cosine", "range_limits", "recall_at_k", "validate_distances", "pairwise_matrix", "ivf_flat_knn", "range_ivf_probed", "range_ivf_sq8"]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"PART": 3, "MANY": 2, "SLICE": 4, "TILE": 8, "EMITTED": 16}.items():
        monkeypatch.setattr(search, name, value)


@pytest.mark.parametrize("name", NAMED)
def test_no_row_is_a_pair_of_vectors(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and not re.search(r"\bq#\d", plan)


def test_rounding_is_that_of_sql(spark):
    """Values that lie on a half as decimals, but not after they are scaled as SQL does."""
    rng = np.random.default_rng(0)
    x = np.concatenate([np.round(rng.uniform(0, 2000, 200_000), 10), [0.5e-9, 2.5e-9, 0.0009765625, -0.0009765625, 1e300, math.inf, 0.0]])
    want = duckdb.connect().execute("SELECT round(x, 9) + 0.0 AS r FROM (SELECT unnest(?) AS x, generate_subscripts(?, 1) AS i) ORDER BY i", [x.tolist()] * 2).fetchnumpy()["r"]
    assert (D.rounded(x) == want).all()
    other = spark.createDataFrame([(float(v),) for v in x[:200_000]], "x double").select(search.rounded(F.col("x"))).toPandas().iloc[:, 0].to_numpy()
    odd = np.flatnonzero(other != want[:200_000])[:20]
    assert len(odd)
    base = spark.createDataFrame([(int(i), [float(x[i])]) for i in odd], "id long, vec array<double>")
    asked = spark.createDataFrame([(0, [0.0])], "query_id long, q array<double>")
    assert search.distance_lines(base, asked).first()["line"] == [want[i] for i in sorted(odd)]


def brute(rows, asked, metric):
    return {(a, i): float(D.rounded(D.exact(metric, np.array([q]), np.array([v]).T))[0, 0]) for a, q in asked for i, v in rows}


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine", "l1", "linf"])
def test_parts_and_tiles(spark, small, metric):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 5)]) for i in range(50)]
    asked = [(i, v) for i, v in rows if i % 5 == 0]
    base, queries = spark.createDataFrame(rows, "id long, vec array<double>"), spark.createDataFrame(asked, "query_id long, q array<double>")
    want = brute(rows, asked, metric)
    assert {(r["query_id"], r["id"]): r["distance"] for r in search.scored(base, queries, metric).collect()} == want
    near = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in search.knn(base, queries, 7, metric).collect())
    assert near == sorted((a, n, i, d) for a, _ in asked for n, (d, i) in enumerate(sorted((want[a, i], i) for i, _ in rows)[:7], 1))
    if metric == "l2":
        assert {(r["query_id"], r["id"]) for r in search.range_search(base, queries, 3.0).collect()} == {p for p, d in want.items() if d <= 3.0}
        lines = {r["query_id"]: r["line"] for r in search.distance_lines(base, queries).collect()}
        assert lines == {a: [want[a, i] for i, _ in rows] for a, _ in asked}
        lists, centroids = base.withColumn("list", (F.col("id") % 4).cast("int")), spark.createDataFrame([(i, rows[i][1]) for i in range(4)], "list int, c array<double>")
        seen = {a: sorted((want[a, i], i) for i in range(4))[:2] if (a, 0) in want else [] for a, _ in asked}
        inside = {(a, i): d for (a, i), d in want.items() if i % 4 in {n for _, n in seen[a]}}
        assert {(r["query_id"], r["id"]) for r in cluster.ivf_range_probed(lists, queries, centroids, 4.0, 2).collect()} == {p for p, d in inside.items() if d <= 4.0}
        found = sorted((r["query_id"], r["rank"], r["id"]) for r in cluster.ivf_search(lists, queries, centroids, 3, 2).collect())
        assert found == sorted((a, n, i) for a, _ in asked for n, (_, i) in enumerate(sorted((d, i) for (b, i), d in inside.items() if b == a)[:3], 1))


def test_odd_vectors(spark, small):
    """Null vectors, nulls inside and other lengths have no distance, are no hits before others, and lose no row."""
    base = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None), ("c", [1.0, None]), ("d", [1.0]), ("e", [3.0, 2.0])], "id string, vec array<double>")
    asked = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [1.0])], "query_id long, q array<double>")
    got = {(r["query_id"], r["id"]): r["distance"] for r in search.scored(base, asked, "l2").collect()}
    assert len(got) == 15 and {p: d for p, d in got.items() if d is not None} == {(0, "a"): 0.0, (0, "e"): 2.0, (2, "d"): 0.0}
    assert {r["distance"] for r in search.scored(base, asked, "cosine", similar=True).where("id = 'b'").collect()} == {0.0}
    assert [r["id"] for r in search.knn(base, asked, 3).where("query_id = 0").orderBy("rank").collect()] == ["a", "e", "b"]
    assert search.range_search(base, asked, 2.0).count() == 3
    assert search.knn(base.limit(0), asked, 3).count() == search.knn(base, asked.limit(0), 3).count() == search.scored(base, asked.limit(0), "l2").count() == 0


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2", "hamming", "jaccard"])
def test_late_interaction_in_slices(spark, monkeypatch, metric):
    """Documents that slices, batches and parts of queries cut, repeated positions, vectors without a similarity."""
    from vexel.operators import multivector

    for name, value in {"PART": 4, "SLICE": 3, "TILE": 6}.items():
        monkeypatch.setattr(multivector, name, value)
    rng = np.random.default_rng(2)
    tokens = [(i // 7, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(70)] + [(3, None), (99, [1.0])]
    asked = [(i // 3, i % 2, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(12)]
    rows = spark.createDataFrame(tokens, "id long, vec array<double>")
    queries = spark.createDataFrame(asked, "query_id long, pos long, q array<double>")
    want = {}
    for a in range(4):
        for d in {i for i, _ in tokens}:
            each = {}
            for _, pos, q in (x for x in asked if x[0] == a):
                near = [float(multivector.similarity(metric, np.array([q]), np.array([v]))[0, 0]) for i, v in tokens if i == d and v is not None and len(v) == 4]
                if near:
                    each[pos] = max([*near, each.get(pos, -math.inf)])
            want[a, d] = round(sum(each.values()), 6) if each else None
    got = {(r["query_id"], r["id"]): r["score"] for r in multivector.maxsim(rows, queries, metric).collect()}
    assert got.keys() == want.keys() and all(got[p] == want[p] or got[p] == pytest.approx(want[p], abs=1.1e-6) for p in want)


def test_late_interaction_makes_no_pairs(spark):
    plan = catalog.QUERIES["maxsim_l2"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_signatures_of_all_pairs(spark, monkeypatch):
    """Sizes that differ, nulls, in parts and slices; and no row is a pair of signatures."""
    from vexel.operators import lsh

    for name, value in {"PART": 3, "SLICE": 2, "EMITTED": 4}.items():
        monkeypatch.setattr(lsh, name, value)
    rng = np.random.default_rng(3)
    sigs = [(i, [f"x{n}" for n in rng.integers(0, 3, 4)]) for i in range(9)] + [(9, ["x0", None]), (10, None), (11, []), (12, [None, None])]
    rows = spark.createDataFrame(sigs, "id long, sig array<string>")
    joined = rows.crossJoin(rows.select(F.col("id").alias("query_id"), F.col("sig").alias("q")))
    want = {tuple(r) for r in joined.select("query_id", "id", search.rounded(D.minhash_distance("sig", "q"))).collect()}
    assert {tuple(r) for r in lsh.distances(rows, rows).collect()} == {(a, b, 1.0 if d is None else d) for a, b, d in want}
    assert not re.search(r"\bq#\d", catalog.QUERIES["minhash_jaccard"](spark, SF)._jdf.queryExecution().executedPlan().toString())
