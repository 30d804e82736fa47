"""Literal fixtures, quantizer invariants, the index facade, sources and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel import api
from vexel.functions import distances as D
from vexel.operators import cluster, evaluate, filters, graph, lsh, multivector, quantize, search, sparse
from vexel.plans import catalog
from vexel.sources import files
from vexel.streaming import ingest
from vexel.types import IndexConfig, Metric, adaptive_ef, is_legal


def one(spark, expr, **arrays):
    row = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<{'long' if isinstance(v[0], int) else 'double'}>" for k, v in arrays.items()))
    return row.select(expr.alias("x")).first()[0]


def test_distances(spark):
    assert one(spark, D.l2("a", "b"), a=[0.0, 0.0], b=[3.0, 4.0]) == 5.0
    assert one(spark, D.cosine("a", "b"), a=[0.0, 0.0], b=[1.0, 0.0]) == 0.0
    assert one(spark, D.distance("cosine", "a", "b"), a=[0.0, 0.0], b=[1.0, 0.0]) == 1.0
    assert one(spark, D.hamming("a", "b"), a=[0xF0], b=[0x0F]) == 8
    assert one(spark, D.jaccard("a", "b"), a=[3], b=[6]) == pytest.approx(1 / 3)
    assert one(spark, D.jaccard("a", "b"), a=[0], b=[0]) == 1.0
    assert one(spark, D.minhash_distance("a", "b"), a=[1, 2, 3, 4], b=[1, 2, 9, 9]) == 0.5
    assert one(spark, D.median_bits("a"), a=[1.0, 4.0, 2.0, 3.0]) == [2]
    assert [(r["term"], r["w"]) for r in one(spark, D.to_sparse("a", 0.5), a=[1.0, 0.0, 2.0, 0.0, 3.0])] == [(0, 1), (2, 2), (4, 3)]
    assert one(spark, D.sign_bits("a"), a=[-1.0] * 63 + [1.0, 1.0]) == [-(2**63), 1]


def test_dtw():
    line = lambda *x: np.array(x, float)[:, None]
    assert D.dtw(line(1, 2, 3), line(1, 2, 2, 3)) == 0
    assert D.dtw(line(1, 2, 3), line(1, 2, 2, 3), window=0) == math.inf
    assert D.dtw(line(1, 2), line()) == math.inf
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(7, 2)), rng.normal(size=(9, 2))

    def brute(i, j):
        if i < 0 or j < 0:
            return 0.0 if i == j == -1 else math.inf
        return math.dist(a[i], b[j]) + min(brute(i - 1, j), brute(i, j - 1), brute(i - 1, j - 1))

    assert D.dtw(a, b) == pytest.approx(brute(6, 8))
    assert D.dtw(line(1), line(4)) == 3 and D.dtw(line(1, 2, 3, 4), line(2)) == 1 + 0 + 1 + 2
    assert D.dtw(a, b, slope=2.0) >= D.dtw(a, b) and D.dtw(a, b, window=20) == pytest.approx(D.dtw(a, b))


@pytest.mark.parametrize("cost", ["l2", "ip", "cosine"])
def test_dtw_of_many(cost):
    """All pairs side by side are what pairs are one by one, in bands and slopes too."""
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (1, 6), (7, 4), (9, 9), (3, 11), (0, 4)):
        a, b = rng.integers(-3, 4, (5, n)).astype(float), rng.normal(size=(6, m))
        for window, slope in ((None, None), (0, None), (2, None), (None, 2.0), (3, 1.5), (None, 0.5)):
            want = [[D.dtw(x[:, None], y[:, None], cost, window, slope) for y in b] for x in a]
            assert np.allclose(D.dtw_many(a, b, cost, window, slope, pairs=4), want, rtol=1e-12, atol=1e-12)


def test_warping_makes_no_pairs_first(spark):
    plan = catalog.QUERIES["dtw_l2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_half_precision_rounding():
    x = np.array([1.0, 1.00390625, 1.01171875, -3.3, 65504.0], np.float32)
    assert D.round_half(x, "bfloat16").tolist()[:3] == [1.0, 1.0, 1.015625]
    assert (D.round_half(x, "float16") == x.astype(np.float16).astype(np.float32)).all()


def test_scalar_codes(spark):
    assert one(spark, quantize.sq_encode("a", 0.0, 1.0), a=[0.0, 0.5, 1.0]) == [0, 128, 255]
    assert one(spark, quantize.pack_nibbles("a"), a=[1, 2]) == [0x21]
    assert quantize.Scalar(0.0, 1.0).encode(np.array([[0.0, 0.5, 1.0]])).tolist() == [[0, 128, 255]]


ROWS = np.random.default_rng(1).normal(size=(400, 32))


@pytest.mark.parametrize("model", [
    quantize.Scalar.fit(ROWS), quantize.Scalar.fit(ROWS, 4), quantize.Product.fit(ROWS, 8, 5), quantize.Rotated.fit(ROWS, 8, 5, 2), quantize.Residual.fit(ROWS, 3, 5),
    quantize.Residual.fit_coarse(ROWS, 8, 8, 5), quantize.Split.fit(ROWS, 4, 2, 4), quantize.Uniform.fit(ROWS), quantize.Uniform.fit(ROWS, 1), quantize.Affine.fit(ROWS), quantize.Turbo.fit(ROWS),
    quantize.Turbo.fit(ROWS, signs=True), quantize.Principal.fit(ROWS, 24), quantize.Half("bfloat16"),
])
def test_quantizers(model):
    codes = model.encode(ROWS)
    assert codes.dtype == np.uint8 and (model.encode(ROWS) == codes).all()
    back = model.decode(codes)
    assert ((back - ROWS) ** 2).sum() < 0.75 * ((ROWS - ROWS.mean(0)) ** 2).sum()


def test_rotation_keeps_norms():
    turn = quantize.rotation(24)
    assert np.allclose(turn @ turn.T, np.eye(24)) and (quantize.rotation(24) == turn).all()


def test_levels_of_the_normal_distribution():
    assert np.allclose(quantize.gaussian_levels(1), [-0.7979, 0.7979], atol=1e-2)
    assert np.allclose(quantize.gaussian_levels(2), [-1.510, -0.4528, 0.4528, 1.510], atol=1e-2)


def test_kmeans():
    rng = np.random.default_rng(0)
    truth = rng.normal(size=(5, 8)) * 20
    rows = np.concatenate([c + rng.normal(size=(50, 8)) for c in truth])
    for options in ({}, {"batch": 64}, {"rounds": 5}):
        found = cluster.kmeans(rows, 5, **options)
        assert D.matrix_distance("l2", truth, found).min(1).max() < 2
    assert np.allclose(np.linalg.norm(cluster.kmeans(rows, 5, spherical=True), axis=1), 1)
    assert len(cluster.kmeans(rows[:3], 5)) == 5


POINTS = [(100, [0.0, 0.0]), (200, [1.0, 0.0]), (300, [2.0, 0.0]), (400, [3.0, 0.0])]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id long, vec array<double>"), spark.createDataFrame([(1, [0.0, 0.0])], "query_id long, q array<double>")


def hits(df):
    return [(r["id"], r["distance"]) for r in df.orderBy("query_id", "rank").collect()]


def test_search(spark, points):
    base, query = points
    for find in (search.knn, search.knn_blocks):
        assert hits(find(base, query, 3)) == [(100, 0), (200, 1), (300, 2)]
        assert hits(find(search.excluding(base, base.where("id = 200")), query, 3)) == [(100, 0), (300, 2), (400, 3)]
        assert hits(find(base, query, 30)) == [(i, v[0]) for i, v in POINTS]
    assert sorted(r["id"] for r in search.range_search(base, query, 1.5).collect()) == [100, 200]
    many = spark.range(5000).select(F.col("id").alias("query_id"), F.array(F.col("id") / 1000.0, F.lit(0.0)).alias("q"))
    assert search.knn(base, many, 1).count() == 5000 and search.in_blocks(many, base.crossJoin).count() == 20_000


def test_radius_is_monotone(spark):
    base = spark.range(500).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (F.col("id") * 8 + i) * 0.01 % 5).alias("vec"))
    query = spark.createDataFrame([(0, [0.0] * 8)], "query_id long, q array<double>")
    found = [{r["id"] for r in search.range_search(base, query, r).collect()} for r in (2.0, 5.0, 9.0)]
    assert found[0] < found[1] <= found[2]


def test_filters(spark):
    rows = spark.createDataFrame([(1, 5, "a"), (2, None, "b")], "id long, x int, s string")
    keep = lambda tree: [r["id"] for r in filters.scan(rows, tree).collect()]
    assert keep(("not", ("eq", "x", 5))) == [2] and keep(("eq", "missing", 1)) == [] and keep(("not", ("eq", "missing", 1))) == [1, 2]
    assert keep(("eq", "x", "5")) == [] and keep(("in", "s", ["b", "c"])) == [2] and keep(("lt", "x", 6.5)) == [1]


def test_text(spark):
    docs = spark.createDataFrame([(1, 0, 1.0), (1, 2, 2.0), (1, 4, 3.0)], "id long, term int, w double")
    asked = spark.createDataFrame([(9, 1, 1.0), (9, 2, 2.0), (9, 3, 3.0)], "query_id long, term int, qw double")
    assert sparse.dot(docs, asked).first()["score"] == 4
    three = spark.createDataFrame([(1, "a", 1.0), (2, "b", 1.0), (3, "b", 1.0)], "id long, term string, w double")
    assert sparse.tfidf(three).where("term = 'a'").first()["w"] == pytest.approx(math.log(2) + 1, abs=1e-6)


def test_late_interaction(spark):
    tokens = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.5, 0.5])], "id long, vec array<double>")
    asked = spark.createDataFrame([(7, 0, [1.0, 0.0]), (7, 1, [0.0, 1.0])], "query_id long, pos long, q array<double>")
    assert multivector.maxsim(tokens, asked).first()["score"] == 1.5
    wanted = spark.createDataFrame([(0, 5), (1, 1)], "ord long, id long")
    assert [r["score"] for r in multivector.by_ids(tokens, asked, wanted).orderBy("ord").collect()] == [None, 1.5]


def test_bloom():
    bloom = lsh.Bloom(1000, 0.01)
    for i in range(1000):
        bloom.add(b"%d" % i)
    assert all(b"%d" % i in bloom for i in range(1000))
    assert sum(b"x%d" % i in bloom for i in range(5000)) < 150 and 900 < bloom.cardinality() < 1100


def test_beam_walks_a_grid():
    vec = np.array([(x, y) for x in range(16) for y in range(16)], float)
    near = [np.flatnonzero(np.abs(vec - v).sum(1) == 1) for v in vec]
    for start in (0, 200):
        found = graph.beam(vec, near, np.array([7.2, 9.1]), 32, 4, start=(start,))
        assert found[0][1] == 7 * 16 + 9 and len(found) == 4


def test_recall_and_rules(spark):
    result = spark.createDataFrame([(0, r, i) for r, i in enumerate([1, 2, 3], 1)], "query_id long, rank long, id long")
    truth = spark.createDataFrame([(0, r, i) for r, i in enumerate([1, 3, 5], 1)], "query_id long, rank long, id long")
    assert evaluate.recall_at_k(result, truth, 3).first()["recall"] == pytest.approx(2 / 3)
    assert search.scan_is_better(100, 95, 1) and search.scan_is_better(100, 0, 50) and not search.scan_is_better(1000, 10, 10)
    assert adaptive_ef(64, 10) == 64 and adaptive_ef(64, 100) == 200 and adaptive_ef(64, 10, 300) == 300


@pytest.mark.parametrize("kind,dtype,metric,legal", [("flat", "float", "l2", True), ("bin_flat", "binary", "hamming", True), ("bin_flat", "binary", "l2", False), ("ivf_usq", "float", "ip", False),
    ("hnsw", "int8", "cosine", True), ("hnsw", "binary", "hamming", True), ("diskann", "int8", "l2", False), ("sparse_wand", "sparse_float", "ip", True), ("annoy", "float", "l2", False)])
def test_legality(kind, dtype, metric, legal):
    assert is_legal(kind, dtype, metric) is legal


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 16)) * 3
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16)], i % 5) for i in range(1200)]
    base = spark.createDataFrame(rows, "id long, vec array<double>, label int").cache()
    return base, base.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))


def same(a, b):
    key = lambda df: sorted(tuple(r) for r in df.select("query_id", "rank", "id", "distance").collect())
    return key(a) == key(b)


@pytest.mark.parametrize("kind", ["flat", "ivf_flat", "ivf_sq8", "ivf_pq", "ivf_usq", "ivf_turboquant", "hnsw", "hnsw_sq", "hnsw_pq", "hnsw_prq", "scann", "diskann"])
def test_index(spark, cloud, kind, tmp_path):
    base, asked = cloud
    index = api.index(spark, kind, 16, nlist=12, nprobe=6, m=8, nbits=6, rerank=4)
    if kind != "flat":
        with pytest.raises(api.NotTrained):
            index.add(base)
    index.train(base).add(base.where("id < 700")).add(base.where("id >= 700"))
    truth = search.knn(base, asked, 10)
    assert evaluate.recall_micro(index.search(asked, 10), truth, 10).first()[0] >= 0.9
    found = index.search(asked, 10, where=F.col("label") == 1).join(base, "id")
    assert found.count() == 10 * asked.count() and found.where("label <> 1").count() == 0
    near = sorted((r["query_id"], r["id"]) for r in index.range_search(asked, 5.0).collect())
    assert near == sorted((r["query_id"], r["id"]) for r in search.range_search(base, asked, 5.0).collect())
    index.remove(base.where("id % 2 = 0"))
    assert index.count == 600 and index.search(asked, 5).where("id % 2 = 0").count() == 0
    index.save(str(tmp_path / kind))
    again = api.VectorIndex.load(spark, str(tmp_path / kind))
    assert again.count == 600 and again.config == index.config
    assert same(index.search(asked, 10), again.search(asked, 10))
    assert evaluate.recall_micro(again.search(asked, 10), search.knn(base.where("id % 2 = 1"), asked, 10), 10).first()[0] >= 0.9
    wanted = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "ord long, id long")
    back = {r["id"]: np.array(r["vec"]) for r in again.reconstruct(wanted).collect()}
    real = {r["id"]: np.array(r["vec"]) for r in base.where("id < 4").collect()}
    assert set(back) == {1, 3} and all(((back[i] - real[i]) ** 2).sum() < 0.3 * (real[i] ** 2).sum() for i in back)
    assert [r["found"] for r in again.has_id(wanted).orderBy("id").collect()] == [True, False, True]


@pytest.mark.parametrize("kind", ["bin_flat", "bin_ivf_flat", "bin_hnsw"])
def test_binary_index(spark, cloud, kind, tmp_path):
    base, _ = cloud
    base = base.select("id", "label", F.array_append(D.sign_bits("vec"), F.col("id") % 7).alias("vec")).cache()
    asked = base.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))
    index = api.index(spark, kind, 128, "hamming", nlist=8, nprobe=6).train(base).add(base)
    truth = search.knn(base, asked, 10, "hamming")
    worst = {r["query_id"]: r["distance"] for r in truth.where("rank = 10").collect()}
    found = index.search(asked, 10).collect()
    assert sum(r["distance"] <= worst[r["query_id"]] for r in found) >= 0.9 * 10 * asked.count()  # ties are many
    assert same(index.search(asked, 10), truth) or kind != "bin_flat"
    index.save(str(tmp_path / kind))
    assert same(index.search(asked, 5), api.VectorIndex.load(spark, str(tmp_path / kind)).search(asked, 5))


def test_block_search_is_exact(spark):
    """Many equal rows, rows that cancel, an empty query table, metrics that there aren't."""
    base = spark.createDataFrame([(i, [1e6, 1e6 + (i % 3) * 1e-4]) for i in range(200)], "id long, vec array<double>").coalesce(1)
    asked = spark.createDataFrame([(0, [1e6, 1e6]), (1, [0.0, 1.0])], "query_id long, q array<double>")
    assert same(search.knn_blocks(base, asked, 10), search.knn(base, asked, 10))
    assert [r["id"] for r in search.knn_blocks(base, asked, 10).where("query_id = 0").orderBy("rank").collect()] == list(range(0, 30, 3))
    codes, model = quantize.encoded(base, quantize.Scalar(0.0, 1.0)), quantize.Scalar(0.0, 1.0)
    assert [r["id"] for r in quantize.code_search(codes, asked, model, 5).where("query_id = 1").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    for metric in ("l1", "linf", "cosine", "ip"):
        assert same(search.knn_blocks(base, asked, 7, metric), search.knn(base, asked, 7, metric))
    none = asked.limit(0)
    stored = graph.build(base.withColumn("list", F.lit(0)))
    for empty in (search.knn_blocks(base, none, 3), quantize.code_search(codes, none, model, 3), graph.walk(stored, none, 3),
        quantize.ivf_code_search(codes.withColumn("list", F.lit(0)), none, np.zeros((1, 2)), model, 3, 1)):
        assert empty.count() == 0
    with pytest.raises(ValueError):
        D.matrix_distance("chebyshov", np.zeros((1, 2)), np.zeros((1, 2)))


def test_graph_cells_are_bounded(spark, monkeypatch):
    """A list of many equal rows is cut into parts, and nothing is lost."""
    monkeypatch.setattr(graph, "CELL", 100)
    base = spark.range(1000).select(F.lit(0).alias("list"), "id", F.array(F.lit(1.0), (F.col("id") >= 900).cast("double")).alias("vec"))
    stored = graph.build(base, 4).cache()
    assert stored.groupBy("list", "part").count().agg(F.max("count")).first()[0] < 200 and stored.count() == 1000
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, q array<double>")
    assert [r["distance"] for r in graph.walk(stored, asked, 20).collect()] == [0.0] * 20
    live = base.where("id >= 890")
    assert graph.walk(stored, asked, 5, live=live).where("id < 890").count() == 0


def test_more_probes_never_lower_recall(spark, cloud):
    base, asked = cloud
    index = api.index(spark, "ivf_flat", 16, nlist=12).train(base).add(base)
    truth = search.knn(base, asked, 10)
    recall = [evaluate.recall_micro(index.search(asked, 10, nprobe=n), truth, 10).first()[0] for n in (1, 4, 12)]
    assert recall == sorted(recall) and recall[-1] == 1.0
    page = index.iterate(asked, 6, 5, excluded=base.where("id < 100"))
    assert page.count() == 5 * asked.count() and {r["rank"] for r in page.collect()} == set(range(6, 11))


def test_other_indexes(spark):
    postings = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "b", 1.0), (3, "c", 1.0)], "id long, term string, w double")
    asked = spark.createDataFrame([(9, "b", 1.0)], "query_id long, term string, qw double")
    for metric, best in (("ip", 1), ("cosine", 2), ("bm25", 2), ("bm25_fixed", 1)):
        index = api.SparseIndex(postings, metric)
        assert [r["id"] for r in index.search(asked, 5).orderBy("rank").collect()] == [best, 3 - best]
        assert [r["id"] for r in index.search(asked, 5, excluded=postings.where("id = 1")).collect()] == [2]
    assert index.get(spark.createDataFrame([(1,)], "id long")).count() == 2
    sets = spark.createDataFrame([(i, f"x{j}") for i in range(4) for j in range(20 + i)] + [(9, f"y{j}") for j in range(20)], "id long, item string")
    near = api.MinHashIndex(sets).search(sets.where("id = 0"), 3)
    assert near.where("rank = 1").first()["id"] == 0 and near.where("id = 9").count() == 0
    tokens = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, vec array<double>")
    query = spark.createDataFrame([(0, 0, [1.0, 0.1])], "query_id long, pos long, q array<double>")
    assert [r["id"] for r in api.MultiVectorIndex(tokens).search(query, 2).orderBy("rank").collect()] == [1, 2]


def test_stored_sets(spark, tmp_path):
    sets = spark.createDataFrame([(i, f"x{j}") for i in range(4) for j in range(20 + i)], "id long, item string")
    index = api.MinHashIndex(size=32, rows=2).add(sets.where("id < 2")).add(sets.where("id >= 2"))
    index.save(str(tmp_path / "m"))
    again = api.MinHashIndex.load(spark, str(tmp_path / "m"))
    assert (again.size, again.rows, again.count) == (32, 2, 4) and again.get(sets.where("id = 3")).count() == 1
    assert same(index.search(sets.where("id = 0"), 3), again.search(sets.where("id = 0"), 3))


def test_impatient_walk():
    vec = np.array([(x, y) for x in range(30) for y in range(30)], float)
    near = [np.flatnonzero(np.abs(vec - v).sum(1) == 1) for v in vec]
    steps = graph.beam(vec, near, np.array([15.0, 15.0]), 400, 4, start=(15 * 30 + 14,), patience=3)
    assert steps[0] == (0.0, 15 * 30 + 15) and len(steps) == 4


def test_paired_projections():
    rows, asked = ROWS, ROWS[:50] + 1.0
    of_rows, of_asked = quantize.fit_pair(rows, asked, 8)
    assert np.allclose(of_rows.project(rows).mean(0), 0) and np.allclose(of_asked.project(asked).mean(0), 0) and of_asked.axes.shape == (8, 32)


def test_registry(spark):
    registry = api.Registry(spark)
    registry.create("a", IndexConfig("flat", 2, Metric.parse("Euclidean")))
    with pytest.raises(ValueError):
        registry.create("a", IndexConfig("flat", 2))
    with pytest.raises(ValueError):
        IndexConfig("bin_flat", 8, "l2")
    words = registry.create("w", IndexConfig("sparse_wand", 8, "ip", "sparse_float")).add(spark.createDataFrame([(1, "a", 1.0)], "id long, term string, w double"))
    assert words.search(spark.createDataFrame([(0, "a", 2.0)], "query_id long, term string, qw double"), 3).first()["score"] == 2.0
    registry.drop("a")
    registry.drop("w")
    assert registry.names() == []


@pytest.mark.parametrize("kind", sorted(files.KINDS))
def test_vector_files(spark, kind, tmp_path):
    rows = np.arange(24, dtype=files.KINDS[kind]).reshape(6, 4)
    (tmp_path / f"x.{kind}").write_bytes(files.encode(rows, kind))
    got = files.read_vectors(spark, str(tmp_path), kind, 4).orderBy("pos").collect()
    assert [r["vec"] for r in got] == rows.tolist() and [r["pos"] for r in got] == list(range(6))
    if kind == "fvecs":
        for part, suffix in (("base", "fvecs"), ("query", "fvecs"), ("groundtruth", "ivecs")):
            (tmp_path / f"toy_{part}.{suffix}").write_bytes(files.encode(rows, suffix))
        assert {k: v.count() for k, v in files.load_bundle(spark, str(tmp_path), "toy").items()} == {"base": 6, "queries": 6, "truth": 24}
    if kind == "ivecs":
        assert files.truth_table(files.read_vectors(spark, str(tmp_path), kind)).where("rank = 1").count() == 6
    with pytest.raises(ValueError):
        files.decode(b"\1\0\0\0\0", "fvecs")


def test_stream(spark, cloud, tmp_path):
    base, asked = cloud
    for i in range(3):
        base.where(F.col("id") % 3 == i).select("id", "vec").write.mode("append").parquet(str(tmp_path / "in"))
    lists = cluster.kmeans(cluster.sampled(base), 12)
    stream = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.append_lists(stream, str(tmp_path / "out"), str(tmp_path / "check"), lists).awaitTermination()
    stored = ingest.read_lists(spark, str(tmp_path / "out"))
    assert stored.count() == 1200
    found = cluster.ivf_search(stored, asked, cluster.as_table(spark, lists), 10, 12)
    assert evaluate.recall_micro(found, search.knn(base, asked, 10), 10).first()[0] == 1.0


def test_plans(spark):
    """Ranks are limited before the shuffle, and scans read the columns that they need."""
    plan = catalog.QUERIES["knn_flat_l2"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "BroadcastNestedLoopJoin" in plan
    assert "text" not in catalog.QUERIES["filter_expr_eq"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
