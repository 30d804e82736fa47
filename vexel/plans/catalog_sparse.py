"""Queries over text, sparse, hashed and multi-vector data. Text queries are the benchmark's items, against all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lsh, multivector, sparse
from ..sources.scratch import staged
from .inputs import POSTINGS, V, fold, ranked, rounded, sql_distance, text_queries, vectors, words

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
K = 10
_DOT = f"WITH {POSTINGS}, s AS (SELECT query_id, id, round(sum(qw * {{w}}), 6) AS score FROM {{p}} JOIN {{q}} USING (term) GROUP BY ALL)"
_BEST = ranked("s", K, "query_id, rank, id, score", "score DESC, id").replace("FROM s)", "FROM s WHERE score > 0)")


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    asked = sparse.terms(text_queries(spark, sf)).select(F.col("id").alias("query_id"), "term", F.col("w").alias("qw"))
    return sparse.terms(words(spark, sf)), asked


@query("sparse_dot", _DOT.format(w="w", p="p", q="q") + " SELECT * FROM s")
def sparse_dot(spark, sf):
    return sparse.dot(*_sides(spark, sf))


@query("sparse_ip_knn", _DOT.format(w="w", p="p", q="q") + " " + _BEST)
def sparse_ip_knn(spark, sf):
    return sparse.best(sparse.dot(*_sides(spark, sf)), K)


_NORMS = "n AS (SELECT id, term, w / norm AS w FROM p JOIN (SELECT id, sqrt(sum(w * w)) AS norm FROM p GROUP BY id) USING (id)), nq AS (SELECT query_id, term, qw / norm AS qw FROM q JOIN (SELECT query_id, sqrt(sum(qw * qw)) AS norm FROM q GROUP BY query_id) USING (query_id))"


@query("sparse_cosine", _DOT.replace(", s AS", f", {_NORMS}, s AS").format(w="w", p="n", q="nq") + " SELECT * FROM s WHERE score > 0")
def sparse_cosine(spark, sf):
    return sparse.cosine(*_sides(spark, sf)).where("score > 0")


@query("sparse_cosine_knn", _DOT.replace(", s AS", f", {_NORMS}, s AS").format(w="w", p="n", q="nq") + " " + _BEST)
def sparse_cosine_knn(spark, sf):
    return sparse.cosine_search(*_sides(spark, sf), K)


_BM25 = """l AS (SELECT id, sum(abs(w)) AS dl FROM p GROUP BY id), a AS (SELECT avg(dl) AS avgdl, count(*) AS n FROM l), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT id, term, w, dl, avgdl FROM p JOIN l USING (id), a), bq AS (SELECT query_id, term, qw * ln((n - df + 0.5) / (df + 0.5) + 1) AS qw FROM q JOIN f USING (term), a)"""


@query("bm25_knn", _DOT.replace(", s AS", f", {_BM25}, s AS").format(w="w * 2.2 / (w + 1.2 * (0.25 + 0.75 * dl / avgdl))", p="b", q="bq") + " " + _BEST)
def bm25_knn(spark, sf):
    return sparse.bm25_search(*_sides(spark, sf), K)


@query("sparse_bm25_v2", _DOT.replace(", s AS", ", l AS (SELECT id, sum(w) AS dl FROM p GROUP BY id), b AS (SELECT id, term, w, dl FROM p JOIN l USING (id)), s AS").format(w="w * 2.5 / (w + 1.5 * (0.25 + 0.75 * dl / 100.0))", p="b", q="q") + " " + _BEST)
def sparse_bm25_v2(spark, sf):
    return sparse.bm25_fixed(*_sides(spark, sf), K)


@query("sparse_ip_filled", _DOT.format(w="w", p="p", q="q") + f", e AS (SELECT query_id, id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM q) CROSS JOIN (SELECT DISTINCT id FROM p) LEFT JOIN s USING (query_id, id)) " + ranked("e", 50, "query_id, rank, id, score", "score DESC, id"))
def sparse_ip_filled(spark, sf):
    postings, asked = _sides(spark, sf)
    postings = staged(spark, postings, "postings")
    return sparse.filled(sparse.dot(postings, asked), postings, asked, 50)


@query("sparse_drop_ratio", f"WITH {POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(qw) DESC, term) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM q) SELECT query_id, term, qw FROM r WHERE r <= ceil(n * (1 - 0.3))")
def sparse_drop_ratio(spark, sf):
    return sparse.drop_terms(_sides(spark, sf)[1], 0.3)


@query("sparse_drop_ratio_v2", f"WITH {POSTINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY abs(qw), term) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM q), l AS (SELECT query_id, abs(qw) AS least FROM r WHERE r = floor(n * 0.6) + 1) SELECT query_id, term, qw FROM q JOIN l USING (query_id) WHERE abs(qw) >= least")
def sparse_drop_ratio_v2(spark, sf):
    return sparse.drop_small(_sides(spark, sf)[1], 0.6)


@query("tfidf_encode", f"WITH {POSTINGS}, f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(DISTINCT id) AS n FROM p) SELECT id, term, round(w * (ln((n + 1.0) / (df + 1)) + 1), 6) AS w FROM p JOIN f USING (term), n")
def tfidf_encode(spark, sf):
    return sparse.tfidf(_sides(spark, sf)[0])


@query("sparse_get_by_id", f"WITH {POSTINGS} SELECT id, CAST(count(*) AS BIGINT) AS n_terms, list(term ORDER BY term) AS terms FROM p WHERE id % 100 = 0 GROUP BY id")
def sparse_get_by_id(spark, sf):
    postings = sparse.terms(words(spark, sf).where("id % 100 = 0"))
    return postings.groupBy("id").agg(F.count("*").alias("n_terms"), F.array_sort(F.collect_list("term")).alias("terms"))


# MinHash

_HASHES = ", ".join(f"min(md5('{i}:' || item)) AS h{i}" for i in range(16))
_SIGS = f"""i AS (SELECT DISTINCT doc_id AS id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS item FROM documents), h AS (SELECT id, {_HASHES} FROM i WHERE item <> '' GROUP BY id),
g AS (SELECT id, [{', '.join(f'h{i}' for i in range(16))}] AS sig FROM h)"""
_BANDS = "b AS (SELECT id, CAST(b AS INT) AS band, md5(array_to_string(list_slice(sig, b * 4 + 1, b * 4 + 4), '|')) AS key FROM g, range(0, 4) t(b))"
_CAND = "c AS (SELECT q.id AS query_id, b.id, CAST(count(*) AS BIGINT) AS n_bands FROM b JOIN (SELECT * FROM b WHERE id % 100 = 0) q USING (band, key) GROUP BY ALL)"
_JAC = "1 - list_sum(list_transform(list_zip(x.sig, y.sig), lambda z: CASE WHEN z[1] = z[2] THEN 1 ELSE 0 END)) / 16.0"


def _sigs(spark, sf) -> DataFrame:
    items = words(spark, sf).select("id", F.explode(F.array_distinct(F.split(F.lower("text"), sparse.TERMS))).alias("item")).where("item <> ''")
    return staged(spark, lsh.signatures(items), "signatures")


@query("lsh_band_keys", f"WITH {_SIGS}, {_BANDS} SELECT * FROM b")
def lsh_band_keys(spark, sf):
    return lsh.bands(_sigs(spark, sf))


@query("lsh_candidates", f"WITH {_SIGS}, {_BANDS}, {_CAND} SELECT * FROM c")
def lsh_candidates(spark, sf):
    keys = lsh.bands(_sigs(spark, sf))
    return lsh.candidates(keys, keys.where("id % 100 = 0"))


@query("minhash_jaccard", f"WITH {_SIGS} SELECT x.id AS query_id, y.id, {rounded(_JAC)} AS distance FROM g x, g y WHERE x.id % 100 = 0")
def minhash_jaccard(spark, sf):
    sigs = _sigs(spark, sf)
    return lsh.distances(sigs, sigs.where("id % 100 = 0"))


@query("lsh_jaccard_knn", f"WITH {_SIGS}, {_BANDS}, {_CAND}, s AS (SELECT query_id, c.id, {rounded(_JAC)} AS distance FROM c JOIN g x ON x.id = query_id JOIN g y ON y.id = c.id) {ranked('s', K)}")
def lsh_jaccard_knn(spark, sf):
    sigs = _sigs(spark, sf)
    keys = lsh.bands(sigs)
    return lsh.jaccard_search(lsh.candidates(keys, keys.where("id % 100 = 0")), sigs, sigs.where("id % 100 = 0"), K)


@query("bloom_params", "SELECT lang, CAST(ceil(-count(*) * ln(0.01) / (ln(2) * ln(2))) AS BIGINT) AS bits FROM documents GROUP BY lang")
def bloom_params(spark, sf):
    from .inputs import read

    return read(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")).select("lang", lsh.bloom_size(F.col("n"), 0.01).cast("long").alias("bits"))


# several vectors a document

_TOK = f"WITH {V}, t AS (SELECT id // 5 AS id, id AS pos, vec FROM v), q AS (SELECT id AS query_id, pos, vec AS q FROM t WHERE id % 100 = 0)"


def _sims() -> dict[str, str]:
    both, either = "CASE WHEN z[1] >= 0 AND z[2] >= 0 THEN 1 ELSE 0 END", "CASE WHEN z[1] >= 0 OR z[2] >= 0 THEN 1 ELSE 0 END"
    size = f"(greatest(sqrt({fold('vec', 'vec', 'z[1] * z[2]')}), 1e-8) * greatest(sqrt({fold('q', 'q', 'z[1] * z[2]')}), 1e-8))"
    return {
        "ip": fold("vec", "q", "z[1] * z[2]"), "cosine": f"{fold('vec', 'q', 'z[1] * z[2]')} / {size}", "l2": f"-({sql_distance('l2_sq', 'vec', 'q')})",
        "hamming": f"CAST(2 * {fold('vec', 'q', 'CASE WHEN (z[1] >= 0) = (z[2] >= 0) THEN 1 ELSE 0 END')} - len(vec) AS DOUBLE)",
        "jaccard": f"CASE WHEN {fold('vec', 'q', either)} = 0 THEN 1 ELSE {fold('vec', 'q', both)} / CAST({fold('vec', 'q', either)} AS DOUBLE) END",
    }


def _maxsim_sql(metric: str) -> str:
    return f"{_TOK}, e AS (SELECT query_id, id, q.pos, max({rounded(_sims()[metric])}) AS s FROM t CROSS JOIN q GROUP BY ALL), s AS (SELECT query_id, id, round(sum(s), 6) AS score FROM e GROUP BY ALL)".replace("t.pos", "pos").replace("SELECT query_id, id, q.pos", "SELECT query_id, t.id, q.pos")


def _tokens(spark, sf):
    tokens = vectors(spark, sf).select(F.expr("id div 5").alias("id"), F.col("id").alias("pos"), "vec")
    return tokens.select("id", "vec"), tokens.where("id % 100 = 0").select(F.col("id").alias("query_id"), "pos", F.col("vec").alias("q"))


for _metric in ("ip", "cosine", "l2", "hamming", "jaccard"):

    @query(f"maxsim_{_metric}", _maxsim_sql(_metric) + " SELECT * FROM s")
    def _maxsim(spark, sf, metric=_metric):
        return multivector.maxsim(*_tokens(spark, sf), metric)


@query("multivec_knn", _maxsim_sql("ip") + " " + ranked("s", K, "query_id, rank, id, score", "score DESC, id"))
def multivec_knn(spark, sf):
    return multivector.search(*_tokens(spark, sf), K)


@query("multivec_by_ids", _maxsim_sql("ip") + ", w AS (SELECT 1000000 - d AS ord, d * 3 AS id FROM (SELECT DISTINCT id AS d FROM t)) SELECT c.query_id, ord, w.id, score FROM w CROSS JOIN (SELECT DISTINCT query_id FROM q) c LEFT JOIN s ON s.id = w.id AND s.query_id = c.query_id")
def multivec_by_ids(spark, sf):
    tokens, asked = _tokens(spark, sf)
    wanted = tokens.select("id").distinct().select((1000000 - F.col("id")).alias("ord"), (F.col("id") * 3).alias("id"))
    return multivector.by_ids(tokens, asked, wanted)
