"""Sparse and text retrieval over postings (id, term, w). A query side is broadcast in blocks, so hot terms aren't shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged
from .search import in_blocks, top

TERMS = r"[ \n]+"


def terms(texts: DataFrame) -> DataFrame:
    """(id, text) to (id, term, w): how often each lower-cased word occurs."""
    each = texts.select("id", F.explode(F.split(F.lower("text"), TERMS)).alias("term")).where("term <> ''")
    return each.groupBy("id", "term").agg(F.count("*").cast("double").alias("w"))


def dot(postings: DataFrame, queries: DataFrame, weight: Column | None = None) -> DataFrame:
    """query_id, id, score: sums over shared terms of qw * weight (w unless given). queries: (query_id, term, qw)."""
    weight = F.col("w") if weight is None else weight
    joined = in_blocks(queries, lambda q: postings.join(q, "term"), 200_000)
    return joined.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qw") * weight), 6).alias("score"))


def best(scored: DataFrame, k: int) -> DataFrame:
    """The k highest positive scores of each query; ties go to the smaller id."""
    return top(scored.where("score > 0").withColumn("distance", -F.col("score")), k).select("query_id", "rank", "id", "score")


def normalised(postings: DataFrame, w: str = "w", key: str = "id") -> DataFrame:
    """Postings divided by their document's norm; documents whose norm is next to nothing get zeros."""
    norms = postings.groupBy(key).agg(F.sqrt(F.sum(F.col(w) * F.col(w))).alias("norm"))
    return postings.join(norms, key).withColumn(w, F.when(F.col("norm") > 1.1920929e-07, F.col(w) / F.col("norm")).otherwise(0.0)).drop("norm")


def matched(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, term, qw, w of shared terms; only these are joined with what is known of their documents."""
    return in_blocks(queries, lambda q: postings.join(q, "term"), 200_000).select("query_id", "id", "term", "qw", "w")


def summed(scored: DataFrame, weight: Column) -> DataFrame:
    return scored.groupBy("query_id", "id").agg(F.round(F.sum(F.col("qw") * weight), 6).alias("score"))


def cosine(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score: the dot of what is divided by its document's norm, on both sides."""
    postings = staged(postings.sparkSession, postings, "postings")
    norms = postings.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    each = matched(postings, normalised(queries, "qw", "query_id")).join(norms, "id")
    return summed(each, F.when(F.col("norm") > 1.1920929e-07, F.col("w") / F.col("norm")).otherwise(0.0))


def cosine_search(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return best(cosine(postings, queries), k)


def bm25_search(postings: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """With idf = ln((N - df + 0.5) / (df + 0.5) + 1) and the corpus' mean length. Postings are made once; lengths are joined with
    the postings of query terms only."""
    postings = staged(postings.sparkSession, postings, "postings")
    lengths = postings.groupBy("id").agg(F.sum(F.abs("w")).alias("dl"))
    n, mean = lengths.agg(F.count("*"), F.avg("dl")).first()
    each = matched(postings, queries)
    df = in_blocks(queries.select(F.col("term").alias("query_id")).distinct(), lambda q: postings.join(q.withColumnRenamed("query_id", "term"), "term"), 200_000)
    idf = df.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    each = each.join(idf, "term").withColumn("qw", F.col("qw") * F.col("idf"))
    tf = F.col("w") * (k1 + 1) / (F.col("w") + k1 * (1 - b + b * F.col("dl") / F.lit(mean or 1.0)))
    return best(summed(each.join(lengths, "id"), tf), k)


def bm25_fixed(postings: DataFrame, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, mean: float = 100.0) -> DataFrame:
    """The other dialect: no idf, a fixed mean length, and signed document lengths."""
    postings = staged(postings.sparkSession, postings, "postings")
    lengths = postings.groupBy("id").agg(F.sum("w").alias("dl"))
    tf = F.col("w") * (k1 + 1) / (F.col("w") + k1 * (1 - b + b * F.col("dl") / mean))
    return best(summed(matched(postings, queries).join(lengths, "id"), tf), k)


def filled(scored: DataFrame, ids: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Positive scores first, then documents without a shared term in order of id, then negative ones, to k a query.

    Only queries with fewer than k positive scores need others. The k least ids that such a query hasn't scored are among
    as many least ids of all as k and its scores together.
    """
    scored = staged(scored.sparkSession, scored, "scored")
    asked = queries.select("query_id").distinct()
    counts = scored.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("good"), F.count("*").alias("n"))
    short = asked.join(counts, "query_id", "left").where(F.coalesce("good", F.lit(0)) < k)
    most = short.agg(F.max("n")).first()[0] or 0
    first = ids.select("id").distinct().orderBy("id").limit(k + most)
    spare = in_blocks(short.select("query_id"), first.crossJoin).join(scored.select("query_id", "id"), ["query_id", "id"], "left_anti")
    known = top(scored.withColumn("distance", -F.col("score")), k).select("query_id", "id", "score")
    others = top(spare.withColumn("distance", F.lit(0.0)), k).select("query_id", "id", F.lit(0.0).alias("score"))
    return top(known.unionByName(others).withColumn("distance", -F.col("score")), k).select("query_id", "rank", "id", "score")


def drop_terms(queries: DataFrame, ratio: float) -> DataFrame:
    """The ceil(n * (1 - ratio)) heaviest terms of each query; ratio at most 0.95."""
    each = Window.partitionBy("query_id")
    rank = F.row_number().over(each.orderBy(F.desc(F.abs("qw")), "term"))
    kept = queries.withColumn("_r", rank).withColumn("_n", F.count("*").over(each))
    return kept.where(F.col("_r") <= F.ceil(F.col("_n") * (1 - min(max(ratio, 0.0), 0.95)))).drop("_r", "_n")


def drop_small(queries: DataFrame, ratio: float) -> DataFrame:
    """The terms whose absolute weight is at least the one at place floor(n * ratio) of all n in ascending order; ties stay."""
    each = Window.partitionBy("query_id")
    size = F.abs("qw")
    placed = queries.withColumn("_r", F.row_number().over(each.orderBy(size, "term"))).withColumn("_n", F.count("*").over(each))
    least = F.max(F.when(F.col("_r") == F.floor(F.col("_n") * min(max(ratio, 0.0), 0.95)) + 1, size)).over(each)
    return placed.withColumn("_l", least).where(size >= F.col("_l")).drop("_r", "_n", "_l")


def tfidf(postings: DataFrame) -> DataFrame:
    """w times ln((n + 1) / (df + 1)) + 1."""
    postings = staged(postings.sparkSession, postings, "postings")
    n = postings.select("id").distinct().count()
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    return postings.join(df, "term").select("id", "term", F.round(F.col("w") * (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1), 6).alias("w"))
