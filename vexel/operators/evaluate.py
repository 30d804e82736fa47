"""Recall, validators and statistics of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """Per query: hits among the first k of both, over the smaller of k and the result's length."""
    mine, real = result.where(F.col("rank") <= k), truth.where(F.col("rank") <= k)
    hits = mine.join(real.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.least(F.count("*"), F.lit(k))).alias("recall"))


def recall_micro(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """All hits over all true neighbours, at most k a query."""
    real = truth.where(F.col("rank") <= k)
    hits = real.join(result.where(F.col("rank") <= k).select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))


def confidence(recall: Column, gate: float) -> Column:
    return F.when(recall >= gate, "trusted").when(recall >= 0.5, "unreliable").otherwise("recheck")


def validate(hits: DataFrame, low: float, high: float) -> DataFrame:
    """Per query: whether distances lie strictly between the bounds, aren't negative, and never fall with rank."""
    before = F.lag("distance").over(_by_rank())
    each = hits.withColumn("ordered", F.coalesce(F.col("distance") >= before, F.lit(True)))
    return each.groupBy("query_id").agg(F.bool_and((F.col("distance") > low) & (F.col("distance") < high)).alias("in_bounds"), F.bool_and(F.col("distance") >= 0).alias("non_negative"), F.bool_and("ordered").alias("monotone"))


def _by_rank():
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy("rank")


def distance_statistics(hits: DataFrame) -> DataFrame:
    """Least, greatest, mean and population deviation; zeros without hits."""
    zero = F.lit(0.0)
    return hits.agg(F.coalesce(F.min("distance"), zero).alias("min"), F.coalesce(F.max("distance"), zero).alias("max"), F.coalesce(F.round(F.avg("distance"), 6), zero).alias("mean"), F.coalesce(F.round(F.stddev_pop("distance"), 6), zero).alias("std"))


def memory_estimate(n: Column, dim: Column, nlist: int, m: int) -> dict[str, Column]:
    """Bytes of a flat, an inverted-file and a graph index."""
    return {"flat": n * dim * 4, "ivf": n * 4 + F.lit(nlist) * dim, "hnsw": n * F.lit(m) * 2 * 4 + n * dim * 4}
