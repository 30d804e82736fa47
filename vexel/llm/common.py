"""What the corpus operators share: scratch tables, row tables and joins that no hot key can slow.

Every operator reads only the columns it names, so extra columns of the input never clash with its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch as scratch, staged as staged

#: A key holding at least 1/HOT_SHARE of all rows is hot, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Stands for a null doc_id where an order is needed: a null is smaller than any number.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def join_facts(rows: DataFrame, facts: DataFrame, key: list[str], weight: str, total: int) -> DataFrame:
    """Inner join of rows with facts, which has one row per key and, as `weight`, how many rows that key has.

    Keys with at least total/HOT_SHARE rows, at most HOT_SHARE of them by counting, are broadcast; the others go
    through a sort-merge join in which no key has more rows than that.
    """
    least = max(2.0, total / HOT_SHARE)
    hot = F.broadcast(facts.where(F.col(weight) >= least))
    cold = rows.join(F.broadcast(facts.where(F.col(weight) >= least).select(*key)), key, "left_anti")
    both = [*rows.columns, *(c for c in facts.columns if c not in rows.columns)]
    return rows.join(hot, key).select(both).unionByName(cold.join(facts.where(F.col(weight) < least).hint("merge"), key).select(both))
