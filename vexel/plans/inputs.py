"""The tables as the operators want them, and the same in SQL.

Vectors are scaled by 1 + label, so that metrics differ. Queries are all rows whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import spread


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.expr("transform(embedding, x -> CAST(x AS DOUBLE) * (1 + label))").alias("vec"))


def queries(base: DataFrame) -> DataFrame:
    return base.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("q"))


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return docs.select(F.col("doc_id").alias("id"), "lang", "source", "n_chars").join(labels.withColumnRenamed("doc_id", "id"), "id", "left")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def text_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").where("value IS NOT NULL")
    return events.groupBy(F.col("user_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))), lambda e: e["value"]).alias("series"))


V = "v AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + label)) AS vec FROM embeddings)"
Q = "q AS (SELECT id AS query_id, vec AS q FROM v WHERE id % 100 = 0)"
PAIRS = f"WITH {V}, {Q}, p AS (SELECT query_id, id, q, vec FROM v CROSS JOIN q)"
SCALARS = "s AS (SELECT d.doc_id AS id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
POSTINGS = """w AS (SELECT doc_id AS id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS term FROM documents),
p AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS w FROM w WHERE term <> '' GROUP BY ALL),
wq AS (SELECT item_id AS query_id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS term FROM benchmark),
q AS (SELECT query_id, term, CAST(count(*) AS DOUBLE) AS qw FROM wq WHERE term <> '' GROUP BY ALL)"""


def fold(a: str, b: str, term: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: {term}))"


L2_SQ, IP = "(z[1] - z[2]) * (z[1] - z[2])", "z[1] * z[2]"


def sql_cosine(a: str, b: str) -> str:
    size = f"(sqrt({fold(a, a, IP)}) * sqrt({fold(b, b, IP)}))"
    return f"CASE WHEN {size} > 0 THEN {fold(a, b, IP)} / {size} ELSE 0 END"


def sql_distance(metric: str, a: str, b: str) -> str:
    return {
        "l2": f"sqrt({fold(a, b, L2_SQ)})", "l2_sq": fold(a, b, L2_SQ), "ip": f"-({fold(a, b, IP)})", "cosine": f"1 - ({sql_cosine(a, b)})",
        "l1": fold(a, b, "abs(z[1] - z[2])"), "linf": f"list_max(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
        "hamming": f"CAST({fold(a, b, 'CASE WHEN (z[1] >= 0) <> (z[2] >= 0) THEN 1 ELSE 0 END')} AS DOUBLE)",
        "jaccard": f"CASE WHEN {fold(a, b, 'CASE WHEN z[1] >= 0 OR z[2] >= 0 THEN 1 ELSE 0 END')} = 0 THEN 0 ELSE 1 - {fold(a, b, 'CASE WHEN z[1] >= 0 AND z[2] >= 0 THEN 1 ELSE 0 END')} / CAST({fold(a, b, 'CASE WHEN z[1] >= 0 OR z[2] >= 0 THEN 1 ELSE 0 END')} AS DOUBLE) END",
    }[metric]


def rounded(expr: str) -> str:
    return f"round({expr}, 9) + 0.0"


def ranked(scored: str, k: int, columns: str = "query_id, rank, id, distance", by: str = "distance, id", per: str = "query_id") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {per} ORDER BY {by}) AS rank FROM {scored}) WHERE rank <= {k}"


def flat_sql(metric: str, k: int, where: str = "TRUE") -> str:
    return f"{PAIRS}, s AS (SELECT query_id, id, {rounded(sql_distance(metric, 'vec', 'q'))} AS distance FROM p WHERE {where}) {ranked('s', k)}"
