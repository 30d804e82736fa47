"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefix, confirmed by full digest.

A rule is a host and a path. It fits its host and all subdomains if the url's path starts with the rule's path. The
longest rule that fits decides; of equal rules, block wins; without one the default verdict holds.

Only expressions that some rule could equal are made: host suffixes of as many labels, and path prefixes of as many
characters, as some rule has. That loses no match and bounds the expressions of a url by the rules, not by its length.

Defined results: rules with a null host or path fit nothing; a null url, or one without ://, has empty host and path; repeated rows are judged each; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of the digest that the join compares: four bytes.
PREFIX = 8
#: Rules are broadcast up to this number (about 20 MB); beyond it the join shuffles.
BROADCAST_RULES = 100_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def _expressions(labels: list[int], lengths: list[int]) -> Column:
    """Host suffixes of so many labels, each with path prefixes of so many characters."""
    labels, lengths = F.array(*[F.lit(n) for n in sorted(labels)]), F.array(*[F.lit(n) for n in sorted(lengths)])
    hosts = F.transform(F.filter(labels, lambda n: n <= F.size(F.split("host", r"\."))), lambda n: F.array_join(F.slice(F.split("host", r"\."), -n, n), "."))
    paths = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def verdicts(spark: SparkSession, pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, default: str = "allow") -> DataFrame:
    """One row per page: page_id, host, path, rule (or null), verdict. rules: (host, path, verdict), a list or a table; of a
    table only the numbers of labels and the lengths that there are come to the driver."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(rules, "host string, path string, verdict string")
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL")
    told = rules.select(F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"))
    count, labels, lengths = told.agg(F.count("*"), F.collect_set("labels"), F.collect_set("length")).first()
    host, path = host_and_path(pages["url"])
    base = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    if not count:
        return base.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    listed = rules.select(F.concat("host", "path").alias("rule"), "verdict").withColumn("digest", F.sha2("rule", 256))
    listed = listed.select(F.substring("digest", 1, PREFIX).alias("prefix"), "digest", F.struct(F.length("rule").alias("long"), "rule", "verdict").alias("fit"))
    if count <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    each = base.withColumn("expr", F.explode_outer(_expressions(labels, lengths))).withColumn("full", F.sha2("expr", 256))
    hits = each.withColumn("prefix", F.substring("full", 1, PREFIX)).join(listed, "prefix", "left")
    best = hits.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("full") == F.col("digest"), F.col("fit"))).alias("best"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, table(spark, sf_dir, "pages"))


ORACLE = {
    "op9_url_filter": """
WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS a FROM pages),
r AS (SELECT page_id, CASE WHEN a > 0 THEN substr(url, a + 3) ELSE '' END AS rest FROM u),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
      ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
      FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.v, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)"""
}
