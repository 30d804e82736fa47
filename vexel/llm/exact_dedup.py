"""Exact dedup by a persistent digest index, bucketed and sorted by hash; native DataFrame operations only.

Each batch is reduced to one candidate per digest (partial aggregation first, so a hot text shrinks before the
shuffle), sort-merge anti-joined with the index, and what is new is appended to it.

The number of buckets is stored beside the index, and an index is only opened with that number. Each row has the name of
the batch that brought it: a batch doesn't count as seen to itself, so one that is run again, because its output was
lost after its digests had been appended, gives the same rows again and appends nothing twice.

Defined results: null text counts as empty; a null doc_id is smaller than any other; of rows that repeat both doc_id
and text exactly one is kept; an empty table gives an empty result; other columns are ignored; a very long text is only
digested, in the memory that its row takes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_facts, scratch, staged, table, text_or_empty

DIGEST = "digest"


def group_mark() -> Column:
    """A column that is true for every group. Spark doesn't take `first` for deterministic."""
    return F.first(F.lit(True)).alias("one")


class DigestIndex:
    """Table (digest, doc_id, row, batch) bucketed and sorted by digest: the row that stays for each text seen so far.

    path names an index that outlives the session; without it the index is a scratch one. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or scratch(spark, "digests")
        stored = self._stored(buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        if buckets not in (None, stored):
            raise ValueError(f"the index at {self.path} has {stored} buckets, not {buckets}")
        self.buckets, self.name = stored, f"vexel_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({DIGEST} BINARY, doc_id BIGINT, row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY ({DIGEST}) SORTED BY ({DIGEST}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def _stored(self, new: int) -> int:
        """The number of buckets that the index has, or `new`, which is stored, if there is none yet."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        place = hadoop.Path(self.path)
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        system.mkdirs(place)
        names = [f.getPath().getName() for f in system.listStatus(place)]
        told = [int(n.removeprefix("_buckets=")) for n in names if n.startswith("_buckets=")]  # a name that tables don't read
        if told:
            return told[0]
        if any(n.endswith(".parquet") for n in names):
            raise ValueError(f"{self.path} has rows but not the number of its buckets")
        system.create(hadoop.Path(place, f"_buckets={new}"), True).close()
        return new

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def unseen(self, candidates: DataFrame, batch: str | None = None) -> DataFrame:
        """Candidates whose digest isn't in the index, other than from the same batch, by a sort-merge anti-join on the
        bucketing key.

        Candidates carry group_mark(): the optimizer moves no anti-join below an aggregate that isn't deterministic, so digests
        are aggregated before they are shuffled.
        """
        seen = self.read() if batch is None else self.read().where(~F.col("batch").eqNullSafe(batch))
        return candidates.join(seen.select(DIGEST).hint("merge"), DIGEST, "left_anti").where("one").drop("one")

    def append(self, fresh: DataFrame, batch: str) -> None:
        """One file per bucket and batch: rows are dealt by the bucketing key first. Digests that are there already, because the
        batch is run again, stay as they are."""
        new = fresh.select(DIGEST, "doc_id", "row").repartition(self.buckets, DIGEST).join(self.read().select(DIGEST).hint("merge"), DIGEST, "left_anti")
        (new.withColumn("batch", F.lit(batch))
            .write.format("parquet").bucketBy(self.buckets, DIGEST).sortBy(DIGEST).mode("append").saveAsTable(self.name))

    def add(self, rows: DataFrame, batch: str) -> None:
        """rows (row, doc_id, digest): the largest (doc_id, row) of each new digest enters the index."""
        best = rows.groupBy(DIGEST).agg(F.max(F.struct("doc_id", "row")).alias("best"), group_mark())
        self.append(self.unseen(best).select(DIGEST, "best.doc_id", "best.row"), batch)


def digests(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_or_empty(docs), 256)).alias(DIGEST))


def decisions(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    The corpus enters the index in two batches, larger doc_ids first, so that what stays of equal texts is the largest
    doc_id and the second batch meets an index that is already filled. With a filled index given, its rows stay.
    """
    index = index or DigestIndex(spark)
    rows = staged(spark, digests(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", DIGEST), "digest-rows")
    total, low, high = rows.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    cut = None if low is None else low + (high - low) // 2
    upper = F.coalesce(F.col("doc_id") > F.lit(cut), F.lit(False))
    index.add(rows.where(upper), "upper")
    index.add(rows.where(~upper), "lower")
    sizes = rows.groupBy(DIGEST).agg(F.count("*").alias("group_size"))
    keep = index.read().select(DIGEST, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"))
    facts = staged(spark, sizes.join(keep, DIGEST), "digest-groups")
    return join_facts(rows, facts, [DIGEST], "group_size", total).select(
        "doc_id", "keep_id", "group_size",
        F.coalesce((F.col("row") == F.col("keep_row")) & F.col("doc_id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"),
        F.lower(F.hex(DIGEST)).alias("text_sha256"),
    )


def keep_distinct(spark: SparkSession, docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs, all columns, that stay: one per text, of the largest doc_id, unless the index has that text.

    batch: a name that is the same when the batch is run again, so that it then keeps the same texts.
    """
    index, batch = index or DigestIndex(spark), batch or uuid.uuid4().hex
    cols = docs.columns
    best = (docs.select(F.unhex(F.sha2(text_or_empty(docs), 256)).alias(DIGEST), F.struct(*[docs[c] for c in cols]).alias("doc"))
        .groupBy(DIGEST).agg(F.max_by("doc", F.struct(F.col("doc.doc_id"))).alias("doc"), group_mark()))
    fresh = staged(spark, index.unseen(best, batch), "digest-fresh")
    index.append(fresh.select(DIGEST, F.col("doc.doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row")), batch)
    return fresh.select("doc.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, table(spark, sf_dir, "documents"))


ORACLE = {
    "op1_exact_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)"""
}
