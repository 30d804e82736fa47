"""Streams of vectors into lists on disk: each micro-batch is assigned where it lies and appended.

A batch is written under its number, and a batch that comes again replaces what it wrote, so a restart loses and repeats
nothing. Searches read the lists as any other table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import cluster


def append_lists(stream: DataFrame, path: str, checkpoint: str, centroids: np.ndarray, metric: str = "l2") -> StreamingQuery:
    """stream: (id, vec). Writes path/batch=<n>/list=<l>."""

    def write(batch: DataFrame, number: int) -> None:
        cluster.assign_blocks(batch.select("id", "vec"), centroids, metric).write.mode("overwrite").partitionBy("list").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(path).drop("batch")
