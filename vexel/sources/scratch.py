"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only local mode, where there is one machine, may leave it unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not base and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return (base or os.path.join(tempfile.gettempdir(), "checkpoints")).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, with the scheme of the file system that Spark takes it to be on; Hadoop's file system
    deletes it when the driver ends."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/vexel-{name}-{uuid.uuid4().hex}")
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    hadoop = system.makeQualified(hadoop)
    system.deleteOnExit(hadoop)
    path = hadoop.toString()
    return f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and a lost executor loses nothing."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that is heavy beside the reading of few large files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
