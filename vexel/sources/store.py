"""An index as tables: Parquet parts (vectors, lists, codes, edges) beside a JSON description."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..types import IndexConfig


def save(path: str, config: IndexConfig, parts: dict[str, DataFrame], told: dict | None = None) -> None:
    """Lists are partitions on disk, so a probe reads only the folders it visits. told: what else describes the index."""
    for name, df in parts.items():
        writer = df.write.mode("overwrite")
        (writer.partitionBy("list") if "list" in df.columns else writer).parquet(f"{path}/{name}")
    spark = next(iter(parts.values())).sparkSession
    plain = {k: getattr(v, "value", v) for k, v in dataclasses.asdict(config).items()}
    described = json.dumps({"config": plain, "told": told or {}, "parts": {n: df.schema.jsonValue() for n, df in parts.items()}})
    spark.createDataFrame([(described,)], "config string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def load(spark: SparkSession, path: str) -> tuple[IndexConfig, dict[str, DataFrame], dict]:
    saved = json.loads(spark.read.text(f"{path}/config").first()[0])
    read = lambda name, schema: spark.read.schema(T.StructType.fromJson(schema)).parquet(f"{path}/{name}").select([f["name"] for f in schema["fields"]])
    return IndexConfig(**saved["config"]), {n: read(n, s) for n, s in saved["parts"].items()}, saved["told"]
