"""Vector files: fvecs, ivecs, fbin, ibin and raw float32, read by Spark's binaryFile source, and writers for them.

A record of fvecs or ivecs is a little-endian int32 dimension and as many values. fbin and ibin start with the number of
rows and the dimension. Files are decoded whole in a task, so a large collection should be many files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"fvecs": np.float32, "ivecs": np.int32, "fbin": np.float32, "ibin": np.int32, "raw": np.float32}


def decode(data: bytes, kind: str, dim: int | None = None) -> np.ndarray:
    """The rows of one file."""
    value = np.dtype(KINDS[kind]).newbyteorder("<")
    if kind in ("fvecs", "ivecs"):
        if not data:
            return np.zeros((0, 0), value)
        dim = int(np.frombuffer(data, "<i4", 1)[0])
        if dim <= 0 or len(data) % (4 + 4 * dim):
            raise ValueError(f"not a whole number of {kind} records of dimension {dim}")
        whole = np.frombuffer(data, "<i4").reshape(-1, dim + 1)
        if (whole[:, 0] != dim).any():
            raise ValueError(f"{kind} records of different dimensions")
        return np.ascontiguousarray(whole[:, 1:]).view(value)
    if kind in ("fbin", "ibin"):
        n, dim = (int(x) for x in np.frombuffer(data, "<i4", 2))
        return np.frombuffer(data, value, n * dim, 8).reshape(n, dim)
    if not dim or len(data) % (4 * dim):
        raise ValueError("raw files need a dimension that their size is a multiple of")
    return np.frombuffer(data, value).reshape(-1, dim)


def encode(rows: np.ndarray, kind: str) -> bytes:
    rows = np.ascontiguousarray(rows, np.dtype(KINDS[kind]).newbyteorder("<"))
    if kind in ("fvecs", "ivecs"):
        return np.concatenate([np.full((len(rows), 1), rows.shape[1], "<i4"), rows.view("<i4")], 1).tobytes()
    head = np.array(rows.shape, "<i4").tobytes() if kind in ("fbin", "ibin") else b""
    return head + rows.tobytes()


def read_vectors(spark: SparkSession, path: str, kind: str, dim: int | None = None) -> DataFrame:
    """path, pos (the record's number in its file), vec."""
    value = "int" if KINDS[kind] is np.int32 else "float"

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = decode(data, kind, dim)
                for start in range(0, len(rows), 8192):
                    part = rows[start : start + 8192]
                    flat = pa.array(part.astype(part.dtype.newbyteorder("=")).ravel())
                    vec = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), flat)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(np.arange(start, start + len(part))), vec], names=["path", "pos", "vec"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, f"path string, pos long, vec array<{value}>")


def truth_table(neighbours: DataFrame) -> DataFrame:
    """Rows of an ivecs ground truth (pos, vec of ids) as query_id, rank, id."""
    return neighbours.select(F.col("pos").alias("query_id"), F.posexplode("vec").alias("r", "id")).select("query_id", (F.col("r") + 1).cast("long").alias("rank"), F.col("id").cast("long").alias("id"))


def load_bundle(spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
    """A benchmark as its publishers lay it out: <name>_base.fvecs, <name>_query.fvecs, <name>_groundtruth.ivecs."""
    base = read_vectors(spark, f"{folder}/{name}_base.fvecs", "fvecs").select(F.col("pos").alias("id"), "vec")
    asked = read_vectors(spark, f"{folder}/{name}_query.fvecs", "fvecs").select(F.col("pos").alias("query_id"), F.col("vec").alias("q"))
    return {"base": base, "queries": asked, "truth": truth_table(read_vectors(spark, f"{folder}/{name}_groundtruth.ivecs", "ivecs"))}
