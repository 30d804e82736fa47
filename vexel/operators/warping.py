"""Dynamic time warping of every series of a table with every query.

Queries are collected, and each task warps the series that it was dealt with all of them: pairs are only made as results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distances as D
from .search import EMITTED, by_length, together


def all_pairs(rows: DataFrame, queries: DataFrame, cost: str = "l2", window: Callable[[int, int], int] | None = None, slope: float | None = None) -> DataFrame:
    """query_id, id, distance of all pairs. rows: (id, series); queries: (query_id, q); window: a band's width, by the two lengths.
    Series are dealt out by length first, the longest in the first tasks: equally long ones are warped side by side."""
    table = queries.select("query_id", "q").toArrow().combine_chunks()
    asked = [(table["query_id"].combine_chunks().take(pa.array(at)), a) for _, at, a in by_length(table["q"].combine_chunks())] if table.num_rows else []
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", rows.schema["id"].dataType), T.StructField("distance", T.DoubleType())])

    def run(batches):
        for batch in batches:
            ids = batch.column("id")
            for _, at, b in by_length(batch.column("series")):
                mine = ids.take(pa.array(at))
                for query_ids, a in asked:
                    for i in range(0, len(a), step := max(1, EMITTED // len(b))):
                        some = a[i : i + step]
                        far = D.dtw_many(some, b, cost, window(a.shape[1], b.shape[1]) if window else None, slope)
                        line, column = np.divmod(np.arange(far.size), len(b))
                        yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(line + i)), mine.take(pa.array(column)), pa.array(np.round(far.ravel(), 6))], names=schema.names)

    dealt = rows.select("id", "series").repartitionByRange(4 * rows.sparkSession.sparkContext.defaultParallelism, F.size("series").desc(), "id")
    return dealt.mapInArrow(lambda batches: together(run(batches)), schema)
