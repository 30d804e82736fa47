"""Scalar filters, id sets, and a table of scalars with upserts."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _comparable(value: Any, kind: T.DataType, ordered: bool) -> bool:
    if isinstance(value, bool):
        return isinstance(kind, T.BooleanType) and not ordered
    if isinstance(value, (int, float)):
        return isinstance(kind, T.NumericType)
    return isinstance(value, str) and isinstance(kind, T.StringType)


def _leaf(schema: T.StructType, name: str, op: str, value: Any) -> Column:
    """Two-valued: a missing field, a null or a value of another type makes the leaf false."""
    if name not in schema.names:
        return F.lit(False)
    column, kind = F.col(name), schema[name].dataType
    if op == "in":
        return reduce(lambda a, b: a | b, (_leaf(schema, name, "eq", v) for v in value), F.lit(False))
    if not _comparable(value, kind, op not in ("eq", "ne")):
        return F.lit(False)
    made = {"eq": column == value, "ne": column != value, "lt": column < value, "le": column <= value, "gt": column > value, "ge": column >= value}[op]
    return F.coalesce(made, F.lit(False))


def compile_filter(schema: T.StructType, expr: tuple) -> Column:
    """A filter tree as one column: ("eq", field, value), ("in", field, values), ("and", a, b, ...), ("or", ...), ("not", a)."""
    op, *args = expr
    if op == "and":
        return reduce(lambda a, b: a & b, (compile_filter(schema, a) for a in args), F.lit(True))
    if op == "or":
        return reduce(lambda a, b: a | b, (compile_filter(schema, a) for a in args), F.lit(False))
    if op == "not":
        return ~compile_filter(schema, args[0])
    return _leaf(schema, args[0], op, args[1])


def scan(rows: DataFrame, expr: tuple) -> DataFrame:
    return rows.where(compile_filter(rows.schema, expr))


def keep_order(wanted: DataFrame, rows: DataFrame, expr: tuple) -> DataFrame:
    """The requested (ord, id) whose row passes, still with their place in the request."""
    return wanted.join(scan(rows, expr).select("id").distinct(), "id", "left_semi")


def upsert(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """rows after changes (same columns, and version, deleted): the last change of an id wins, and a deletion removes it."""
    cols = rows.columns
    all_rows = rows.withColumns({"version": F.lit(-1).cast("long"), "deleted": F.lit(False)}).unionByName(changes.select(*cols, F.col("version").cast("long").alias("version"), "deleted"))
    last = Window.partitionBy("id").orderBy(F.desc("version"))
    return all_rows.withColumn("_n", F.row_number().over(last)).where((F.col("_n") == 1) & ~F.col("deleted")).select(*cols)


#: Ids of a range in which the next set id is looked for by one task.
NEXT = 1_000_000

# sets of ids: present means excluded


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").union(b.select("id")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id").intersect(b.select("id"))


def difference_both(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids in exactly one of the two."""
    each = a.select("id").distinct().withColumn("s", F.lit(1)).union(b.select("id").distinct().withColumn("s", F.lit(2)))
    return each.groupBy("id").agg(F.sum("s").alias("s")).where("s < 3").select("id")


def flipped(ids: DataFrame, universe: DataFrame) -> DataFrame:
    """The ids of the universe that aren't set."""
    return universe.select("id").distinct().join(ids.select("id").distinct(), "id", "left_anti")


def remapped(positions: DataFrame, mapping: DataFrame, offset: int = 0) -> DataFrame:
    """Ids of set positions, by a table (pos, id), after a shift; positions that it doesn't have are absent."""
    moved = positions.select((F.col("id") + offset).alias("pos")).distinct()
    return moved.join(mapping.select("pos", "id"), "pos").select("id")


def next_set(ids: DataFrame, universe: DataFrame) -> DataFrame:
    """id, next: for each id of the universe the least set id from there on, found in ranges of about NEXT ids and across
    them by what each range begins with."""
    low, high = universe.agg(F.min("id"), F.max("id")).first()
    both = universe.select("id").distinct().join(ids.select("id").distinct().withColumn("on", F.col("id")), "id", "left")
    if low is None:
        return both.select("id", F.col("on").alias("next"))
    both = both.withColumn("range", F.floor((F.col("id") - low) / NEXT))
    first = both.groupBy("range").agg(F.min("on").alias("first"))  # a row a range
    after = first.withColumn("later", F.min("first").over(Window.orderBy("range").rowsBetween(1, Window.unboundedFollowing))).select("range", "later")
    within = F.min("on").over(Window.partitionBy("range").orderBy("id").rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return both.withColumn("here", within).join(after, "range").select("id", F.coalesce("here", "later").alias("next"))


def summary(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """How many ids are set, the first and last of them, the first that isn't, and the share of rows they exclude."""
    both = rows.select("id").distinct().join(ids.select("id").distinct().withColumn("on", F.lit(True)), "id", "left")
    on = F.coalesce("on", F.lit(False))
    return both.agg(F.count_if(on).alias("n_set"), F.min(F.when(on, F.col("id"))).alias("first_set"), F.max(F.when(on, F.col("id"))).alias("last_set"),
        F.min(F.when(~on, F.col("id"))).alias("first_valid"), F.coalesce(F.avg(on.cast("double")), F.lit(0.0)).alias("filter_ratio"))
