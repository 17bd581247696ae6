"""Positions of rows within keys by one range sort, so that no key is one task's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``pos``, a row's place within its keys from 0 by ``order`` (nulls first), and ``n``, the rows of its keys.

    Rows are range-sorted over all tasks and written once; a row's place is its
    place in its task's run of the keys and the rows of that key in the tasks before.
    Only these counts, one for each key and task, meet by key.  Rows that agree in
    keys and order are told apart by where they were read, so a third of all rows
    may agree in them.
    """
    spark = rows.sparkSession
    by = [*keys, *order, "__read"]
    placed = rows.withColumn("__read", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = placed.drop("__read").withColumn("__at", F.monotonically_increasing_id()).withColumn("__task", F.shiftright("__at", 33))
    placed = storage.materialise(placed, spark, name)
    runs = placed.groupBy("__task", *keys).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(own.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = storage.materialise(runs.select("__task", *keys, (F.col("__first") - before).alias("__from"), F.sum("__n").over(own).alias("n")), spark, f"{name}-runs")
    match = [placed["__task"] == runs["__task"], *(placed[k].eqNullSafe(runs[k]) for k in keys)]
    held = placed.join(runs, match)
    return held.select(*(placed[c] for c in rows.columns), (placed["__at"] - runs["__from"]).alias("pos"), runs["n"])
