"""Places of rows within keys without a task for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``place``, from 0 within ``keys`` by ``order``, nulls first; keys and order name each row once.

    Rows are sorted by ranges over all tasks and written once.  A key's rows lie in
    consecutive tasks, so a place is the row's place in its task and the key's rows in
    the tasks before: only counts, one for each key and task, meet by key.
    """
    by = [*keys, *order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    held = materialise(sorted_rows.withColumn("__task", F.shiftright("__at", 33)), name)
    counts = held.groupBy("__task", *keys).agg(F.min("__at").alias("__least"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__task").alias("__in"), *[F.col(k).alias(f"__key_{k}") for k in keys], (F.col("__least") - F.coalesce(F.sum("__n").over(earlier), F.lit(0))).alias("__zero"))
    same = F.col("__task") == F.col("__in")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    return held.join(counts, same).select(*rows.columns, (F.col("__at") - F.col("__zero")).alias("place"))
