"""Connected components as rounds of joins over the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; label is the least node of its component.

    Each round hooks every label to the least smaller neighbour and then follows
    the hooks to their ends, so the number of labels at least halves; a round's
    tables are written and read again, so that no lineage grows.
    """
    spark = links.sparkSession
    links = links.select("a", "b").where(F.col("a") != F.col("b"))
    edges = storage.materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), spark, "links")
    labels = storage.materialise(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("label")), spark, "labels")
    while not edges.isEmpty():
        hooks = storage.materialise(edges.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to")), spark, "hooks")
        while True:
            further = hooks.select(F.col("label").alias("to"), F.col("to").alias("beyond"))
            jumped = hooks.join(further, "to", "left").select("label", F.coalesce("beyond", "to").alias("to"), F.col("beyond").isNotNull().alias("moved"))
            jumped = storage.materialise(jumped, spark, "hooks")
            hooks = jumped.select("label", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = storage.materialise(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), spark, "labels")

        def renamed(side: str, edges: DataFrame = edges, hooks: DataFrame = hooks) -> DataFrame:
            return edges.join(hooks.select(F.col("label").alias(side), F.col("to").alias("to")), side, "left").withColumn(side, F.coalesce("to", side)).drop("to")

        edges = renamed("b", renamed("a"))
        edges = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = storage.materialise(edges, spark, "links")
    return labels
