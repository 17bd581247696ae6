"""The category tree and batches of folder operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise


def normal_path(path: Column) -> Column:
    """Split at slashes, trim, drop empties, join again; null if nothing is left."""
    parts = F.filter(F.transform(F.split(path, "/"), lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.array_join(parts, "/"))


def prefixes(path: Column) -> Column:
    """All ancestors of a path and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def category_tree(concepts: DataFrame, folders: DataFrame) -> DataFrame:
    """Every path node per owner: parent, depth, concepts directly in it and in its subtree."""
    used = concepts.select("owner_id", normal_path(F.col("category")).alias("path"), F.lit(1).alias("n")).unionByName(folders.select("owner_id", normal_path(F.col("path")).alias("path"), F.lit(0).alias("n")))
    # Few rows per path reach the roll-up along it.
    used = used.where("path IS NOT NULL").groupBy("owner_id", "path").agg(F.sum("n").alias("n"))
    nodes = used.select("owner_id", F.explode(prefixes(F.col("path"))).alias("node"), F.col("n"), F.col("path"))
    direct = F.sum(F.when(F.col("node") == F.col("path"), F.col("n")).otherwise(0))
    tree = nodes.groupBy("owner_id", "node").agg(direct.alias("direct_count"), F.sum("n").alias("subtree_count"))
    depth = F.size(F.split("node", "/"))
    parent = F.when(depth > 1, F.array_join(F.slice(F.split("node", "/"), F.lit(1), depth - 1), "/"))
    return tree.select("owner_id", F.col("node").alias("path"), parent.alias("parent"), depth.alias("depth"), "direct_count", "subtree_count")


def occupied(concepts: DataFrame, folders: DataFrame) -> DataFrame:
    """(owner_id, path) of every node that exists, ancestors included."""
    return category_tree(concepts, folders).select("owner_id", "path")


def folder_move(concepts: DataFrame, folders: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves (move_id, owner_id, source, target) that do not touch each other's paths.

    Returns (move_id, verdict), and the moved concepts (id, category).  Refused:
    empty paths, a move into itself, an occupied target, an absent source.
    """
    m = moves.select("move_id", "owner_id", normal_path(F.col("source")).alias("source"), normal_path(F.col("target")).alias("target"))
    have = occupied(concepts, folders)
    m = m.join(have.select("owner_id", F.col("path").alias("source"), F.lit(True).alias("present")), ["owner_id", "source"], "left")
    m = m.join(have.select("owner_id", F.col("path").alias("target"), F.lit(True).alias("taken")), ["owner_id", "target"], "left")
    verdict = (
        F.when(F.col("source").isNull() | F.col("target").isNull(), "empty")
        .when((F.col("source") == F.col("target")) | F.startswith("target", F.concat("source", F.lit("/"))), "into-itself")
        .when(F.col("taken"), "occupied")
        .when(F.col("present").isNull(), "absent")
        .otherwise("moved")
    )
    judged = m.withColumn("verdict", verdict)
    good = judged.where("verdict = 'moved'").select("owner_id", F.col("source").alias("prefix"), "target")
    # A concept meets a move at one of its ancestors: an equi-join.
    rows = concepts.select("id", "owner_id", normal_path(F.col("category")).alias("category")).where("category IS NOT NULL").withColumn("prefix", F.explode(prefixes(F.col("category"))))
    moved = rows.join(good, ["owner_id", "prefix"]).select("id", F.concat("target", F.expr("substring(category, length(prefix) + 1)")).alias("category"))
    return judged.select("move_id", "verdict"), moved


def folder_move_ordered(concepts: DataFrame, folders: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Moves (move_id, seq, owner_id, source, target) applied one after the other: chains, swaps, and moves of what was moved.

    Returns (move_id, verdict) as of the move's turn, and the concepts (id, category)
    whose category is another in the end.  The rewrites are composed over the distinct
    paths, in as many rounds as the owner with most moves has: a round takes one move
    of each owner.  Concepts meet the composed rewrite once.
    """
    kept = concepts.select("id", "owner_id", normal_path(F.col("category")).alias("was")).where("was IS NOT NULL")
    paths = kept.select("owner_id", "was").union(folders.select("owner_id", normal_path(F.col("path")))).where("was IS NOT NULL").distinct()
    asked = moves.select("move_id", "owner_id", normal_path(F.col("source")).alias("source"), normal_path(F.col("target")).alias("target"), F.row_number().over(Window.partitionBy("owner_id").orderBy("seq", "move_id")).alias("turn"))
    asked = materialise(asked, "moves")
    paths = materialise(paths.join(asked.select("owner_id").distinct(), "owner_id", "left_semi").withColumn("path", F.col("was")), "paths")
    under = lambda path, top: (F.col(path) == F.col(top)) | F.startswith(path, F.concat(top, F.lit("/")))
    judged = []
    for turn in range(1, (asked.agg(F.max("turn")).first()[0] or 0) + 1):
        move = asked.where(F.col("turn") == turn).drop("turn")
        there = paths.join(move.select("owner_id", "source", "target"), "owner_id").groupBy("owner_id").agg(F.max(under("path", "source")).alias("present"), F.max(under("path", "target")).alias("taken"))
        verdict = (
            F.when(F.col("source").isNull() | F.col("target").isNull(), "empty")
            .when(under("target", "source"), "into-itself")
            .when(F.col("taken"), "occupied")
            .when(~F.coalesce("present", F.lit(False)), "absent")
            .otherwise("moved")
        )
        move = materialise(move.join(there, "owner_id", "left").withColumn("verdict", verdict).select("move_id", "owner_id", "source", "target", "verdict"), "moves")
        judged.append(move.select("move_id", "verdict"))
        good = move.where("verdict = 'moved'").select("owner_id", "source", "target")
        to = F.when(F.col("source").isNotNull() & under("path", "source"), F.concat("target", F.expr("substring(path, length(source) + 1)"))).otherwise(F.col("path"))
        paths = materialise(paths.join(good, "owner_id", "left").select("owner_id", "was", to.alias("path")), "paths")
    verdicts = reduce(DataFrame.unionByName, judged) if judged else asked.select("move_id", F.lit(None).cast("string").alias("verdict"))
    return verdicts, kept.join(paths.where("path <> was"), ["owner_id", "was"]).select("id", F.col("path").alias("category"))


def folder_delete(concepts: DataFrame, deletions: DataFrame) -> DataFrame:
    """Live concepts below a deleted (owner_id, path) lose their category; all rows come back as (id, category)."""
    gone = deletions.select("owner_id", normal_path(F.col("path")).alias("prefix")).distinct()
    rows = concepts.select("id", "owner_id", "category", "deleted_at", F.explode(F.coalesce(prefixes(F.col("category")), F.array(F.lit("")))).alias("prefix"))
    hit = rows.join(gone, ["owner_id", "prefix"], "left_semi").where("deleted_at IS NULL").select("id", F.lit(True).alias("hit")).distinct()
    return concepts.select("id", "category").join(hit, "id", "left").select("id", F.when(F.col("hit").isNull(), F.col("category")).alias("category"))


def folder_create(concepts: DataFrame, folders: DataFrame, paths: DataFrame) -> DataFrame:
    """New folders (seq, owner_id, path): created, or conflict with a path that is there or comes earlier in the batch."""
    have = occupied(concepts, folders).withColumn("there", F.lit(True))
    asked = paths.select("seq", "owner_id", normal_path(F.col("path")).alias("path"))
    earlier = asked.where("path IS NOT NULL").select("owner_id", "seq", F.explode(prefixes(F.col("path"))).alias("path")).groupBy("owner_id", "path").agg(F.min("seq").alias("first_seq"))
    rows = asked.join(have, ["owner_id", "path"], "left").join(earlier, ["owner_id", "path"], "left")
    verdict = F.when(F.col("path").isNull(), "empty").when(F.col("there") | (F.col("first_seq") < F.col("seq")), "conflict").otherwise("created")
    return rows.select("seq", "owner_id", "path", verdict.alias("verdict"))
