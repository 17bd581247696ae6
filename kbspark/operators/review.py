"""The review queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .curate import fingerprint


def review_enqueue(items: DataFrame, pending: DataFrame) -> DataFrame:
    """New items (seq, owner_id, content_hash, target_id, title), once per owner, hash and target; a missing target is a target like any other."""
    key = ["owner_id", "content_hash", "target_id"]
    have = pending.where("status = 'pending'").select(*[F.col(k).alias(f"have_{k}") for k in key]).distinct()
    met = F.lit(True)
    for k in key:
        met = met & F.col(k).eqNullSafe(F.col(f"have_{k}"))
    fresh = items.join(have, met, "left_anti")
    place = F.row_number().over(Window.partitionBy(*key).orderBy("seq"))
    return fresh.withColumn("place", place).where("place = 1").select("seq", *key, F.substring("title", 1, 200).alias("title"))


def review_list(items: DataFrame, corpus: DataFrame, status: str, kind: str | None = None, source: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of items with their target as it is now; stale where its fingerprint is gone or another."""
    rows = items.where(F.col("status") == status)
    rows = rows.where(F.col("kind") == kind) if kind else rows
    rows = rows.where(F.col("source") == source) if source else rows
    order = [F.desc_nulls_last("resolved_on"), "item_id"] if status == "resolved" else [F.desc("created_on"), "item_id"]
    page = rows.orderBy(*order).offset(offset).limit(limit)
    now = corpus.select(F.col("id").alias("target_id"), F.col("title").alias("target_title"), fingerprint("title", "status", "body").alias("now"))
    met = page.join(now, "target_id", "left")
    stale = F.col("target_id").isNotNull() & ~F.col("fingerprint").eqNullSafe(F.col("now"))
    return met.select("item_id", "kind", "source", "title", "target_id", "target_title", stale.alias("stale"))


def review_counts(items: DataFrame) -> DataFrame:
    """Items by every combination of status, kind and source; null with a level of aggregation stands for all."""
    return items.cube("status", "kind", "source").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"))


def review_resolve(decisions: DataFrame, items: DataFrame, corpus: DataFrame) -> DataFrame:
    """(seq, item_id, actor, action) applied in order: the first allowed decision on an item counts.

    Decisions on one target follow each other in rounds, which is their place in
    the order of the target; a target that has changed, before or by a decision of
    the batch, refuses quality items.  Returns (seq, item_id, outcome, round, effect).

    The first save of a target is the earliest allowed one whose item no decision
    without a save had resolved before; a save before it on the same item would be
    an earlier save of the target.  So what stands before a decision is known from
    two minima, and none waits for another.
    """
    now = corpus.select(F.col("id").alias("target_id"), F.lit(True).alias("there"), F.col("owner_id").alias("target_owner"), fingerprint("title", "status", "body").alias("now"))
    rows = decisions.join(items.select("item_id", "owner_id", "kind", "status", "target_id", "fingerprint", F.length(F.trim("body")).alias("n_chars"), F.lit(True).alias("known")), "item_id", "left").join(now, "target_id", "left")
    needs_target = F.col("action").isin("adopt_new", "merge")
    refusal = (
        F.when(F.col("known").isNull(), "not-found")
        .when((F.col("owner_id") != F.col("actor")) & (F.col("actor") != "admin"), "out-of-scope")
        .when(F.col("status") == "resolved", "already-resolved")
        .when(~F.col("action").isin("keep_old", "adopt_new", "merge", "keep_both"), "unsupported")
        .when((F.col("kind") == "quality_risk") & (F.col("action") == "keep_both"), "unsupported")
        .when((F.col("action") != "keep_old") & (F.coalesce("n_chars", F.lit(0)) == 0), "empty-body")
        .when(needs_target & F.col("there").isNull(), "target-missing")
        .when((F.col("kind") == "quality_risk") & needs_target & ~F.col("fingerprint").eqNullSafe(F.col("now")), "target-changed")
    )
    rows = rows.withColumn("refusal", refusal)
    allowed = F.col("refusal").isNull()
    settled = F.min(F.when(allowed & ~needs_target, F.col("seq"))).over(Window.partitionBy("item_id"))
    saves = allowed & needs_target & (F.col("settled").isNull() | (F.col("seq") < F.col("settled")))
    changed = F.min(F.when(saves, F.col("seq"))).over(Window.partitionBy("target_id"))
    late = allowed & needs_target & (F.col("kind") == "quality_risk") & (F.col("seq") > F.col("changed")) & (F.col("settled").isNull() | (F.col("seq") < F.col("settled")))
    rows = rows.withColumn("settled", settled).withColumn("changed", changed).withColumn("refusal", F.when(late, "target-changed").otherwise(F.col("refusal")))
    first = F.row_number().over(Window.partitionBy("item_id", F.col("refusal").isNull()).orderBy("seq"))
    rows = rows.withColumn("n", first).withColumn("refusal", F.coalesce("refusal", F.when(F.col("n") > 1, "already-resolved")))
    effect = F.when(F.col("refusal").isNull(), F.when(F.col("action") == "keep_old", "none").when(F.col("action") == "keep_both", "create").otherwise("save"))
    rows = rows.withColumn("effect", effect)
    turn = F.row_number().over(Window.partitionBy("target_id", F.col("effect") == "save").orderBy("seq"))
    return rows.select("seq", "item_id", F.coalesce("refusal", F.lit("resolved")).alias("outcome"), F.when(F.col("effect") == "save", turn).alias("round"), "effect")
