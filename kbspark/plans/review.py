"""Queries of the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as op
from ..operators.curate import fingerprint
from ..registry import register
from . import fixtures as fx
from .duck import sql


def items(spark, d):
    """Review items with the fingerprint of their target, changed since for edited ones."""
    now = fx.corpus(spark, d).select(F.col("id").alias("target_id"), fingerprint("title", "status", "body").alias("fp"))
    rows = fx.review_pending(spark, d).join(now, "target_id", "left")
    return rows.withColumn("fingerprint", F.when(F.col("edited"), F.lit("old")).otherwise(F.col("fp"))).drop("fp")


@register("review_enqueue", sql("""
WITH n AS (SELECT seq, owner_id, 'sha256:' || sha256(replace(body, ' altered', '') || CASE WHEN seq % 2 = 0 THEN ' revised' ELSE '' END) AS content_hash, CASE WHEN seq % 4 <> 0 THEN seq END AS target_id, title FROM bundle_rows),
f AS (SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM review_pending p WHERE p.status = 'pending' AND p.owner_id = n.owner_id AND p.content_hash = n.content_hash AND p.target_id IS NOT DISTINCT FROM n.target_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY owner_id, content_hash, target_id ORDER BY seq) AS place FROM f) SELECT seq, owner_id, content_hash, target_id, title FROM r WHERE place = 1"""))
def review_enqueue(spark, d):
    body = F.expr("concat(replace(body, ' altered', ''), CASE WHEN seq % 2 = 0 THEN ' revised' ELSE '' END)")
    new = fx.bundle_rows(spark, d).select("seq", "owner_id", F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256)).alias("content_hash"), F.expr("CASE WHEN seq % 4 <> 0 THEN seq END").alias("target_id"), "title")
    return op.review_enqueue(new, fx.review_pending(spark, d))


@register("review_list", sql("""
WITH p AS (SELECT * FROM review_pending WHERE status = 'pending' ORDER BY created_on DESC, item_id LIMIT 50)
SELECT item_id, kind, source, p.title, target_id, c.title AS target_title, target_id IS NOT NULL AND (c.id IS NULL OR edited) AS stale FROM p LEFT JOIN corpus c ON c.id = target_id"""))
def review_list(spark, d):
    return op.review_list(items(spark, d), fx.corpus(spark, d), "pending")


@register("review_counts", sql("SELECT status, kind, source, grouping(status, kind, source) AS level, count(*) AS n FROM review_pending GROUP BY CUBE (status, kind, source)"))
def review_counts(spark, d):
    return op.review_counts(fx.review_pending(spark, d))


@register("review_resolve", sql("""
WITH de AS (SELECT item_id * 2 + k AS seq, CASE WHEN item_id % 13 = 0 THEN -item_id ELSE item_id END AS item_id, ['keep_old', 'adopt_new', 'merge', 'keep_both', 'other'][CAST((item_id + k) % 5 AS INT) + 1] AS action, CASE WHEN item_id % 8 = 5 THEN 'nobody' ELSE 'admin' END AS actor FROM review_pending, (VALUES (0), (1)) AS ks(k)),
j AS (SELECT de.*, p.item_id IS NOT NULL AS known, p.kind, p.status, p.target_id, p.edited, c.id IS NOT NULL AS there FROM de LEFT JOIN review_pending p ON p.item_id = de.item_id LEFT JOIN corpus c ON c.id = p.target_id),
r0 AS (SELECT *, CASE WHEN NOT known THEN 'not-found' WHEN actor <> 'admin' THEN 'out-of-scope' WHEN status = 'resolved' THEN 'already-resolved' WHEN action = 'other' OR (kind = 'quality_risk' AND action = 'keep_both') THEN 'unsupported'
  WHEN action IN ('adopt_new', 'merge') AND NOT there THEN 'target-missing' WHEN kind = 'quality_risk' AND action IN ('adopt_new', 'merge') AND edited THEN 'target-changed' END AS refusal FROM j),
s AS (SELECT *, min(CASE WHEN refusal IS NULL AND action NOT IN ('adopt_new', 'merge') THEN seq END) OVER (PARTITION BY item_id) AS settled FROM r0),
c AS (SELECT *, min(CASE WHEN refusal IS NULL AND action IN ('adopt_new', 'merge') AND (settled IS NULL OR seq < settled) THEN seq END) OVER (PARTITION BY target_id) AS changed FROM s),
r AS (SELECT * EXCLUDE (refusal), CASE WHEN refusal IS NULL AND kind = 'quality_risk' AND action IN ('adopt_new', 'merge') AND seq > changed AND (settled IS NULL OR seq < settled) THEN 'target-changed' ELSE refusal END AS refusal FROM c),
n AS (SELECT *, coalesce(refusal, CASE WHEN row_number() OVER (PARTITION BY item_id, refusal IS NULL ORDER BY seq) > 1 THEN 'already-resolved' END) AS no FROM r),
e AS (SELECT *, CASE WHEN no IS NULL THEN CASE action WHEN 'keep_old' THEN 'none' WHEN 'keep_both' THEN 'create' ELSE 'save' END END AS effect FROM n)
SELECT seq, item_id, coalesce(no, 'resolved') AS outcome, CASE WHEN effect = 'save' THEN CAST(row_number() OVER (PARTITION BY target_id, effect = 'save' ORDER BY seq) AS INT) END AS round, effect FROM e"""))
def review_resolve(spark, d):
    two = fx.review_pending(spark, d).select("item_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    decisions = two.selectExpr("item_id * 2 + k AS seq", "CASE WHEN item_id % 13 = 0 THEN -item_id ELSE item_id END AS item_id", "element_at(array('keep_old', 'adopt_new', 'merge', 'keep_both', 'other'), CAST((item_id + k) % 5 AS INT) + 1) AS action", "CASE WHEN item_id % 8 = 5 THEN 'nobody' ELSE 'admin' END AS actor")
    return op.review_resolve(decisions, items(spark, d), fx.corpus(spark, d))
