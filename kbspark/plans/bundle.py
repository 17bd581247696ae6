"""Queries over bundles and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import register
from ..session import new_dir
from ..sources import bundle as op
from . import fixtures as fx
from .duck import sql


@register("bundle_write")
def bundle_write(spark, d):
    return op.bundle_write(fx.corpus(spark, d), new_dir(spark, "bundle-files"))


@register("bundle_read", sql("SELECT id, title, type, description, category, status, array_to_string(tags, ',') AS tags, sha256(body) AS body_sha FROM corpus WHERE trim(body) <> ''"))
def bundle_read(spark, d):
    """All live concepts, written as files and read back."""
    uri = new_dir(spark, "bundle-files")
    written = op.bundle_write(fx.corpus(spark, d), uri)
    return op.bundle_read(spark, uri, written).where("error IS NULL").select("id", "title", "type", "description", "category", "status", F.array_join("tags", ",").alias("tags"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha"))


@register("bundle_manifest", sql("""
WITH r AS (SELECT CASE WHEN status = 'deprecated' THEN 'deprecated/' ELSE '' END || lower(type) || 's' AS dir, title, id, CAST(updated_at AS DATE) AS d FROM corpus)
SELECT dir, CAST(place // 500 AS INT) AS page, count(*) AS n, md5(string_agg('- ' || title, chr(10) ORDER BY title, id)) AS listing, (SELECT max(d) FROM r) AS exported_at
  FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY title, id) - 1 AS place FROM r) GROUP BY 1, 2"""))
def bundle_manifest(spark, d):
    return op.bundle_manifest(fx.corpus(spark, d))


@register("bundle_classify")
def bundle_classify(spark, d):
    return op.bundle_classify(fx.bundle_rows(spark, d), fx.corpus(spark, d))


@register("bundle_classify_apart", sql("""
WITH h AS (SELECT DISTINCT content_hash FROM corpus), t AS (SELECT DISTINCT lower(title) AS t FROM corpus),
b AS (SELECT 1000000 + id AS seq, id || ' ' || title AS title, CASE WHEN id % 3 = 0 THEN content_hash ELSE 'new ' || id END AS content_hash FROM corpus UNION ALL SELECT 2000000 + min(id), title, 'other ' || min(id) FROM corpus GROUP BY title),
f AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY seq) AS n FROM b)
SELECT seq, CASE WHEN content_hash IN (SELECT content_hash FROM h) THEN 'duplicate' WHEN lower(title) IN (SELECT t FROM t) THEN 'conflict' ELSE 'create' END AS verdict FROM f"""))
def bundle_classify_apart(spark, d):
    """A bundle whose rows do not collide with each other."""
    corpus = fx.corpus(spark, d)
    a = corpus.selectExpr("1000000 + id AS seq", "concat(id, ' ', title) AS title", "CASE WHEN id % 3 = 0 THEN content_hash ELSE concat('new ', id) END AS content_hash")
    b = corpus.groupBy("title").agg(F.min("id").alias("id")).selectExpr("2000000 + id AS seq", "title", "concat('other ', id) AS content_hash")
    return op.bundle_classify(a.unionByName(b), corpus)


@register("attachment_scan", sql("""
WITH f AS (SELECT 'key-' || page_id AS storage_key, CAST(page_id % 8 AS INT) AS k FROM pages)
SELECT storage_key, CASE k WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN NULL WHEN 3 THEN 'application/octet-stream' WHEN 4 THEN 'application/pdf' WHEN 5 THEN 'image/webp' WHEN 6 THEN 'image/gif' ELSE 'text/plain' END AS stored_as,
  CASE WHEN k = 2 THEN 'rejected' ELSE 'stored' END AS verdict FROM f"""))
def attachment_scan(spark, d):
    """The pages' html as files, behind the leading bytes of several kinds."""
    head = "element_at(array('89504E470D0A1A0A', 'FFD8FF', '00', '00', '255044462D', '524946460000000057454250', '474946383961', '00'), CAST(page_id % 8 AS INT) + 1)"
    kind = "element_at(array('image/png', 'image/jpeg', 'image/png', 'text/html', 'application/pdf', 'application/octet-stream', 'image/gif', 'text/plain'), CAST(page_id % 8 AS INT) + 1)"
    files = fx.table(spark, d, "pages").selectExpr("concat('key-', page_id) AS storage_key", f"{kind} AS declared", f"concat(unhex({head}), CAST(coalesce(html, '') AS BINARY)) AS content")
    return op.attachment_scan(files)


@register("attachment_audit", sql("""
SELECT storage_key, CASE WHEN has_metadata THEN 'missing' ELSE 'orphaned' END AS finding FROM (SELECT storage_key, has_metadata, has_file AND NOT uploading AS f FROM attachments) WHERE has_metadata <> f"""))
def attachment_audit(spark, d):
    rows = fx.attachments(spark, d)
    files = rows.where("has_file").select(F.expr("CASE WHEN uploading THEN concat(storage_key, '.uploading') ELSE storage_key END").alias("storage_key"))
    return op.attachment_audit(rows.where("has_metadata"), files)


@register("attachment_usage", sql("""
SELECT storage_key, owner_id, CAST(used AS BIGINT) AS used, used > 50000 AS over FROM (SELECT storage_key, owner_id, sum(size_bytes) OVER (PARTITION BY owner_id ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM attachments a JOIN corpus_rows c ON c.id = a.concept_id)"""))
def attachment_usage(spark, d):
    return op.attachment_usage(fx.attachments(spark, d), fx.corpus_rows(spark, d), 50_000)
