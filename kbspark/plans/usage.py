"""Queries of usage analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage as op
from ..registry import register
from . import fixtures as fx
from .duck import sql

AS_OF = "2024-01-31"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
AT = "2024-01-15 12:00:00"


def keys(spark, d):
    """Two keys of every user; some revoked, some expired."""
    rows = fx.users(spark, d).selectExpr("user_id", "CAST(regexp_extract(user_id, '([0-9]+)$', 1) AS INT) AS n", "explode(array(0, 1)) AS k")
    return rows.selectExpr(
        "CAST(n * 2 + k AS BIGINT) AS key_id", "user_id AS owner_id", "n % 7 = 3 AS revoked", "date_sub(DATE'2024-01-31', n) AS created_on", "CASE WHEN k = 1 THEN date_add(DATE'2024-01-25', n) END AS expires_on"
    )


KEYS = """keys AS (SELECT CAST(n * 2 + k AS BIGINT) AS key_id, user_id AS owner_id, n % 7 = 3 AS revoked, DATE '2024-01-31' - n AS created_on, CASE WHEN k = 1 THEN DATE '2024-01-25' + n END AS expires_on
  FROM (SELECT user_id, CAST(regexp_extract(user_id, '([0-9]+)$', 1) AS INT) AS n FROM users), (VALUES (0), (1)) AS ks(k))"""


@register("traffic_summary", sql(f"""
SELECT days, count(*) AS total, count(*) FILTER (WHERE status < 400) AS ok, count(*) FILTER (WHERE status >= 400) AS failed, CAST(round(avg(took_ms)) AS INT) AS avg_ms,
  CAST(round_even(quantile_cont(took_ms::DOUBLE, 0.5), 0) AS INT) AS p50_ms, CAST(round_even(quantile_cont(took_ms::DOUBLE, 0.95), 0) AS INT) AS p95_ms,
  floor(count(*) FILTER (WHERE status < 400)::DOUBLE / count(*) * 100 * 10 + 0.5) / 10 AS success_rate
FROM request_log, (VALUES (1), (7), (30)) AS w(days) WHERE ts >= {NOW} - to_days(days) GROUP BY days"""))
def traffic_summary(spark, d):
    return op.traffic_summary(fx.request_log(spark, d), AS_OF, [1, 7, 30])


@register("search_quality", sql(f"""
SELECT count(*) AS searches, count(*) FILTER (WHERE result_count = 0) AS zero_results, round(avg(result_count), 1) AS avg_hits,
  CAST(round_even(quantile_cont(took_ms::DOUBLE, 0.5), 0) AS INT) AS p50_ms, CAST(round_even(quantile_cont(took_ms::DOUBLE, 0.95), 0) AS INT) AS p95_ms,
  floor(count(*) FILTER (WHERE result_count = 0)::DOUBLE / count(*) * 100 * 10 + 0.5) / 10 AS zero_rate FROM search_log WHERE ts >= {NOW} - INTERVAL 30 DAY"""))
def search_quality(spark, d):
    return op.search_quality(fx.search_log(spark, d), AS_OF, 30)


@register("search_modes", sql(f"SELECT mode, count(*) AS n, count(*) FILTER (WHERE result_count = 0) AS zero FROM search_log WHERE ts >= {NOW} - INTERVAL 30 DAY GROUP BY 1"))
def search_modes(spark, d):
    return op.search_modes(fx.search_log(spark, d), AS_OF, 30)


@register("key_usage", sql(f"""WITH {KEYS}
SELECT key_id, owner_id, count(r.event_id) AS calls, count(*) FILTER (WHERE r.status < 400) AS ok_calls, count(*) FILTER (WHERE r.status < 400 AND r.method <> 'GET') AS contributions
FROM keys LEFT JOIN request_log r ON r.api_key_id = key_id AND r.ts >= {NOW} - INTERVAL 7 DAY WHERE NOT revoked GROUP BY 1, 2"""))
def key_usage(spark, d):
    return op.key_usage(keys(spark, d), fx.request_log(spark, d), AS_OF, 7)


@register("key_status", sql(f"WITH {KEYS} SELECT key_id, owner_id, revoked, NOT revoked AND (expires_on IS NULL OR expires_on > DATE '2024-01-31') AND NOT disabled AS usable, created_on FROM keys JOIN users ON user_id = owner_id"))
def key_status(spark, d):
    return op.key_status(keys(spark, d), fx.users(spark, d), AS_OF)


@register("top_retrieved", sql("SELECT id, title, retrieval_count, CAST(last_retrieved_at AS DATE) AS last_on FROM corpus WHERE retrieval_count > 0 ORDER BY retrieval_count DESC, last_retrieved_at DESC NULLS LAST, id LIMIT 50"))
def top_retrieved(spark, d):
    return op.top_retrieved(fx.corpus(spark, d))


@register("retrieval_counts", sql("""
WITH h AS (SELECT ts, unnest([event_id % 1000, (event_id * 7) % 1000]) AS id FROM search_log WHERE source <> 'ingest')
SELECT c.id, count(h.id) AS n, CAST(max(ts) AS VARCHAR)[1:19] AS last FROM corpus c LEFT JOIN h ON h.id = c.id GROUP BY 1"""))
def retrieval_counts(spark, d):
    hits = fx.search_log(spark, d).selectExpr("event_id", "ts", "source", "array(event_id % 1000, (event_id * 7) % 1000) AS ids")
    return op.retrieval_counts(fx.corpus(spark, d), hits).withColumn("last", F.date_format("last", "yyyy-MM-dd HH:mm:ss"))


@register("library_health", sql("""
WITH c AS (SELECT count(*) FILTER (WHERE deleted_at IS NULL) AS concepts, count(*) FILTER (WHERE deleted_at IS NULL AND status = 'deprecated') AS deprecated, count(*) FILTER (WHERE deleted_at IS NOT NULL) AS trash,
  count(*) FILTER (WHERE deleted_at IS NULL AND retrieval_count = 0) AS never_retrieved FROM corpus_rows),
o AS (SELECT concept_id, bool_or(stale) AS stale FROM chunk_vectors GROUP BY 1), e AS (SELECT count(*) AS embedded, count(*) FILTER (WHERE stale) AS stale FROM corpus JOIN o ON o.concept_id = id)
SELECT c.*, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM attachments) AS attachments, (SELECT sum(size_bytes)::BIGINT FROM attachments) AS bytes, e.*, floor(embedded::DOUBLE / concepts * 100 * 10 + 0.5) / 10 AS coverage FROM c, e"""))
def library_health(spark, d):
    return op.library_health(fx.corpus_rows(spark, d), fx.versions(spark, d), fx.attachments(spark, d), fx.chunk_vectors(spark, d))


@register("log_list", sql(f"""
SELECT event_id, user_id, status FROM request_log WHERE ts >= {NOW} - INTERVAL 20 DAY AND CAST(ts + INTERVAL 8 HOUR AS DATE) = DATE '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 100"""))
def log_list(spark, d):
    return op.log_list(fx.request_log(spark, d), AS_OF, days=20, day="2024-01-20").select("event_id", "user_id", "status")


@register("user_activity", sql(f"""WITH {KEYS}
SELECT user_id, role, disabled, coalesce(e.n, 0) AS entries, coalesce(k.n, 0) AS keys, CAST(last_login_at AS DATE) AS last_login_on FROM users
LEFT JOIN (SELECT owner_id, count(*) AS n FROM corpus GROUP BY 1) e ON e.owner_id = user_id LEFT JOIN (SELECT owner_id, count(*) AS n FROM keys WHERE NOT revoked GROUP BY 1) k ON k.owner_id = user_id"""))
def user_activity(spark, d):
    return op.user_activity(fx.users(spark, d), fx.corpus(spark, d), keys(spark, d))


@register("library_tiles", sql("""
SELECT owner_id, 'entries' AS tile, 0 AS rank, count(*) AS value FROM corpus GROUP BY 1 UNION ALL SELECT owner_id, 'sources', 0, count(*) FROM save_feed GROUP BY 1
UNION ALL SELECT owner_id, 'pending', 0, count(*) FROM review_pending WHERE status = 'pending' GROUP BY 1 UNION ALL SELECT owner_id, 'quality_risks', 0, count(*) FROM review_pending WHERE status = 'pending' AND kind = 'quality_risk' GROUP BY 1
UNION ALL SELECT owner_id, 'recent', CAST(rank AS INT), id FROM (SELECT owner_id, id, row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, id) AS rank FROM corpus) WHERE rank <= 10"""))
def library_tiles(spark, d):
    return op.library_tiles(fx.corpus(spark, d), fx.save_feed(spark, d), fx.review_pending(spark, d))


@register("budget_snapshot", sql(f"""
WITH n AS (SELECT TIMESTAMP '{AT}' AS now), s AS (SELECT actor, actual IS NULL AND expires_at > now AS active, ts > now - INTERVAL 1 MINUTE AS minute,
  CAST(ts + INTERVAL 8 HOUR AS DATE) = CAST(now + INTERVAL 8 HOUR AS DATE) AS today, coalesce(actual, reserved) AS tokens, now, expires_at FROM model_calls, n WHERE ts <= now)
SELECT actor, count(*) FILTER (WHERE active) AS active, count(*) FILTER (WHERE minute) AS last_minute, CAST(sum(CASE WHEN today THEN tokens ELSE 0 END) AS BIGINT) AS tokens_today FROM s WHERE today OR minute OR expires_at > now GROUP BY GROUPING SETS ((actor), ())"""))
def budget_snapshot(spark, d):
    return op.budget_snapshot(fx.model_calls(spark, d), AT)


@register("admission_replay")
def admission_replay(spark, d):
    return op.admission_replay(fx.model_calls(spark, d))
