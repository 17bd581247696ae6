"""Queries of curation, ingest and quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curate as op
from ..operators import links
from ..registry import register
from . import fixtures as fx
from .duck import sql

AS_OF = "2024-01-31"


@register("dup_groups", sql("""SELECT content_hash, n, first_id, id, title FROM (
  SELECT content_hash, count(*) OVER g AS n, first_value(id) OVER (g ORDER BY title, id) AS first_id, id, title FROM corpus WINDOW g AS (PARTITION BY content_hash)) WHERE n > 1"""))
def dup_groups(spark, d):
    return op.dup_groups(fx.corpus(spark, d))


@register("missing_description", sql("SELECT id, title FROM corpus WHERE coalesce(description, '') = '' AND status = 'stable'"))
def missing_description(spark, d):
    return op.missing_description(fx.corpus(spark, d))


@register("missing_description_batch", sql("SELECT id, title FROM corpus WHERE trim(coalesce(description, '')) = '' ORDER BY updated_at DESC, id LIMIT 50"))
def missing_description_batch(spark, d):
    return op.missing_description(fx.corpus(spark, d), stable_only=False, limit=50)


@register("stale_concepts", sql("SELECT id, title, CAST(updated_at AS DATE) AS updated_on FROM corpus WHERE updated_at < TIMESTAMP '2024-01-31' - INTERVAL 180 DAY"))
def stale_concepts(spark, d):
    return op.stale_concepts(fx.corpus(spark, d), AS_OF)


@register("curate_report", sql("""
WITH f AS (SELECT 'duplicates' AS section FROM (SELECT content_hash FROM corpus GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'dangling' FROM (SELECT DISTINCT id, target FROM links WHERE lower(target) NOT IN (SELECT lower(title) FROM corpus))
UNION ALL SELECT 'no-description' FROM corpus WHERE coalesce(description, '') = '' AND status = 'stable' UNION ALL SELECT 'stale' FROM corpus WHERE updated_at < TIMESTAMP '2024-01-31' - INTERVAL 180 DAY
UNION ALL SELECT 'title-repeat' FROM headed_corpus UNION ALL SELECT 'unlinked' FROM mentions)
SELECT section, count(*) AS n FROM f GROUP BY GROUPING SETS ((section), ())"""))
def curate_report(spark, d):
    corpus = fx.corpus(spark, d)
    return op.curate_report(
        {
            "duplicates": op.dup_groups(corpus).where("id = first_id"),
            "dangling": links.link_dangling(links.link_extract(fx.linked_corpus(spark, d)), corpus),
            "no-description": op.missing_description(corpus),
            "stale": op.stale_concepts(corpus, AS_OF),
            "title-repeat": links.title_repeat(fx.headed_corpus(spark, d)),
            "unlinked": links.mention_counts(fx.linked_corpus(spark, d)).withColumnRenamed("n", "weight"),
        }
    )


@register("curate_findings", sql("""
WITH f AS (SELECT 'duplicates' AS section, id, content_hash AS detail FROM (SELECT id, content_hash, count(*) OVER (PARTITION BY content_hash) AS n FROM corpus) WHERE n > 1
UNION ALL SELECT DISTINCT 'dangling', id, target FROM links WHERE lower(target) NOT IN (SELECT lower(title) FROM corpus)
UNION ALL SELECT 'no-description', id, title FROM corpus WHERE coalesce(description, '') = '' AND status = 'stable'
UNION ALL SELECT 'stale', id, CAST(CAST(updated_at AS DATE) AS VARCHAR) FROM corpus WHERE updated_at < TIMESTAMP '2024-01-31' - INTERVAL 180 DAY
UNION ALL SELECT 'title-repeat', id, title FROM headed_corpus
UNION ALL SELECT 'unlinked', target_id, CAST(count(*) AS VARCHAR) FROM mentions GROUP BY target_id),
r AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY id, detail) AS place FROM f)
SELECT section, CAST(place AS INT) AS place, id, detail FROM r WHERE place <= 50"""))
def curate_findings(spark, d):
    corpus = fx.corpus(spark, d)
    return op.curate_findings(
        {
            "duplicates": op.dup_groups(corpus).withColumn("detail", F.col("content_hash")),
            "dangling": links.link_dangling(links.link_extract(fx.linked_corpus(spark, d)), corpus).withColumn("detail", F.col("target")),
            "no-description": op.missing_description(corpus).withColumn("detail", F.col("title")),
            "stale": op.stale_concepts(corpus, AS_OF).withColumn("detail", F.col("updated_on").cast("string")),
            "title-repeat": links.title_repeat(fx.headed_corpus(spark, d)).withColumn("detail", F.col("title")),
            "unlinked": links.mention_counts(fx.linked_corpus(spark, d)).withColumn("detail", F.col("n").cast("string")),
        }
    )


DIGEST = """
r AS (SELECT * FROM corpus_rows WHERE updated_at >= TIMESTAMP '2024-01-31' - INTERVAL 60 DAY ORDER BY updated_at DESC, id LIMIT 200),
s AS (SELECT *, count(*) OVER (PARTITION BY category) AS group_size FROM r),
g AS (SELECT CAST(row_number() OVER (ORDER BY group_size DESC, category, updated_at DESC, id) AS INT) AS place, id, category, group_size, CASE WHEN created_at >= TIMESTAMP '2024-01-31' - INTERVAL 60 DAY THEN 'new' ELSE 'updated' END AS tag, title, description FROM s)
"""


@register("change_digest", sql(f"WITH {DIGEST} SELECT * FROM g"))
def change_digest(spark, d):
    return op.change_digest(fx.corpus_rows(spark, d), AS_OF, 60)


@register("digest_budget", sql(f"""WITH {DIGEST}, l AS (SELECT place, substr('- [' || tag || '] ' || title || ': ' || coalesce(description, ''), 1, 220) AS line FROM g),
u AS (SELECT *, coalesce(sum(length(line)) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM l) SELECT place, line FROM u WHERE place <= 40 AND used < 6000"""))
def digest_budget(spark, d):
    return op.digest_budget(op.change_digest(fx.corpus_rows(spark, d), AS_OF, 60))


@register("quality_sample")
def quality_sample(spark, d):
    return op.quality_sample(fx.corpus(spark, d))


@register("spot_report", sql("""
SELECT id AS report_id, id, owner_id, 'quality_risk' AS kind, CASE id % 4 WHEN 0 THEN 'Outdated' WHEN 1 THEN 'Incorrect' WHEN 2 THEN 'Unclear' ELSE 'Other' END || ': see ' || title AS reason FROM corpus"""))
def spot_report(spark, d):
    corpus = fx.corpus(spark, d)
    reports = corpus.select(F.col("id").alias("report_id"), "id", F.expr("element_at(array('outdated', 'incorrect', 'unclear', 'strange'), CAST(id % 4 AS INT) + 1)").alias("issue"), F.concat(F.lit(" see "), "title").alias("note"))
    return op.spot_report(reports, corpus).drop("fingerprint")


@register("assessment_parse", sql("""
SELECT id, CASE WHEN length(body) > 12000 THEN 'skipped' WHEN id % 5 = 4 THEN 'unreadable' ELSE 'ok' END AS status, length(body) <= 12000 AND id % 5 IN (0, 1) AND id % 3 > 0 AS risk,
  CASE WHEN length(body) <= 12000 AND id % 5 IN (0, 1) AND id % 3 > 0 THEN CASE WHEN id % 5 = 0 THEN 'high' ELSE 'medium' END END AS level, CASE WHEN length(body) <= 12000 AND id % 5 <> 4 THEN CAST(id % 3 AS INT) ELSE 0 END AS n_findings FROM corpus"""))
def assessment_parse(spark, d):
    """Assessments with zero to two whole findings and one without evidence; every fifth is not JSON."""
    one = """'{"claim":"c","evidence":"e","recommendation":"r"},'"""
    raw = f"""CASE WHEN id % 5 = 4 THEN 'no json' ELSE concat('{{"risk":', CASE WHEN id % 5 < 2 THEN 'true' ELSE 'false' END, ',"level":"', CASE WHEN id % 5 = 0 THEN 'high' ELSE 'odd' END, '","findings":[', repeat({one}, CAST(id % 3 AS INT)), '{{"claim":"c","evidence":" ","recommendation":"r"}}]}}') END"""
    return op.assessment_parse(fx.corpus(spark, d).select("id", F.length("body").alias("n_chars"), F.expr(raw).alias("raw")))


@register("ingest_chunk")
def ingest_chunk(spark, d):
    return op.ingest_chunk(fx.headed_corpus(spark, d).select(F.concat(F.lit("doc-"), "id").alias("file"), F.col("body").alias("text")))


@register("candidate_validate", sql("""
WITH c AS (SELECT owner_id AS run_id, id AS seq, CASE WHEN id % 6 = 0 THEN 'x' ELSE substr(title, 1, 200) END AS title, CASE WHEN id % 8 = 0 THEN 'short' ELSE trim(body) END AS body, description, CASE WHEN id % 2 = 0 THEN 'kb/' || category WHEN id % 3 = 0 THEN category END AS category, tags FROM corpus),
r AS (SELECT *, CASE WHEN length(title) < 2 THEN 'title' WHEN length(body) < 30 THEN 'body' END AS bad FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, bad IS NULL ORDER BY seq) AS n FROM r)
SELECT run_id, seq, title, CAST(length(body) AS INT) AS n_chars, description, CASE WHEN category IS NULL THEN 'kb' WHEN starts_with(category, 'kb') THEN category ELSE 'kb/' || category END AS category, tags[1] AS first_tag, coalesce(bad, CASE WHEN n > 30 THEN 'cap' END) AS reason FROM n"""))
def candidate_validate(spark, d):
    rows = fx.corpus(spark, d).select(F.col("owner_id").alias("run_id"), F.col("id").alias("seq"), F.expr("CASE WHEN id % 6 = 0 THEN ' x ' ELSE title END").alias("title"), F.expr("CASE WHEN id % 8 = 0 THEN 'short' ELSE body END").alias("body"), "description", F.expr("CASE WHEN id % 2 = 0 THEN concat('kb/', category) WHEN id % 3 = 0 THEN category END").alias("category"), "tags")
    return op.candidate_validate(rows, "kb", 30).withColumn("first_tag", F.col("tags")[0]).drop("tags")


HITS = "h AS (SELECT b.seq, CAST(k AS INT) AS rank, (b.seq + k * 7) % (SELECT count(*) FROM documents) AS id, CAST((b.seq * 13 + k * 5) % 60 AS DOUBLE) / k AS score FROM bundle_rows b, (VALUES (1), (2), (3), (4), (5), (6)) AS ks(k))"


def _hits(spark, d, rows):
    """Six hits for every row, by fixed numbers."""
    n = F.broadcast(fx.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n")))
    spread = rows.select("seq", F.explode(F.array(*map(F.lit, range(1, 7)))).alias("rank")).crossJoin(n)
    return spread.select("seq", "rank", F.expr("(seq + rank * 7) % n").alias("id"), F.expr("CAST((seq * 13 + rank * 5) % 60 AS DOUBLE) / rank").alias("score"))


@register("ingest_route", sql(f"""WITH {HITS}, x AS (SELECT b.seq, min_by(h.id, h.rank) AS target_id FROM bundle_rows b JOIN h ON h.seq = b.seq AND h.rank <= 5 JOIN corpus_rows c ON c.id = h.id WHERE lower(c.title) = lower(b.title) OR (h.rank = 1 AND h.score >= 25) GROUP BY 1)
SELECT b.seq, CASE WHEN b.seq % 10 = 9 THEN 'unchecked' WHEN target_id IS NOT NULL THEN 'near-duplicate' ELSE 'create' END AS verdict, CASE WHEN b.seq % 10 <> 9 THEN target_id END AS target_id FROM bundle_rows b LEFT JOIN x USING (seq)"""))
def ingest_route(spark, d):
    rows = fx.bundle_rows(spark, d)
    hits = _hits(spark, d, rows).join(fx.corpus_rows(spark, d).select("id", "title"), "id")
    return op.ingest_route(rows.select("seq", "title", F.expr("seq % 10 <> 9").alias("looked_up")), hits)


CLAIMS = r"""
s AS (SELECT id, string_split(body, '.') AS parts FROM corpus), p AS (SELECT id, generate_subscripts(parts, 1) - 1 AS pos, unnest(parts) AS t FROM s),
q AS (SELECT id, pos, substr(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 200) AS text FROM p), f AS (SELECT id, lower(text) AS k, min(pos) AS pos, arg_min(text, pos) AS text FROM q WHERE text <> '' GROUP BY 1, 2),
n AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pos) AS INT) AS claim_no, text FROM f)
"""


@register("claim_normalize", sql(f"WITH {CLAIMS} SELECT id, claim_no, text, substr(text, 1, 20) AS quote FROM n WHERE claim_no <= 8"))
def claim_normalize(spark, d):
    """Every sentence of every body as a claim, quoted by its first twenty characters."""
    claims = F.expr("transform(split(body, '[.]'), t -> struct(t AS text, t AS quote))")
    return op.claim_normalize(fx.corpus(spark, d).select("id", claims.alias("claims"))).withColumn("quote", F.substring("quote", 1, 20))


@register("claim_gate", sql(f"""WITH {HITS}, m AS (SELECT h.*, CASE WHEN h.seq % 2 = 0 THEN h.score / 60 END AS similarity, row_number() OVER (PARTITION BY h.seq ORDER BY rank, h.id) AS place FROM h JOIN corpus c ON c.id = h.id WHERE h.id <> h.seq),
t AS (SELECT seq FROM m WHERE place = 1 AND CASE WHEN similarity IS NOT NULL THEN similarity >= 0.25 ELSE score >= 5 END) SELECT seq AS claim_id, CAST(place AS INT) AS place, id FROM m WHERE place <= 3 AND seq IN (SELECT seq FROM t)"""))
def claim_gate(spark, d):
    rows = fx.bundle_rows(spark, d)
    hits = _hits(spark, d, rows).selectExpr("seq AS claim_id", "rank", "id", "score", "CASE WHEN seq % 2 = 0 THEN score / 60 END AS similarity")
    return op.claim_gate(rows.selectExpr("seq AS claim_id", "seq AS source_id"), hits, fx.corpus(spark, d))


@register("claim_findings", sql(f"""WITH {HITS}, c AS (SELECT h.seq AS claim_id, rank AS place, h.id, title FROM h JOIN corpus c ON c.id = h.id WHERE rank <= 3),
v AS (SELECT seq AS claim_id, CASE WHEN seq % 4 = 0 THEN 'support' ELSE 'contradiction' END AS verdict, CASE seq % 3 WHEN 0 THEN ((seq + 7) % (SELECT count(*) FROM documents))::VARCHAR WHEN 1 THEN 'nothing' ELSE (SELECT any_value(upper(title)) FROM c WHERE c.claim_id = seq AND place = 2) END AS target FROM bundle_rows),
b AS (SELECT v.claim_id, arg_min(id, (CASE WHEN id::VARCHAR = target THEN 1 WHEN lower(title) = lower(trim(target)) THEN 3 END * 10 + place)) AS target_id FROM v JOIN c USING (claim_id) WHERE verdict = 'contradiction' AND (id::VARCHAR = target OR lower(title) = lower(trim(target))) GROUP BY 1)
SELECT claim_id, CASE WHEN verdict = 'contradiction' AND target_id IS NULL THEN 'unrelated' ELSE verdict END AS verdict, target_id FROM v LEFT JOIN b USING (claim_id)"""))
def claim_findings(spark, d):
    rows = fx.bundle_rows(spark, d)
    n = F.broadcast(fx.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n")))
    candidates = _hits(spark, d, rows).where("rank <= 3").join(fx.corpus(spark, d).select("id", "title"), "id").selectExpr("seq AS claim_id", "rank AS place", "id", "title")
    second = candidates.where("place = 2").select("claim_id", F.upper("title").alias("second"))
    verdicts = rows.select(F.col("seq").alias("claim_id")).crossJoin(n).join(second, "claim_id", "left").selectExpr("claim_id", "CASE WHEN claim_id % 4 = 0 THEN 'support' ELSE 'contradiction' END AS verdict", "CASE claim_id % 3 WHEN 0 THEN CAST((claim_id + 7) % n AS STRING) WHEN 1 THEN 'nothing' ELSE second END AS target")
    return op.claim_findings(verdicts, candidates)


@register("write_triage", sql("""
WITH r AS (SELECT id AS request_id, length(body) AS n_chars, ['ok', 'merge', 'conflict', 'merge'][CAST(id % 4 AS INT) + 1] AS verdict, CASE WHEN id % 8 < 4 THEN id + 1 ELSE id + 2 END AS target, id FROM corpus),
k AS (SELECT r.request_id, r.id + 1 AS cid, c.id IS NOT NULL AS there, coalesce(length(c.body), 0) AS n FROM r LEFT JOIN corpus c ON c.id = r.id + 1 WHERE r.request_id % 5 > 0),
m AS (SELECT r.*, k.cid, k.there, coalesce(r.n_chars > 12000 OR k.n > 12000, r.n_chars > 12000) AS big FROM r LEFT JOIN k USING (request_id)),
o AS (SELECT *, CASE WHEN NOT there THEN 'conflict' WHEN cid IS NULL THEN 'ok' WHEN big THEN CASE WHEN verdict = 'merge' THEN 'merge' ELSE 'conflict' END WHEN verdict = 'ok' THEN 'ok' WHEN verdict = 'merge' AND target = cid THEN 'merge' ELSE 'conflict' END AS outcome FROM m)
SELECT request_id, outcome, CASE WHEN outcome = 'merge' THEN CASE WHEN big THEN cid ELSE target END END AS target_id FROM o"""))
def write_triage(spark, d):
    corpus = fx.corpus(spark, d)
    requests = corpus.selectExpr("id AS request_id", "length(body) AS n_chars", "element_at(array('ok', 'merge', 'conflict', 'merge'), CAST(id % 4 AS INT) + 1) AS verdict", "CASE WHEN id % 8 < 4 THEN id + 1 ELSE id + 2 END AS target")
    have = corpus.select("id", F.length("body").alias("n_chars"), F.lit(True).alias("there"))
    asked = corpus.where("id % 5 > 0").selectExpr("id AS request_id", "id + 1 AS id").join(have, "id", "left").select("request_id", "id", F.coalesce("there", F.lit(False)).alias("there"), F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    return op.write_triage(requests, asked)
