"""Queries over the versioned corpus and its folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import corpus as op
from ..operators import folders as tree
from ..registry import register
from . import fixtures as fx
from .duck import sql

META = ["title", "description", "category", "status", "type"]


def _feed(spark, d):
    return fx.save_feed(spark, d).select("concept_id", "seq", *META, "body", "saved_on")


FOLD = """
h AS (SELECT *, 'sha256:' || sha256(body) AS content_hash FROM save_feed),
c AS (SELECT *, CASE WHEN lag(content_hash) OVER w IS DISTINCT FROM content_hash THEN 1 ELSE 0 END AS ch FROM h WINDOW w AS (PARTITION BY concept_id ORDER BY seq)),
n AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY concept_id ORDER BY seq) AS INT) AS version_number FROM c),
v AS (SELECT concept_id, version_number, max_by(title, seq) AS title, arg_max_null(description, seq) AS description, max_by(category, seq) AS category, max_by(status, seq) AS status, max_by(type, seq) AS type,
  min_by(content_hash, seq) AS content_hash, min_by(body, seq) AS body, min(saved_on) AS created_on, max(saved_on) AS updated_on FROM n GROUP BY 1, 2)
"""


@register("corpus_current", sql("""
SELECT c.id, c.owner_id, c.title, c.current_version, u.username, sha256(v.body) AS body_sha, coalesce(a.n, 0) AS attachment_count
FROM corpus c JOIN versions v ON v.concept_id = c.id AND v.version_number = c.current_version LEFT JOIN users u ON u.user_id = c.owner_id
LEFT JOIN (SELECT concept_id, count(*) AS n FROM attachments GROUP BY 1) a ON a.concept_id = c.id"""))
def corpus_current(spark, d):
    rows = op.corpus_current(fx.corpus_rows(spark, d), fx.versions(spark, d), fx.users(spark, d), fx.attachments(spark, d))
    return rows.select("id", "owner_id", "title", "current_version", "username", F.sha2(F.col("version_body").cast("binary"), 256).alias("body_sha"), "attachment_count")


@register("version_fold", sql(f"WITH {FOLD} SELECT concept_id, version_number, title, description, category, status, type, content_hash, created_on, updated_on FROM v"))
def version_fold(spark, d):
    return op.version_fold(_feed(spark, d), META).drop("body")


@register("current_state", sql(f"""WITH {FOLD}
SELECT concept_id, max(version_number) AS current_version, max_by(title, version_number) AS title, arg_max_null(description, version_number) AS description, max_by(category, version_number) AS category,
  max_by(status, version_number) AS status, max_by(type, version_number) AS type, max_by(content_hash, version_number) AS content_hash, min(created_on) AS created_on, max(updated_on) AS updated_on FROM v GROUP BY 1"""))
def current_state(spark, d):
    return op.current_state(op.version_fold(_feed(spark, d), META), META)


@register("version_restore", sql(f"""WITH {FOLD},
r AS (SELECT concept_id, 4 AS seq, title, description, category, status, type, body, DATE '2024-01-31' AS saved_on FROM v WHERE concept_id % 2 = 0 AND version_number = 1),
f AS (SELECT concept_id, seq, title, description, category, status, type, body, saved_on FROM save_feed UNION ALL SELECT * FROM r),
h2 AS (SELECT *, sha256(body) AS ch FROM f), c2 AS (SELECT *, CASE WHEN lag(ch) OVER (PARTITION BY concept_id ORDER BY seq) IS DISTINCT FROM ch THEN 1 ELSE 0 END AS n FROM h2)
SELECT concept_id, CAST(sum(n) AS INT) AS versions, max_by(title, seq) AS title, 'sha256:' || max_by(ch, seq) AS content_hash, max(saved_on) AS updated_on FROM c2 GROUP BY 1"""))
def version_restore(spark, d):
    feed = _feed(spark, d)
    versions = op.version_fold(feed, META)
    requests = versions.where("concept_id % 2 = 0 AND version_number = 1").select("concept_id", "version_number", F.lit(4).alias("seq"), F.lit("2024-01-31").cast("date").alias("saved_on"))
    restored = op.version_fold(op.version_restore(feed, versions, op.current_state(versions, META), requests, META), META)
    now = op.current_state(restored, META)
    return now.select("concept_id", F.col("current_version").alias("versions"), "title", "content_hash", "updated_on")


@register("snapshot_asof", sql("""
WITH i AS (SELECT id AS concept_id, CAST(created_at AS DATE) + CAST(5 + id % 20 AS INT) AS as_of FROM corpus_rows)
SELECT concept_id, as_of, version_number, title, created_on FROM (SELECT i.concept_id, i.as_of, v.version_number, v.title, v.created_on,
  row_number() OVER (PARTITION BY i.concept_id, i.as_of ORDER BY v.created_on DESC, v.version_number DESC) AS rn FROM i JOIN versions v ON v.concept_id = i.concept_id AND v.created_on <= i.as_of) WHERE rn = 1"""))
def snapshot_asof(spark, d):
    instants = fx.corpus_rows(spark, d).select(F.col("id").alias("concept_id"), F.expr("date_add(CAST(created_at AS DATE), CAST(5 + id % 20 AS INT))").alias("as_of"))
    return op.snapshot_asof(fx.versions(spark, d), instants)


@register("snapshot_backfill", sql("""
SELECT v.concept_id, v.version_number, CASE WHEN v.title IS NULL THEN c.title ELSE v.title END AS title, CASE WHEN v.title IS NULL THEN c.description ELSE v.description END AS description,
  CASE WHEN v.title IS NULL THEN c.category ELSE v.category END AS category, CASE WHEN v.title IS NULL THEN c.status ELSE v.status END AS status, CASE WHEN v.title IS NULL THEN c.type ELSE v.type END AS type
FROM versions v LEFT JOIN corpus_rows c ON c.id = v.concept_id"""))
def snapshot_backfill(spark, d):
    return op.snapshot_backfill(fx.versions(spark, d), fx.corpus_rows(spark, d), META).select("concept_id", "version_number", *META)


@register("source_lineage", sql("""
SELECT concept_id, content_hash, first_seq, created_on, n_chars, owner_id, title FROM (
  SELECT concept_id, 'sha256:' || sha256(body) AS content_hash, min(seq) AS first_seq, min(saved_on) AS created_on, CAST(min_by(length(body), seq) AS INT) AS n_chars FROM save_feed GROUP BY 1, 2) s
JOIN (SELECT id, owner_id, title FROM corpus) c ON c.id = s.concept_id"""))
def source_lineage(spark, d):
    return op.source_lineage(_feed(spark, d), fx.corpus(spark, d))


@register("exact_dup_guard", sql("""
WITH have AS (SELECT owner_id, content_hash, min(id) AS existing_id FROM corpus GROUP BY 1, 2),
r AS (SELECT b.seq, b.owner_id, h.existing_id, row_number() OVER w AS place, first_value(b.seq) OVER w AS first_seq FROM bundle_rows b LEFT JOIN have h USING (owner_id, content_hash) WINDOW w AS (PARTITION BY b.owner_id, b.content_hash ORDER BY b.seq))
SELECT seq, owner_id, CASE WHEN existing_id IS NOT NULL OR place > 1 THEN 'rejected' ELSE 'accepted' END AS verdict, existing_id, CASE WHEN existing_id IS NULL AND place > 1 THEN first_seq END AS same_as_seq FROM r"""))
def exact_dup_guard(spark, d):
    return op.exact_dup_guard(fx.bundle_rows(spark, d), fx.corpus(spark, d))


def _trash_requests(spark, d):
    rows = fx.corpus_rows(spark, d).where("id % 2 = 0 OR deleted_at IS NOT NULL")
    one = rows.select("id", F.explode(F.array(*map(F.lit, range(4)))).alias("k"))
    action = "element_at(array('trash', 'restore', 'purge'), CAST((id + k) % 3 AS INT) + 1)"
    return one.select(F.expr("CASE WHEN id % 10 = 8 THEN -id ELSE id END").alias("concept_id"), (F.col("id") * 4 + F.col("k")).alias("seq"), F.expr(action).alias("action"), F.lit("2024-01-31").cast("date").alias("on"))


TRASH = """
q AS (SELECT CASE WHEN id % 10 = 8 THEN -id ELSE id END AS concept_id, id * 4 + k AS seq, ['trash', 'restore', 'purge'][CAST((id + k) % 3 AS INT) + 1] AS action
  FROM corpus_rows, (VALUES (0), (1), (2), (3)) AS ks(k) WHERE id % 2 = 0 OR deleted_at IS NOT NULL),
h AS (SELECT q.*, CAST(c.deleted_at AS DATE) AS was, CASE WHEN c.id IS NULL THEN 'gone' WHEN c.deleted_at IS NULL THEN 'live' ELSE 'old' END AS start,
  coalesce(list(action) OVER (PARTITION BY concept_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS done FROM q LEFT JOIN corpus_rows c ON c.id = q.concept_id),
f AS (SELECT *, list_reduce([start] || done, lambda s, a: CASE WHEN a = 'trash' AND s = 'live' THEN 'new' WHEN a = 'restore' AND s IN ('old', 'new') THEN 'live' WHEN a = 'purge' AND s IN ('old', 'new') THEN 'gone' ELSE s END) AS state FROM h),
o AS (SELECT concept_id, seq, action, was, state, CASE WHEN state = 'gone' OR (action = 'trash' AND state <> 'live') THEN 'not-found' WHEN action = 'trash' THEN 'trashed'
  WHEN state = 'live' THEN 'not-trashed' WHEN action = 'restore' THEN 'restored' ELSE 'purged' END AS outcome FROM f)
"""


@register("trash_apply", sql(f"WITH {TRASH} SELECT concept_id, seq, action, outcome, CASE WHEN outcome = 'trashed' THEN DATE '2024-01-31' WHEN outcome IN ('restored', 'purged') THEN NULL WHEN state = 'old' THEN was WHEN state = 'new' THEN DATE '2024-01-31' END AS deleted_on FROM o"))
def trash_apply(spark, d):
    return op.trash_apply(fx.corpus_rows(spark, d), _trash_requests(spark, d))


@register("purge_cascade", sql(f"""WITH {TRASH}, p AS (SELECT concept_id FROM o WHERE outcome = 'purged')
SELECT 'version' AS part, concept_id || ':' || version_number AS key, 'delete' AS action FROM versions WHERE concept_id IN (SELECT concept_id FROM p)
UNION ALL SELECT 'attachment', storage_key, 'delete' FROM attachments WHERE concept_id IN (SELECT concept_id FROM p)
UNION ALL SELECT DISTINCT 'source', concept_id || ':sha256:' || sha256(body), 'unlink' FROM save_feed WHERE concept_id IN (SELECT concept_id FROM p)
UNION ALL SELECT 'chunk', CAST(vec_id AS VARCHAR), 'delete' FROM chunk_vectors WHERE concept_id IN (SELECT concept_id FROM p)
UNION ALL SELECT 'review-target', CAST(id AS VARCHAR), 'unlink' FROM corpus_rows WHERE id % 4 <> 0 AND id + 1 IN (SELECT concept_id FROM p)
UNION ALL SELECT 'review-resolved', CAST(id AS VARCHAR), 'unlink' FROM corpus_rows WHERE id % 5 = 0 AND id + 2 IN (SELECT concept_id FROM p)"""))
def purge_cascade(spark, d):
    purged = op.trash_apply(fx.corpus_rows(spark, d), _trash_requests(spark, d)).where("outcome = 'purged'")
    sources = _feed(spark, d).select("concept_id", op.content_hash(F.col("body")).alias("content_hash")).distinct()
    chunks = fx.chunk_vectors(spark, d).select("concept_id", F.col("vec_id").alias("chunk_id"))
    reviews = fx.corpus_rows(spark, d).selectExpr("id AS item_id", "CASE WHEN id % 4 <> 0 THEN id + 1 END AS target_id", "CASE WHEN id % 5 = 0 THEN id + 2 END AS resolved_id")
    return op.purge_cascade(purged, fx.versions(spark, d), sources, fx.attachments(spark, d), chunks, reviews)


@register("trash_list", sql("SELECT id, owner_id, title, CAST(deleted_at AS DATE) AS deleted_on FROM corpus_rows WHERE deleted_at IS NOT NULL ORDER BY deleted_at DESC, id LIMIT 50"))
def trash_list(spark, d):
    return op.trash_list(fx.corpus_rows(spark, d))


@register("version_churn", sql("""
WITH l AS (SELECT concept_id, version_number, unnest(string_split(body, chr(10))) AS line FROM versions),
g AS (SELECT concept_id, version_number, line, count(*) AS n FROM l GROUP BY ALL),
m AS (SELECT coalesce(a.concept_id, b.concept_id) AS concept_id, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM (SELECT * FROM g WHERE version_number = 1) a FULL JOIN (SELECT * FROM g WHERE version_number = 2) b ON a.concept_id = b.concept_id AND a.line = b.line)
SELECT concept_id, 1 AS from_version, CAST(sum(greatest(y - x, 0)) AS BIGINT) AS added, CAST(sum(greatest(x - y, 0)) AS BIGINT) AS removed, CAST(sum(least(x, y)) AS BIGINT) AS kept,
  round(sum(greatest(y - x, 0) + greatest(x - y, 0)) / sum(greatest(x, y)), 4) AS churn FROM m GROUP BY 1"""))
def version_churn(spark, d):
    return op.version_churn(fx.versions(spark, d))


@register("version_diff", sql("""
WITH p AS (SELECT a.concept_id, a.version_number, a.body AS old, b.body AS new FROM versions a JOIN corpus c ON c.id = a.concept_id JOIN versions b ON b.concept_id = c.id AND b.version_number = c.current_version),
l AS (SELECT *, CASE WHEN old = '' THEN []::VARCHAR[] ELSE string_split(old, chr(10)) END AS x, CASE WHEN new = '' THEN []::VARCHAR[] ELSE string_split(new, chr(10)) END AS y FROM p),
k AS (SELECT *, CASE WHEN old = new OR old = '' THEN len(x) ELSE len(x) - 1 + CAST(list_contains(y[len(x):], x[-1]) AS INT) END AS kept FROM l)
SELECT concept_id, version_number, CAST(len(y) - kept AS INT) AS added, CAST(len(x) - kept AS INT) AS removed, CAST(kept AS INT) AS kept,
  0 AS moved FROM k"""))
def version_diff(spark, d):
    """An old version is the whole body or its first half, so only the last of its lines can be another than the new body's."""
    versions = fx.versions(spark, d)
    current = fx.corpus(spark, d).select(F.col("id").alias("concept_id"), F.col("current_version").alias("version_number")).join(versions, ["concept_id", "version_number"])
    return op.version_diff(versions, current)


@register("concept_list", sql("SELECT id, title, category, status, CAST(updated_at AS DATE) AS updated_on FROM corpus WHERE status = 'stable' AND (category = 'en' OR starts_with(category, 'en/')) ORDER BY updated_at DESC, id LIMIT 50"))
def concept_list(spark, d):
    return op.concept_list(fx.corpus(spark, d), "stable", "en")


@register("concept_count", sql("""
WITH r AS (SELECT owner_id || k AS request_id, owner_id, CASE k WHEN 1 THEN 'stable' WHEN 3 THEN 'draft' END AS status, CASE WHEN k >= 2 THEN 'en' END AS path FROM (SELECT DISTINCT owner_id FROM corpus_rows) o, (VALUES (0), (1), (2), (3)) AS ks(k))
SELECT request_id, count(c.id) AS total, CAST(greatest(ceil(count(c.id) / 20.0), 1) AS BIGINT) AS pages FROM r LEFT JOIN corpus c ON c.owner_id = r.owner_id AND (r.status IS NULL OR c.status = r.status) AND (r.path IS NULL OR c.category = r.path OR starts_with(c.category, r.path || '/')) GROUP BY 1"""))
def concept_count(spark, d):
    owners = fx.corpus_rows(spark, d).select("owner_id").distinct().withColumn("k", F.explode(F.array(*map(F.lit, range(4)))))
    requests = owners.select(F.concat("owner_id", "k").alias("request_id"), "owner_id", F.expr("CASE k WHEN 1 THEN 'stable' WHEN 3 THEN 'draft' END").alias("status"), F.expr("CASE WHEN k >= 2 THEN 'en' END").alias("path"))
    return op.concept_count(fx.corpus(spark, d), requests)


TREE = """
u AS (SELECT owner_id, category AS path, 1 AS n FROM corpus UNION ALL SELECT owner_id, path, 0 FROM folders),
x AS (SELECT owner_id, path, n, array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS node FROM (SELECT *, unnest(generate_series(1, len(string_split(path, '/')))) AS i FROM u)),
t AS (SELECT owner_id, node AS path, CAST(sum(CASE WHEN node = path THEN n ELSE 0 END) AS BIGINT) AS direct_count, CAST(sum(n) AS BIGINT) AS subtree_count FROM x GROUP BY owner_id, node)
"""


@register("category_tree", sql(f"""WITH {TREE}
SELECT owner_id, path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') END AS parent, CAST(len(string_split(path, '/')) AS INT) AS depth, direct_count, subtree_count FROM t"""))
def category_tree(spark, d):
    return tree.category_tree(fx.corpus(spark, d), fx.folders(spark, d))


def _moves(spark, d):
    owners = fx.users(spark, d).select(F.col("user_id").alias("owner_id"), F.explode(F.array(*map(F.lit, range(5)))).alias("k"))
    source = "CASE k WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'nowhere' ELSE ' / ' END"
    target = "CASE k WHEN 0 THEN 'archive/en' WHEN 1 THEN 'fr/deep' WHEN 2 THEN 'es' WHEN 3 THEN 'other' ELSE 'blank' END"
    return owners.select(F.concat("owner_id", F.lit("-"), "k").alias("move_id"), "owner_id", F.expr(source).alias("source"), F.expr(target).alias("target"))


MOVES = f"""{TREE},
m AS (SELECT user_id || '-' || k AS move_id, user_id AS owner_id, CASE k WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' WHEN 3 THEN 'nowhere' END AS source,
  CASE k WHEN 0 THEN 'archive/en' WHEN 1 THEN 'fr/deep' WHEN 2 THEN 'es' WHEN 3 THEN 'other' ELSE 'blank' END AS target FROM users, (VALUES (0), (1), (2), (3), (4)) AS ks(k)),
j AS (SELECT m.*, CASE WHEN source IS NULL THEN 'empty' WHEN source = target OR starts_with(target, source || '/') THEN 'into-itself'
  WHEN EXISTS (SELECT 1 FROM t WHERE t.owner_id = m.owner_id AND t.path = m.target) THEN 'occupied' WHEN NOT EXISTS (SELECT 1 FROM t WHERE t.owner_id = m.owner_id AND t.path = m.source) THEN 'absent' ELSE 'moved' END AS verdict FROM m)
"""


@register("folder_move", sql(f"""WITH {MOVES}
SELECT move_id, verdict, count(c.id) AS n_moved, coalesce(min(target || substr(c.category, length(source) + 1)), '') AS least FROM j
LEFT JOIN corpus c ON j.verdict = 'moved' AND c.owner_id = j.owner_id AND (c.category = source OR starts_with(c.category, source || '/')) GROUP BY 1, 2"""))
def folder_move(spark, d):
    concepts = fx.corpus(spark, d)
    verdicts, moved = tree.folder_move(concepts, fx.folders(spark, d), _moves(spark, d))
    rows = moved.join(concepts.select("id", "owner_id"), "id").groupBy("owner_id", F.split("category", "/")[0].alias("root")).agg(F.count(F.lit(1)).alias("n"), F.min("category").alias("least"))
    mine = F.when(F.col("verdict") == "moved", F.split(F.col("target"), "/")[0])
    judged = verdicts.join(_moves(spark, d), "move_id").withColumn("root", mine)
    return judged.join(rows, ["owner_id", "root"], "left").select("move_id", "verdict", F.coalesce("n", F.lit(0)).alias("n_moved"), F.coalesce("least", F.lit("")).alias("least"))


#: A swap over a third path, a taken target, a chain, a move into itself, and one of what is no longer there.
ORDERED = [("en", "tmp"), ("fr", "en"), ("tmp", "fr"), ("de", "fr"), ("fr", "deep / er"), ("deep", "deep/er/x"), ("tmp", "y"), ("deep/er", "tmp")]


@register("folder_move_ordered", f"""
WITH RECURSIVE live AS (SELECT doc_id AS id, source AS owner_id, concat_ws('/', lang, source) AS was FROM documents WHERE text IS NOT NULL AND doc_id % 37 <> 0),
u AS (SELECT DISTINCT source AS owner_id FROM documents WHERE source IS NOT NULL),
m AS (SELECT owner_id, k AS turn, replace(s, ' ', '') AS source, replace(t, ' ', '') AS target FROM u, (VALUES {", ".join(f"({i + 1}, '{a}', '{b}')" for i, (a, b) in enumerate(ORDERED))}) AS v(k, s, t)),
p AS (SELECT owner_id, was FROM live UNION SELECT source, lang || '/' || source || '/empty' FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL),
r AS (SELECT owner_id, was, was AS path, 0 AS turn, '' AS verdict FROM p WHERE owner_id IS NOT NULL
  UNION ALL SELECT owner_id, was, CASE WHEN verdict = 'moved' AND (path = source OR starts_with(path, source || '/')) THEN target || substr(path, length(source) + 1) ELSE path END, turn, verdict FROM (
    SELECT r.owner_id, r.was, r.path, m.turn, m.source, m.target, CASE WHEN m.target = m.source OR starts_with(m.target, m.source || '/') THEN 'into-itself'
      WHEN max(r.path = m.target OR starts_with(r.path, m.target || '/')) OVER (PARTITION BY r.owner_id) THEN 'occupied'
      WHEN NOT max(r.path = m.source OR starts_with(r.path, m.source || '/')) OVER (PARTITION BY r.owner_id) THEN 'absent' ELSE 'moved' END AS verdict
    FROM r JOIN m ON m.owner_id = r.owner_id AND m.turn = r.turn + 1)),
v AS (SELECT owner_id, string_agg(DISTINCT turn || ':' || verdict, ' ' ORDER BY turn || ':' || verdict) AS verdicts FROM r WHERE turn > 0 GROUP BY owner_id),
e AS (SELECT l.id, l.owner_id, r.path FROM live l JOIN r ON r.owner_id = l.owner_id AND r.was = l.was AND r.turn = {len(ORDERED)} AND r.path <> r.was)
SELECT v.owner_id, verdicts, count(e.id) AS n_moved, coalesce(string_agg(e.id || '=' || e.path, ',' ORDER BY e.id), '') AS moved FROM v LEFT JOIN e USING (owner_id) GROUP BY 1, 2""")
def folder_move_ordered(spark, d):
    """A batch of moves that touch each other, for every owner."""
    batch = F.array(*(F.struct(F.lit(i + 1).alias("seq"), F.lit(a).alias("source"), F.lit(b).alias("target")) for i, (a, b) in enumerate(ORDERED)))
    moves = fx.users(spark, d).select(F.col("user_id").alias("owner_id"), F.explode(batch).alias("m")).select(F.concat_ws("/", "owner_id", "m.seq").alias("move_id"), "owner_id", "m.*")
    concepts = fx.corpus(spark, d)
    verdicts, moved = tree.folder_move_ordered(concepts, fx.folders(spark, d), moves)
    told = verdicts.join(moves, "move_id").groupBy("owner_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "seq", "verdict"))), " ").alias("verdicts"))
    ends = moved.join(concepts.select("id", "owner_id"), "id").groupBy("owner_id").agg(F.count(F.lit(1)).alias("n_moved"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "category"))), lambda x: F.concat_ws("=", x["id"], x["category"])), ",").alias("moved"))
    return told.join(ends, "owner_id", "left").select("owner_id", "verdicts", F.coalesce("n_moved", F.lit(0)).alias("n_moved"), F.coalesce("moved", F.lit("")).alias("moved"))


@register("folder_delete", sql("""SELECT id, CASE WHEN deleted_at IS NULL AND (category = 'fr' OR starts_with(category, 'fr/')) THEN NULL ELSE category END AS category FROM corpus_rows"""))
def folder_delete(spark, d):
    gone = fx.users(spark, d).select(F.col("user_id").alias("owner_id"), F.lit("fr").alias("path"))
    return tree.folder_delete(fx.corpus_rows(spark, d), gone)


@register("folder_create", sql(f"""WITH {TREE},
p AS (SELECT row_number() OVER (ORDER BY user_id, k) AS seq, user_id AS owner_id, CASE k WHEN 0 THEN 'en' WHEN 1 THEN 'new/sub' WHEN 2 THEN 'new' WHEN 3 THEN 'other' ELSE NULL END AS path FROM users, (VALUES (0), (1), (2), (3), (4)) AS ks(k))
SELECT seq, owner_id, path, CASE WHEN path IS NULL THEN 'empty' WHEN EXISTS (SELECT 1 FROM t WHERE t.owner_id = p.owner_id AND t.path = p.path)
  OR EXISTS (SELECT 1 FROM p q WHERE q.owner_id = p.owner_id AND q.seq < p.seq AND (q.path = p.path OR starts_with(q.path, p.path || '/'))) THEN 'conflict' ELSE 'created' END AS verdict FROM p"""))
def folder_create(spark, d):
    rows = fx.users(spark, d).select(F.col("user_id").alias("owner_id"), F.explode(F.array(*map(F.lit, range(5)))).alias("k"))
    asked = rows.select("owner_id", "k", F.expr("CASE k WHEN 0 THEN ' en ' WHEN 1 THEN 'new / sub' WHEN 2 THEN 'new' WHEN 3 THEN 'other//' ELSE ' / ' END").alias("path"))
    asked = asked.selectExpr("CAST(row_number() OVER (ORDER BY owner_id, k) AS BIGINT) AS seq", "owner_id", "path")
    return tree.folder_create(fx.corpus(spark, d), fx.folders(spark, d), asked)
