"""Queries over headings, links and mentions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import links as op
from ..registry import register
from . import fixtures as fx
from .duck import sql


def _links(spark, d):
    return op.link_extract(fx.linked_corpus(spark, d))


#: Where the fixture puts headings: the title, the second heading, and fenced code that is none.
HEADS = """
b AS (SELECT c.id, h.body, length(h.title) AS nt, length(c.body) // 2 AS half, h.title FROM corpus c JOIN headed_corpus h USING (id)),
heads AS (SELECT id, CAST(0 AS INT) AS "offset", 1 AS level, title AS text FROM b UNION ALL SELECT id, CAST(2 + nt + 2 + half + 2 AS INT), 2, 'part ' || (id % 3) FROM b)
"""


@register("heading_index", sql(f'WITH {HEADS} SELECT id, "offset", level, text FROM heads'))
def heading_index(spark, d):
    return op.heading_index(fx.headed_corpus(spark, d))


@register("section_label", sql(f"""WITH {HEADS}, a AS (SELECT id, CAST(length(body) * k // 4 AS INT) AS anchor FROM b, (VALUES (0), (1), (3)) AS ks(k))
SELECT DISTINCT a.id, anchor, CASE WHEN anchor >= 2 + nt + 2 + half + 2 THEN title || ' > part ' || (b.id % 3) ELSE title END AS section FROM a JOIN b USING (id)"""))
def section_label(spark, d):
    rows = fx.headed_corpus(spark, d)
    anchors = rows.select("id", F.explode(F.array(*[F.expr(f"CAST(length(body) * {k} DIV 4 AS INT)") for k in (0, 1, 3)])).alias("anchor")).distinct()
    return op.section_label(anchors, op.heading_index(rows))


@register("title_repeat", sql("SELECT id, title FROM headed_corpus WHERE id % 2 = 0"))
def title_repeat(spark, d):
    """Odd bodies begin with another heading."""
    return op.title_repeat(fx.headed_corpus(spark, d).withColumn("body", F.expr("CASE WHEN id % 2 = 0 THEN concat('\\n', body) ELSE concat('# other\\n', body) END")))


@register("link_extract", sql("SELECT id, CAST(pos AS INT) AS pos, target, display, embed FROM links"))
def link_extract(spark, d):
    return _links(spark, d)


@register("link_graph", sql("""
WITH t AS (SELECT lower(title) AS key, arg_max(id, (-epoch(updated_at), id)) AS to_id FROM linked_corpus GROUP BY 1),
e AS (SELECT DISTINCT least(id, to_id) AS a, greatest(id, to_id) AS b FROM links JOIN t ON t.key = lower(target) WHERE id <> to_id),
g AS (SELECT id, count(*) AS degree FROM (SELECT a AS id FROM e UNION ALL SELECT b FROM e) GROUP BY 1)
SELECT id, coalesce(degree, 0) AS degree FROM corpus LEFT JOIN g USING (id)"""))
def link_graph(spark, d):
    return op.link_graph(fx.linked_corpus(spark, d), _links(spark, d))[1]


@register("link_resolve", sql("""
WITH q AS (SELECT id AS request_id, owner_id, lower(trim(target)) AS key FROM links JOIN corpus USING (id) GROUP BY 1, 2, 3)
SELECT request_id, key, min(c.id) AS to_id FROM q JOIN corpus c ON c.owner_id = q.owner_id AND lower(c.title) = key GROUP BY 1, 2"""))
def link_resolve(spark, d):
    asked = _links(spark, d).join(fx.corpus(spark, d).select("id", "owner_id"), "id").select(F.col("id").alias("request_id"), "owner_id", "pos", F.concat(F.lit(" "), "target").alias("title"))
    return op.link_resolve(asked, fx.corpus(spark, d))


@register("link_outgoing", sql("""
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY f) - 1 AS INT) AS place, target, display FROM (SELECT id, target, min(pos) AS f, max_by(display, pos) AS display FROM links GROUP BY 1, 2)"""))
def link_outgoing(spark, d):
    return op.link_outgoing(_links(spark, d))


@register("link_dangling", sql("SELECT DISTINCT id, target FROM links WHERE lower(target) NOT IN (SELECT lower(title) FROM corpus)"))
def link_dangling(spark, d):
    return op.link_dangling(_links(spark, d), fx.corpus(spark, d))


@register("backlinks", sql("""
WITH e AS (SELECT DISTINCT l.id AS from_id, c.id FROM links l JOIN corpus c ON lower(trim(c.title)) = lower(l.target) WHERE l.id <> c.id),
r AS (SELECT e.id, from_id, row_number() OVER (PARTITION BY e.id ORDER BY f.updated_at DESC, from_id) AS rank FROM e JOIN corpus f ON f.id = e.from_id)
SELECT id, CAST(rank AS INT) AS rank, from_id FROM r WHERE rank <= 20"""))
def backlinks(spark, d):
    return op.backlinks(_links(spark, d), fx.corpus(spark, d))


@register("unlinked_mentions", sql(r"""
WITH b AS (SELECT id AS source_id, updated_at, regexp_replace(lower(body), '!?\[\[[^\[\]\n]{1,200}\]\]', chr(57344), 'g') AS low FROM linked_corpus),
t AS (SELECT id AS target_id, lower(trim(title)) AS t, regexp_matches(lower(trim(title)), '^[\x20-\x7e]+$') AND regexp_matches(lower(trim(title)), '[a-z0-9]') AS asc FROM linked_corpus WHERE length(trim(title)) >= 2),
c AS (SELECT *, CASE WHEN asc THEN regexp_extract(low, '^((?s:.*?))(?:^|[^a-z0-9])' || regexp_escape(t) || '(?:$|[^a-z0-9])', 0) END AS lead FROM t JOIN b ON contains(low, t) AND target_id <> source_id),
r AS (SELECT target_id, source_id, row_number() OVER (PARTITION BY target_id ORDER BY updated_at DESC, source_id) AS rank FROM c
  WHERE NOT asc OR regexp_matches(low, '(?:^|[^a-z0-9])' || regexp_escape(t) || '(?:$|[^a-z0-9])'))
SELECT target_id, CAST(rank AS INT) AS rank, source_id FROM r WHERE rank <= 20""".replace(", CASE WHEN asc THEN regexp_extract(low, '^((?s:.*?))(?:^|[^a-z0-9])' || regexp_escape(t) || '(?:$|[^a-z0-9])', 0) END AS lead", "").replace("asc", "is_ascii")))
def unlinked_mentions(spark, d):
    return op.unlinked_mentions(fx.linked_corpus(spark, d)).select("target_id", "rank", "source_id")


@register("embed_expand", sql("""
WITH t AS (SELECT lower(title) AS key, min(id) AS to_id FROM linked_corpus GROUP BY 1)
SELECT c.id, t.to_id, sha256(o.body) AS embedded FROM linked_corpus c JOIN links l ON l.id = c.id AND l.embed JOIN t ON t.key = lower(l.target) JOIN linked_corpus o ON o.id = t.to_id"""))
def embed_expand(spark, d):
    return op.embed_expand(fx.linked_corpus(spark, d)).select("id", "to_id", F.sha2(F.col("text").cast("binary"), 256).alias("embedded"))
