"""Queries over evidence and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as op
from ..operators import search
from ..registry import register
from . import fixtures as fx
from .duck import sql
from .search import TERMS


def _questions(spark, d):
    return search.query_parse(fx.query_table(spark, d))


def _pairs(spark, d, k=3):
    """Each question with ``k`` concepts by fixed numbers."""
    n = F.broadcast(fx.table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n")))
    rows = _questions(spark, d).select("query_id", F.explode(F.array(*map(F.lit, range(1, k + 1)))).alias("rank")).crossJoin(n)
    return rows.select("query_id", "rank", F.expr("(query_id * 7 + rank * 101) % n").alias("id")).join(fx.corpus(spark, d).select("id"), "id", "left_semi")


def _chunks(spark, d, size=1000):
    cut = f"explode(sequence(0, CAST(greatest(ceil(length(body) / {size}.0), 1) AS INT) - 1)) AS ordinal"
    return fx.corpus(spark, d).selectExpr("id", "body", cut).selectExpr("id", "ordinal", f"ordinal * {size} AS start_offset", f"substring(body, ordinal * {size} + 1, {size}) AS text")


CHUNKS = """
ch AS (SELECT id, o AS ordinal, substr(body, o * 1000 + 1, 1000) AS text FROM (SELECT id, body, unnest(generate_series(0, CAST(greatest(ceil(length(body) / 1000.0), 1) AS INT) - 1)) AS o FROM corpus)),
pr AS (SELECT DISTINCT query_id, CAST(k AS INT) AS rank, (query_id * 7 + k * 101) % (SELECT count(*) FROM documents) AS id FROM parsed, (VALUES (1), (2), (3)) AS ks(k)),
px AS (SELECT pr.* FROM pr SEMI JOIN corpus USING (id)),
sc AS (SELECT px.query_id, px.id, ch.ordinal, coalesce(sum((length(lower(text)) - length(replace(lower(text), term, ''))) // length(term) * length(term)), 0) AS score FROM px JOIN ch ON ch.id = px.id LEFT JOIN terms t ON t.query_id = px.query_id GROUP BY 1, 2, 3),
lx AS (SELECT query_id, id, CAST(arg_max(ordinal, score * 1000 - ordinal) AS INT) AS ordinal, CAST(max(score) AS BIGINT) AS score FROM sc GROUP BY 1, 2)
"""


@register("lexical_chunk", sql(f"WITH {TERMS}, {CHUNKS} SELECT query_id, id, ordinal, score FROM lx"))
def lexical_chunk(spark, d):
    return op.lexical_chunk(_pairs(spark, d).select("query_id", "id").distinct(), _questions(spark, d), _chunks(spark, d))


def _sources(spark, d):
    """Sources of all questions; a fresh chunk is at hand for every other pair, of which some no longer match."""
    pairs, chunks = _pairs(spark, d), _chunks(spark, d)
    fresh = pairs.where("(query_id + id) % 2 = 0").select("query_id", "id").distinct().join(chunks.where("ordinal = 0"), "id").selectExpr("query_id", "id", "ordinal", "CASE WHEN id % 3 = 0 THEN concat(text, 'old') ELSE text END AS text")
    return op.evidence_select(pairs, _questions(spark, d), fx.corpus(spark, d), chunks, fresh)


@register("evidence_select", sql(f"""WITH {TERMS}, {CHUNKS}
SELECT px.query_id, px.rank, px.id, CAST(CASE WHEN (px.query_id + px.id) % 2 = 0 AND px.id % 3 <> 0 THEN 0 ELSE lx.ordinal END AS INT) AS ordinal, CASE WHEN (px.query_id + px.id) % 2 = 0 AND px.id % 3 <> 0 THEN 'vector' ELSE 'words' END AS "by", false AS truncated FROM px JOIN lx USING (query_id, id)"""))
def evidence_select(spark, d):
    return _sources(spark, d).select("query_id", "rank", "id", "ordinal", "by", "truncated")


@register("evidence_gate", sql("""
SELECT query_id, CASE WHEN query_id % 7 = 0 THEN 'empty' WHEN CASE WHEN query_id % 2 = 0 THEN (query_id // 10 % 50) / 100.0 >= 0.25 ELSE query_id // 10 % 10 >= 5 END THEN 'answerable' ELSE 'weak' END AS verdict FROM parsed"""))
def evidence_gate(spark, d):
    asked = _questions(spark, d)
    tops = asked.where("query_id % 7 <> 0").selectExpr("query_id", "1 AS rank", "CAST(query_id DIV 10 % 10 AS DOUBLE) AS score", "CASE WHEN query_id % 2 = 0 THEN CAST(query_id DIV 10 % 50 AS DOUBLE) / 100 END AS similarity")
    return op.evidence_gate(asked, tops)


@register("evidence_pack", sql(f"""WITH {TERMS}, {CHUNKS},
sel AS (SELECT px.query_id, px.rank, px.id, CASE WHEN (px.query_id + px.id) % 2 = 0 AND px.id % 3 <> 0 THEN 0 ELSE lx.ordinal END AS ordinal FROM px JOIN lx USING (query_id, id))
SELECT query_id, CAST(count(*) AS INT) AS n_sources, CAST(to_json(list(struct_pack(marker := sel.rank, id := sel.id, title := title, text := ch.text) ORDER BY sel.rank)) AS VARCHAR) AS context
FROM sel JOIN ch ON ch.id = sel.id AND ch.ordinal = sel.ordinal JOIN corpus c ON c.id = sel.id GROUP BY query_id"""))
def evidence_pack(spark, d):
    return op.evidence_pack(_sources(spark, d))


@register("citation_audit", sql(r"""
WITH m AS (SELECT answer_id, answer, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '\[([0-9]{1,2})\]', 1), lambda x: x::INT), lambda x: x IN (1, 2)))) AS c FROM answers),
t AS (SELECT answer_id, array_to_string(c, ',') AS citations, trim(regexp_replace(answer, ' ?\[(0|00|01|02|[3-9]|0[3-9]|[1-9][0-9])\]', '', 'g')) AS answer FROM m)
SELECT *, CASE WHEN answer = '' THEN 'empty' ELSE 'ok' END AS status FROM t"""))
def citation_audit(spark, d):
    answers = fx.answers(spark, d)
    sources = answers.select("answer_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("marker"))
    return op.citation_audit(answers, sources).withColumn("citations", F.array_join("citations", ","))
