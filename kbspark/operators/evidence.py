"""Evidence for answering questions from the corpus, and the audit of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SOURCE_CHARS = 2400
LEAST_SIMILARITY, LEAST_SCORE = 0.25, 5.0


def lexical_chunk(pairs: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, id) with the chunk in which the question's terms occur most, long terms counting more; the first chunk on ties or without terms."""
    met = pairs.join(questions.select("query_id", T.query_terms(F.col("needle")).alias("terms")), "query_id").join(chunks.select("id", "ordinal", F.lower("text").alias("low")), "id")
    score = F.aggregate("terms", F.lit(0).cast("long"), lambda acc, t: acc + T.occurrences(F.col("low"), t) * F.length(t))
    scored = met.select("query_id", "id", "ordinal", score.alias("score"))
    return scored.groupBy("query_id", "id").agg(F.max(F.struct("score", (-F.col("ordinal")).alias("o"))).alias("best")).select("query_id", "id", (-F.col("best.o")).cast("int").alias("ordinal"), F.col("best.score").alias("score"))


def evidence_select(hits: DataFrame, questions: DataFrame, corpus: DataFrame, chunks: DataFrame, fresh: DataFrame, k: int = 6) -> DataFrame:
    """(query_id, rank, id) hits as sources: the nearest fresh chunk (query_id, id, ordinal, text) if the body still has it, else the lexical one."""
    pairs = hits.where(F.col("rank") <= k).select("query_id", "rank", "id")
    held = fresh.select("query_id", "id", F.col("ordinal").alias("near"), F.col("text").alias("near_text"))
    words = lexical_chunk(pairs.select("query_id", "id"), questions, chunks).select("query_id", "id", F.col("ordinal").alias("best"))
    rows = pairs.join(held, ["query_id", "id"], "left").join(words, ["query_id", "id"], "left")
    now = chunks.select("id", F.col("ordinal").alias("near"), F.col("text").alias("now_text"))
    rows = rows.join(now, ["id", "near"], "left").withColumn("ok", F.col("near_text").isNotNull() & (F.col("near_text") == F.col("now_text")))
    rows = rows.select("query_id", "rank", "id", F.when(F.col("ok"), F.col("near")).otherwise(F.col("best")).alias("ordinal"), F.when(F.col("ok"), "vector").otherwise("words").alias("by"))
    met = rows.join(chunks.select("id", "ordinal", "start_offset", "text"), ["id", "ordinal"]).join(corpus.select("id", "title"), "id")
    return met.select("query_id", "rank", "id", "title", "ordinal", "by", "start_offset", F.substring("text", 1, SOURCE_CHARS).alias("text"), (F.length("text") > SOURCE_CHARS).alias("truncated"))


def evidence_gate(questions: DataFrame, tops: DataFrame) -> DataFrame:
    """(query_id, verdict): empty without a first hit, weak below the thresholds, else answerable."""
    best = tops.groupBy("query_id").agg(F.min_by(F.struct("score", "similarity"), "rank").alias("t"))
    strong = F.when(F.col("t.similarity").isNotNull(), F.col("t.similarity") >= LEAST_SIMILARITY).otherwise(F.col("t.score") >= LEAST_SCORE)
    return questions.select("query_id").join(best, "query_id", "left").select("query_id", F.when(F.col("t").isNull(), "empty").when(strong, "answerable").otherwise("weak").alias("verdict"))


def evidence_pack(sources: DataFrame) -> DataFrame:
    """One numbered JSON context per question."""
    rows = sources.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("marker"), "id", "title", "text"))).alias("s"))
    return rows.select("query_id", F.size("s").alias("n_sources"), F.to_json("s").alias("context"))


def citation_audit(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, answer) with sources (answer_id, marker): valid markers in order, the answer without the others (and one blank before each)."""
    marks = F.transform(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda m: m.cast("int"))
    have = sources.groupBy("answer_id").agg(F.collect_set("marker").alias("have"))
    rows = answers.join(have, "answer_id", "left").withColumn("have", F.coalesce("have", F.array().cast("array<int>"))).withColumn("marks", marks)
    valid = F.array_sort(F.array_distinct(F.filter("marks", lambda m: F.array_contains("have", m))))
    bad = F.array_distinct(F.filter(F.regexp_extract_all("answer", F.lit(r"\[(\d{1,2})\]"), F.lit(1)), lambda m: ~F.array_contains("have", m.cast("int"))))
    cleaned = F.aggregate(bad, F.col("answer"), lambda acc, m: F.regexp_replace(acc, F.concat(F.lit(r" ?\["), m, F.lit(r"\]")), F.lit("")))
    out = rows.select("answer_id", valid.alias("citations"), F.trim(cleaned).alias("answer"))
    return out.withColumn("status", F.when(F.col("answer") == "", "empty").otherwise("ok"))
