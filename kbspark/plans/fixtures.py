"""Logical tables over the synthetic parquet tables, as DataFrames.

:mod:`kbspark.plans.duck` states the same derivations in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/{name}.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else rows


def corpus_rows(spark: SparkSession, d: str) -> DataFrame:
    """One concept per document, trashed ones included."""
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    title = F.trim(F.regexp_replace(F.array_join(F.slice(F.split("text", " "), 1, 2), " "), r"[.,|\n]", ""))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("owner_id"),
        F.expr("CASE doc_id % 10 WHEN 0 THEN 'Reference' WHEN 1 THEN 'Procedure' ELSE 'Note' END").alias("type"),
        F.when(title == "", "untitled").otherwise(title).alias("title"),
        F.expr("CASE WHEN doc_id % 3 <> 0 THEN replace(substring(text, 1, 80), '\\n', ' ') END").alias("description"),
        F.concat_ws("/", "lang", "source").alias("category"),
        F.expr("CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 0 THEN 'draft' ELSE 'stable' END").alias("status"),
        F.array("lang", "source").alias("tags"),
        F.expr("CAST(1 + doc_id % 2 AS INT)").alias("current_version"),
        F.expr(f"CAST(date_sub(DATE'{AS_OF}', CAST(doc_id % 400 AS INT) + 30) AS TIMESTAMP)").alias("created_at"),
        F.expr(f"CAST(date_sub(DATE'{AS_OF}', CAST(doc_id % 400 AS INT)) AS TIMESTAMP)").alias("updated_at"),
        F.expr(f"CASE WHEN doc_id % 37 = 0 THEN CAST(date_sub(DATE'{AS_OF}', CAST(doc_id % 50 AS INT)) AS TIMESTAMP) END").alias("deleted_at"),
        F.expr("CAST(doc_id % 7 AS INT)").alias("retrieval_count"),
        F.expr(f"CASE WHEN doc_id % 7 > 0 THEN CAST(date_sub(DATE'{AS_OF}', CAST(doc_id % 30 AS INT)) AS TIMESTAMP) END").alias("last_retrieved_at"),
        F.col("text").alias("body"),
        F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("content_hash"),
    )


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """The live concepts."""
    return corpus_rows(spark, d).where("deleted_at IS NULL")


def users(spark: SparkSession, d: str) -> DataFrame:
    """One user per source; every fifth is disabled and src0 is an administrator."""
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    return (
        table(spark, d, "documents")
        .where("source IS NOT NULL")
        .select(F.col("source").alias("user_id"), number.alias("n"))
        .distinct()
        .select(
            "user_id",
            F.concat(F.lit("user "), "user_id").alias("username"),
            F.expr("CASE WHEN n = 0 THEN 'admin' ELSE 'user' END").alias("role"),
            F.expr("n % 5 = 4").alias("disabled"),
            F.expr(f"CASE WHEN n % 3 > 0 THEN CAST(date_sub(DATE'{AS_OF}', n) AS TIMESTAMP) END").alias("last_login_at"),
        )
    )


def versions(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of every document: the first half of its text, and all of it; concepts of odd id are at the second."""
    rows = corpus_rows(spark, d)
    half = F.substring("body", F.lit(1), (F.length("body") / 2).cast("int"))
    return rows.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("version_number"), "title", "description", "category", "status", "type", "body", "created_at").select(
        F.col("id").alias("concept_id"),
        "version_number",
        F.expr("CASE WHEN id % 5 <> 0 THEN title END").alias("title"),
        F.expr("CASE WHEN id % 5 <> 0 THEN description END").alias("description"),
        F.expr("CASE WHEN id % 5 <> 0 THEN category END").alias("category"),
        F.expr("CASE WHEN id % 5 <> 0 THEN status END").alias("status"),
        F.expr("CASE WHEN id % 5 <> 0 THEN type END").alias("type"),
        F.when(F.expr("version_number = 2 OR id % 2 = 0"), F.col("body")).otherwise(half).alias("body"),
        F.expr("date_add(CAST(created_at AS DATE), 10 * version_number)").alias("created_on"),
    )


def attachments(spark: SparkSession, d: str) -> DataFrame:
    """One file per page, hung to a document; metadata of every page but each eleventh."""
    pages = table(spark, d, "pages").crossJoin(F.broadcast(table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))))
    return pages.where("n > 0").select(
        "page_id",
        F.expr("(page_id * 3) % n").alias("concept_id"),
        F.concat(F.lit("key-"), "page_id").alias("storage_key"),
        F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size_bytes"),
        F.expr("page_id % 11 <> 0").alias("has_metadata"),
        F.expr("page_id % 13 <> 0").alias("has_file"),
        F.expr("page_id % 17 = 0").alias("uploading"),
    )


def save_feed(spark: SparkSession, d: str) -> DataFrame:
    """Three saves per document: half of the text, the same under another title, all of it."""
    rows = corpus_rows(spark, d)
    half = F.substring("body", F.lit(1), (F.length("body") / 2).cast("int"))
    saves = rows.select("*", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("seq"))
    return saves.select(
        F.col("id").alias("concept_id"),
        "seq",
        "owner_id",
        F.when(F.col("seq") == 2, F.concat(F.col("title"), F.lit(" (draft)"))).otherwise(F.col("title")).alias("title"),
        "description",
        "category",
        "status",
        "type",
        F.when(F.col("seq") < 3, half).otherwise(F.col("body")).alias("body"),
        F.expr("date_add(CAST(created_at AS DATE), seq)").alias("saved_on"),
    )


def titles_by_number(spark: SparkSession, d: str) -> DataFrame:
    return corpus_rows(spark, d).select(F.col("id").alias("to_id"), F.col("title").alias("to_title"))


def linked_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Live concepts whose bodies link to others, embed one, and now and then to nothing."""
    live = corpus(spark, d).crossJoin(F.broadcast(table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))))
    other = titles_by_number(spark, d)
    joined = live.withColumn("to_id", F.expr("(7 * id + 1) % n")).join(other, "to_id", "left")
    link = F.coalesce("to_title", F.lit("nowhere"))
    body = F.concat(
        "body",
        F.lit("\n\n"),
        F.concat(F.lit("[["), link, F.lit("]]")),
        F.expr("CASE WHEN id % 4 = 0 THEN concat(' and [[', coalesce(to_title, 'nowhere'), '|alias]]') ELSE '' END"),
        F.expr("CASE WHEN id % 5 = 0 THEN concat('\\n![[', coalesce(to_title, 'nowhere'), ']]\\n') ELSE '' END"),
        F.expr("CASE WHEN id % 11 = 0 THEN concat(' [[missing-', id, ']]') ELSE '' END"),
    )
    return joined.select("id", "owner_id", "title", "description", "category", "status", "type", "tags", "updated_at", body.alias("body"))


def headed_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Live concepts with a title heading, a second heading in the middle, and now and then fenced code."""
    half = (F.length("body") / 2).cast("int")
    plain = lambda c: F.translate(c, "#`~", "---")
    rows = corpus(spark, d).withColumn("body", plain("body")).withColumn("title", plain("title"))
    body = F.concat(
        F.lit("# "), "title", F.lit("\n\n"), F.substring("body", F.lit(1), half), F.lit("\n\n## part "), (F.col("id") % 3).cast("string"), F.lit("\n\n"),
        F.expr("CASE WHEN id % 6 = 0 THEN '```\\n# not a heading\\n```\\n' ELSE '' END"),
        F.expr("substring(body, CAST(length(body) / 2 AS INT) + 1)"),
    )
    return rows.select("id", "owner_id", "title", "category", "updated_at", body.alias("body"))


def folders(spark: SparkSession, d: str) -> DataFrame:
    """An empty folder below each language of each source."""
    return table(spark, d, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.col("source").alias("owner_id"), F.concat("lang", F.lit("/"), "source", F.lit("/empty")).alias("path")).distinct()


def query_table(spark: SparkSession, d: str) -> DataFrame:
    """One query per user turn: its first 60 characters, some with operators, some misspelt."""
    turns = table(spark, d, "conversations").where("role = 'user' AND text IS NOT NULL")
    base = F.expr("trim(regexp_replace(substring(text, 1, 60), '\\\\s+', ' '))")
    typo = F.expr("CASE WHEN conv_id % 9 = 0 THEN concat(substring(q, 2, 1), substring(q, 1, 1), substring(q, 3)) ELSE q END")
    raw = F.expr(
        "concat(q, CASE WHEN conv_id % 5 = 0 THEN ' tag:en' ELSE '' END, CASE WHEN conv_id % 7 = 0 THEN ' status:draft' ELSE '' END, CASE WHEN conv_id % 35 = 0 THEN ' type:note' ELSE '' END, CASE WHEN conv_id % 22 = 0 THEN ' category:en/src1' WHEN conv_id % 11 = 0 THEN ' category:fr' ELSE '' END)"
    )
    return turns.select("conv_id", "turn", base.alias("q")).select("conv_id", "turn", typo.alias("q")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), raw.alias("raw"))


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"))
    return table(spark, d, "embeddings").crossJoin(F.broadcast(n)).where("n > 0").select("vec_id", F.expr("vec_id % n").alias("concept_id"), "embedding", F.expr("vec_id % 13 = 0").alias("stale"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks."""
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def request_log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.expr("CASE event_type WHEN 'error' THEN 500 ELSE 200 END").alias("status"),
        F.expr("CAST(floor(value * 10) AS INT)").alias("took_ms"),
        F.expr("CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'POST' ELSE 'GET' END").alias("method"),
        F.expr("CASE event_type WHEN 'purchase' THEN '/api/concepts' WHEN 'signup' THEN '/api/capture' WHEN 'click' THEN '/api/search' ELSE '/api/concepts' END").alias("path"),
        F.expr("user_id % 10").alias("api_key_id"),
    )


def search_log(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "events")
        .where("event_type IN ('view', 'click')")
        .select(
            "event_id",
            "ts",
            "user_id",
            F.expr("CAST(floor(value) AS INT) % 8").alias("result_count"),
            F.expr("CAST(floor(value * 10) AS INT)").alias("took_ms"),
            F.expr("element_at(array('bm25', 'trgm-fallback', 'semantic-only', 'operators'), CAST(event_id % 4 AS INT) + 1)").alias("mode"),
            F.expr("CASE WHEN event_id % 10 = 0 THEN 'ingest' ELSE 'api' END").alias("source"),
        )
    )


def model_calls(spark: SparkSession, d: str) -> DataFrame:
    return (
        table(spark, d, "events")
        .where("event_type IN ('purchase', 'signup')")
        .select(
            F.col("event_id").alias("call_id"),
            "ts",
            F.col("user_id").alias("actor"),
            F.expr("CAST(floor(value * 100) AS BIGINT) + 1").alias("reserved"),
            F.expr("CASE WHEN event_id % 6 <> 0 THEN CAST(floor(value * 80) AS BIGINT) + 1 END").alias("actual"),
            F.expr("ts + INTERVAL 150 SECONDS").alias("expires_at"),
        )
    )


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns with citation markers, of which some have no source."""
    mark = "CASE turn % 3 WHEN 0 THEN ' [1] then [2][1]' WHEN 1 THEN ' see [2] and [9]' ELSE ' [1] [0] [12]' END"
    return table(spark, d, "conversations").where("role = 'assistant' AND text IS NOT NULL").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.expr(f"concat(text, {mark})").alias("answer"))


def bundle_rows(spark: SparkSession, d: str) -> DataFrame:
    """An incoming bundle, a row for each live concept: copies, altered bodies under old titles, new titles, and collisions among themselves."""
    rows = corpus(spark, d)
    return rows.select(
        F.col("id").alias("seq"),
        "owner_id",
        F.expr("CASE WHEN id % 17 = 0 THEN 'shared title' WHEN id % 3 = 2 THEN concat('new ', id, ' ', title) WHEN id % 6 = 1 THEN concat('incoming ', title) ELSE title END").alias("title"),
        F.expr("CASE WHEN id % 3 = 0 THEN body ELSE concat(body, ' altered ', id % 7) END").alias("body"),
    ).withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2(F.col("body").cast("binary"), 256)))


def review_pending(spark: SparkSession, d: str) -> DataFrame:
    """Review items: one for every live concept, of which some have no target, some a changed one, and some are resolved."""
    rows = corpus(spark, d)
    return rows.select(
        F.col("id").alias("item_id"),
        "owner_id",
        F.expr("CASE id % 3 WHEN 0 THEN 'near_duplicate' WHEN 1 THEN 'quality_risk' ELSE 'conflict' END").alias("kind"),
        F.expr("CASE WHEN id % 2 = 0 THEN 'ingest' ELSE 'import' END").alias("source"),
        F.expr("CASE WHEN id % 5 = 0 THEN 'resolved' ELSE 'pending' END").alias("status"),
        "title",
        F.concat("body", F.lit(" revised")).alias("body"),
        F.concat(F.lit("sha256:"), F.sha2(F.concat("body", F.lit(" revised")).cast("binary"), 256)).alias("content_hash"),
        F.expr("CASE WHEN id % 4 <> 0 THEN id END").alias("target_id"),
        F.expr("CAST(created_at AS DATE)").alias("created_on"),
        F.expr("CASE WHEN id % 5 = 0 THEN date_add(CAST(created_at AS DATE), 3) END").alias("resolved_on"),
        F.expr("id % 7 = 0").alias("edited"),
    )
