"""Curation reports, ingest governance and quality checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.markdown import sections


def dup_groups(corpus: DataFrame) -> DataFrame:
    """(content_hash, n, first_id, id, title): each live concept that shares its body with others, and the group's first by title and id.

    A group is as many rows as it has concepts, so none has to fit into one row.
    """
    shared = corpus.groupBy("content_hash").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("title", "id"))["id"].alias("first_id")).where("n > 1")
    return corpus.select("content_hash", "id", "title").join(shared, "content_hash").select("content_hash", "n", "first_id", "id", "title")


def missing_description(corpus: DataFrame, stable_only: bool = True, limit: int | None = None) -> DataFrame:
    """Concepts without a description: stable ones where it is empty, or any where it is blank, newest first."""
    empty = F.coalesce("description", F.lit("")) == "" if stable_only else T.squeezed(F.coalesce("description", F.lit(""))) == ""
    rows = corpus.where(empty)
    rows = rows.where("status = 'stable'") if stable_only else rows
    rows = rows.orderBy(F.desc("updated_at"), "id").select("id", "title")
    return rows if limit is None else rows.limit(limit)


def stale_concepts(corpus: DataFrame, as_of: str, days: int = 180) -> DataFrame:
    return corpus.where(F.col("updated_at") < F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")).select("id", "title", F.col("updated_at").cast("date").alias("updated_on"))


def curate_report(findings: dict[str, DataFrame]) -> DataFrame:
    """Findings by section as counts, with a line for all (null); a row with a column ``weight`` stands for so many findings."""
    rows = None
    for name, df in findings.items():
        part = df.select(F.lit(name).alias("section"), (F.col("weight") if "weight" in df.columns else F.lit(1)).cast("long").alias("n"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.rollup("section").agg(F.sum("n").alias("n"))


def curate_findings(findings: dict[str, DataFrame], limit: int = 50) -> DataFrame:
    """(section, place, id, detail): the first ``limit`` findings of each section, by id and detail.

    Findings are (id, detail).  Each section is cut to its first before anything is numbered.
    """
    rows = None
    for name, df in findings.items():
        part = df.select("id", "detail").orderBy("id", "detail").limit(limit).select(F.lit(name).alias("section"), "id", "detail")
        rows = part if rows is None else rows.unionByName(part)
    place = F.row_number().over(Window.partitionBy("section").orderBy("id", "detail"))
    return rows.select("section", place.alias("place"), "id", "detail")


def change_digest(concepts: DataFrame, as_of: str, days: int = 7, limit: int = 200) -> DataFrame:
    """The newest changes, trashed ones included, as new or updated, grouped by category, large groups first."""
    since = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    rows = concepts.where(F.col("updated_at") >= since).orderBy(F.desc("updated_at"), "id").limit(limit)
    tag = F.when(F.col("created_at") >= since, "new").otherwise("updated")
    sized = rows.withColumn("group_size", F.count(F.lit(1)).over(Window.partitionBy("category")))
    place = Window.orderBy(F.desc("group_size"), "category", F.desc("updated_at"), "id")
    return sized.withColumn("place", F.row_number().over(place)).select("place", "id", "category", "group_size", tag.alias("tag"), "title", "description")


def digest_budget(digest: DataFrame, line_chars: int = 220, lines: int = 40, chars: int = 6000) -> DataFrame:
    """The digest's first lines: until there are ``lines`` of them or ``chars`` are used up; the line that crosses counts."""
    text = F.substring(F.format_string("- [%s] %s: %s", "tag", "title", F.coalesce("description", F.lit(""))), 1, line_chars)
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = digest.withColumn("line", text).withColumn("used", F.coalesce(F.sum(F.length("line")).over(before), F.lit(0)))
    return rows.where((F.col("place") <= lines) & (F.col("used") < chars)).select("place", "line")


def quality_sample(corpus: DataFrame, per_owner: int = 5, seed: int = 1) -> DataFrame:
    """Up to ``per_owner`` live concepts of each owner in a seeded hash order, so that a rerun draws the same."""
    rank = F.row_number().over(Window.partitionBy("owner_id").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    return corpus.select("owner_id", "id", "title", rank.alias("rank")).where(F.col("rank") <= per_owner)


# The kinds of quality issue and their labels.
ISSUES = {"outdated": "Outdated", "incorrect": "Incorrect", "incomplete": "Incomplete", "unclear": "Unclear", "unsourced": "Unsourced", "other": "Other"}


def fingerprint(*parts: str) -> Column:
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts])).cast("binary"), 256)


def spot_report(reports: DataFrame, corpus: DataFrame) -> DataFrame:
    """(report_id, id, issue, note) as quality-risk review rows with the fingerprint of the concept as it is now."""
    label = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ISSUES.items() for x in kv]), F.col("issue")), F.lit(ISSUES["other"]))
    met = reports.join(corpus.select("id", "owner_id", "title", "status", "body"), "id")
    return met.select("report_id", "id", "owner_id", F.lit("quality_risk").alias("kind"), F.substring(F.concat(label, F.lit(": "), F.trim("note")), 1, 4000).alias("reason"), fingerprint("title", "status", "body").alias("fingerprint"))


ASSESSMENT = "risk boolean, level string, findings array<struct<claim string, evidence string, recommendation string>>"


def assessment_parse(raw: DataFrame, most: int = 8, body_chars: int = 12_000) -> DataFrame:
    """(id, n_chars, raw) model output: risk only with findings that have evidence and a recommendation; status tells what was wrong."""
    parsed = raw.withColumn("x", F.from_json("raw", ASSESSMENT))
    good = F.slice(F.filter(F.coalesce("x.findings", F.array().cast("array<struct<claim string, evidence string, recommendation string>>")), lambda f: (F.coalesce(F.trim(f["evidence"]), F.lit("")) != "") & (F.coalesce(F.trim(f["recommendation"]), F.lit("")) != "")), 1, most)
    level = F.when(F.col("x.level").isin("low", "medium", "high"), F.col("x.level")).otherwise("medium")
    status = F.when(F.col("n_chars") > body_chars, "skipped").when(F.col("x").isNull() | (F.col("x.risk").isNull() & F.col("x.level").isNull() & F.col("x.findings").isNull()), "unreadable").otherwise("ok")
    rows = parsed.withColumn("good", good).withColumn("status", status)
    risk = (F.col("status") == "ok") & F.coalesce(F.col("x.risk"), F.lit(False)) & (F.size("good") > 0)
    return rows.select("id", "status", risk.alias("risk"), F.when(risk, level).alias("level"), F.when(F.col("status") == "ok", F.size("good")).otherwise(0).alias("n_findings"))


def ingest_chunk(files: DataFrame, target: int = 2800, least: int = 120) -> DataFrame:
    """(file, ordinal, path, chunk) of Markdown files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(f, i, path, chunk) for f, body in zip(rows["file"], rows["text"], strict=True) for i, (path, chunk) in enumerate(sections(body or "", target, least))]
            yield pd.DataFrame(out, columns=["file", "ordinal", "path", "chunk"])

    return files.select("file", "text").mapInPandas(run, "file string, ordinal int, path string, chunk string")


def candidate_validate(candidates: DataFrame, prefix: str, per_run: int = 100) -> DataFrame:
    """(run_id, seq, title, body, description, category, tags) clamped, or dropped with a reason."""
    title, body = T.squeezed(F.coalesce("title", F.lit(""))), F.trim(F.coalesce("body", F.lit("")))
    rows = candidates.withColumn("title", F.substring(title, 1, 200)).withColumn("body", body)
    rows = rows.withColumn("reason", F.when(F.length("title") < 2, "title").when(F.length("body") < 30, "body"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("run_id", F.col("reason").isNull()).orderBy("seq")))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("n") > per_run, "cap")))
    category = F.when(F.coalesce("category", F.lit("")) == "", prefix).when(F.startswith("category", F.lit(prefix)), F.col("category")).otherwise(F.concat(F.lit(prefix + "/"), "category"))
    tags = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")), 1, 8)
    return rows.select("run_id", "seq", "title", F.length("body").alias("n_chars"), F.substring("description", 1, 300).alias("description"), F.substring(category, 1, 200).alias("category"), tags.alias("tags"), "reason")


def ingest_route(candidates: DataFrame, hits: DataFrame, least_score: float = 25.0) -> DataFrame:
    """(seq, title) by the best of their hits (seq, rank, id, title, score): create, near-duplicate, or unchecked without a look-up.

    ``candidates.looked_up`` tells whether the look-up worked.
    """
    near = hits.where(F.col("rank") <= 5).withColumnRenamed("title", "hit_title").join(candidates.select("seq", "title"), "seq")
    near = near.where((F.lower(F.trim("hit_title")) == F.lower(F.trim("title"))) | ((F.col("rank") == 1) & (F.col("score") >= least_score)))
    best = near.groupBy("seq").agg(F.min_by("id", "rank").alias("target_id"))
    verdict = F.when(~F.col("looked_up"), "unchecked").when(F.col("target_id").isNotNull(), "near-duplicate").otherwise("create")
    return candidates.join(best, "seq", "left").select("seq", verdict.alias("verdict"), F.when(F.col("looked_up"), F.col("target_id")).alias("target_id"))


def claim_normalize(raw: DataFrame, most: int = 8) -> DataFrame:
    """(id, claims array of (text, quote)) as one row per claim: squeezed, clamped, without repeats, the first eight."""
    rows = raw.select("id", F.posexplode("claims").alias("pos", "c"))
    rows = rows.select("id", "pos", F.substring(T.squeezed(F.col("c.text")), 1, 200).alias("text"), F.substring(T.squeezed(F.coalesce(F.col("c.quote"), F.lit(""))), 1, 300).alias("quote")).where("text <> ''")
    first = rows.groupBy("id", F.lower("text").alias("key")).agg(F.min(F.struct("pos", "text", "quote")).alias("c"))
    return first.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("c.pos"))).where(F.col("n") <= most).select("id", F.col("n").alias("claim_no"), "c.text", "c.quote")


def claim_gate(claims: DataFrame, hits: DataFrame, corpus: DataFrame, similarity: float = 0.25, score: float = 5.0) -> DataFrame:
    """Claims (claim_id, source_id) with their three best hits (claim_id, rank, id, score, similarity) of other concepts that are still there; weak ones skipped."""
    met = hits.join(claims.select("claim_id", "source_id"), "claim_id").where("id <> source_id").join(corpus.select("id"), "id", "left_semi")
    rank = Window.partitionBy("claim_id").orderBy("rank", "id")
    met = met.withColumn("place", F.row_number().over(rank)).where("place <= 3")
    top = met.where("place = 1").select("claim_id", F.when(F.col("similarity").isNotNull(), F.col("similarity") >= similarity).otherwise(F.col("score") >= score).alias("strong"))
    return met.join(top.where("strong"), "claim_id", "left_semi").select("claim_id", "place", "id")


def claim_findings(verdicts: DataFrame, candidates: DataFrame) -> DataFrame:
    """(claim_id, verdict, target, reason) joined to candidates (claim_id, place, id, title): the target by id, prefix of it, or title, else unrelated."""
    rows = verdicts.where("verdict = 'contradiction'").join(candidates, "claim_id", "left")
    t = F.trim(F.coalesce("target", F.lit("")))
    how = F.when(F.col("id").cast("string") == t, 1).when((F.length(t) >= 8) & F.startswith(F.col("id").cast("string"), t), 2).when(F.lower(F.trim("title")) == F.lower(t), 3)
    best = rows.withColumn("how", how).groupBy("claim_id").agg(F.min(F.when(F.col("how").isNotNull(), F.struct("how", "place", "id"))).alias("best"))
    return verdicts.join(best, "claim_id", "left").select("claim_id", F.when((F.col("verdict") == "contradiction") & F.col("best").isNull(), "unrelated").otherwise(F.col("verdict")).alias("verdict"), F.col("best.id").alias("target_id"))


def write_triage(requests: DataFrame, candidates: DataFrame, most_chars: int = 12_000) -> DataFrame:
    """(request_id, n_chars, verdict, target) and the candidates asked for (request_id, id, there, n_chars): ok, merge or conflict."""
    sums = candidates.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("there")).alias("gone"), F.count_if(F.col("n_chars") > most_chars).alias("large"), F.min("id").alias("first"), F.collect_set("id").alias("ids"))
    rows = requests.join(sums, "request_id", "left")
    exact = F.coalesce(F.array_contains("ids", F.col("target")), F.lit(False))
    out = (
        F.when(F.col("gone") > 0, "conflict")
        .when(F.coalesce("n", F.lit(0)) == 0, "ok")
        .when((F.col("n_chars") > most_chars) | (F.col("large") > 0), F.when(F.col("verdict") == "merge", "merge").otherwise("conflict"))
        .when(F.col("verdict") == "ok", "ok")
        .when((F.col("verdict") == "merge") & exact, "merge")
        .otherwise("conflict")
    )
    big = (F.col("n_chars") > most_chars) | (F.col("large") > 0)
    return rows.withColumn("outcome", out).select("request_id", "outcome", F.when(F.col("outcome") == "merge", F.when(big, F.col("first")).otherwise(F.col("target"))).alias("target_id"))
