"""Usage analytics and admission control over logs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Shanghai"
# Fixed limits: active at once and per minute for tasks; the same, and tokens a day, for model calls.
TASK_LIMITS = {"active": 2, "minute": 10, "day_tokens": None}
CALL_LIMITS = {"active": 2, "minute": 60, "day_tokens": 500_000}


def half_up(x: Column, digits: int = 0) -> Column:
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale


def percentile(column: str, p: float, exact: bool = True) -> Column:
    """A percentile rounded half to even; without ``exact``, an approximate one in bounded memory."""
    x = F.percentile(column, p) if exact else F.percentile_approx(column, p, 10_000).cast("double")
    return F.coalesce(F.bround(x, 0), F.lit(0)).cast("int")


def recent(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    return rows.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def traffic_summary(log: DataFrame, as_of: str, windows: list[int], exact: bool = True) -> DataFrame:
    """Totals, failures and latency of the last n days, for several n in one pass."""
    spread = log.withColumn("days", F.explode(F.array(*map(F.lit, windows)))).where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval("days"))
    sums = spread.groupBy("days").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") < 400).alias("ok"),
        F.count_if(F.col("status") >= 400).alias("failed"),
        F.coalesce(F.round(F.avg("took_ms")), F.lit(0)).cast("int").alias("avg_ms"),
        percentile("took_ms", 0.5, exact).alias("p50_ms"),
        percentile("took_ms", 0.95, exact).alias("p95_ms"),
    )
    return sums.withColumn("success_rate", half_up(F.col("ok") / F.col("total") * 100, 1))


def search_quality(log: DataFrame, as_of: str, days: int) -> DataFrame:
    sums = recent(log, as_of, days).agg(
        F.count(F.lit(1)).alias("searches"),
        F.count_if(F.col("result_count") == 0).alias("zero_results"),
        F.round(F.avg("result_count"), 1).alias("avg_hits"),
        percentile("took_ms", 0.5).alias("p50_ms"),
        percentile("took_ms", 0.95).alias("p95_ms"),
    )
    return sums.withColumn("zero_rate", F.when(F.col("searches") > 0, half_up(F.col("zero_results") / F.col("searches") * 100, 1)).otherwise(0.0))


def search_modes(log: DataFrame, as_of: str, days: int) -> DataFrame:
    return recent(log, as_of, days).groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("result_count") == 0).alias("zero"))


def key_usage(keys: DataFrame, log: DataFrame, as_of: str, days: int) -> DataFrame:
    """Calls, good calls and contributions of every key that is not revoked; keys without calls stay."""
    gift = (F.col("method") != "GET") & (F.startswith("path", F.lit("/api/concepts")) | F.startswith("path", F.lit("/api/capture")))
    calls = recent(log, as_of, days).groupBy(F.col("api_key_id").alias("key_id")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("status") < 400).alias("ok_calls"), F.count_if(gift & (F.col("status") < 400)).alias("contributions"))
    zero = F.lit(0).cast("long")
    return keys.where("NOT revoked").select("key_id", "owner_id").join(calls, "key_id", "left").select("key_id", "owner_id", *[F.coalesce(c, zero).alias(c) for c in ("calls", "ok_calls", "contributions")])


def key_status(keys: DataFrame, users: DataFrame, as_of: str) -> DataFrame:
    """Keys, live ones first and newest first, and whether each can be used."""
    owners = users.select(F.col("user_id").alias("owner_id"), "disabled")
    usable = ~F.col("revoked") & (F.col("expires_on").isNull() | (F.col("expires_on") > F.lit(as_of).cast("date"))) & ~F.coalesce("disabled", F.lit(True))
    return keys.join(owners, "owner_id", "left").select("key_id", "owner_id", "revoked", usable.alias("usable"), "created_on").orderBy("revoked", F.desc("created_on"), "key_id")


def top_retrieved(corpus: DataFrame, limit: int = 50) -> DataFrame:
    return corpus.where("retrieval_count > 0").orderBy(F.desc("retrieval_count"), F.desc_nulls_last("last_retrieved_at"), "id").limit(limit).select("id", "title", "retrieval_count", F.col("last_retrieved_at").cast("date").alias("last_on"))


def retrieval_counts(corpus: DataFrame, hits: DataFrame) -> DataFrame:
    """(event_id, ts, source, ids) hit log into a counter and last time per live concept; ingest look-ups do not count."""
    counted = hits.where("source <> 'ingest'").select("ts", F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return corpus.select("id").join(counted, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "last")


def library_health(concepts: DataFrame, versions: DataFrame, attachments: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of totals: concepts, deprecated, trash, never retrieved, versions, attachments and bytes, embedded, stale, coverage."""
    live = F.col("deleted_at").isNull()
    a = concepts.agg(F.count_if(live).alias("concepts"), F.count_if(live & (F.col("status") == "deprecated")).alias("deprecated"), F.count_if(~live).alias("trash"), F.count_if(live & (F.col("retrieval_count") == 0)).alias("never_retrieved"))
    b = versions.agg(F.count(F.lit(1)).alias("versions"))
    c = attachments.agg(F.count(F.lit(1)).alias("attachments"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    owned = chunks.groupBy(F.col("concept_id").alias("id")).agg(F.bool_or("stale").alias("stale"))
    e = concepts.where(live).join(owned, "id").agg(F.count(F.lit(1)).alias("embedded"), F.count_if("stale").alias("stale"))
    # Four tables of one row each.
    row = a.crossJoin(b).crossJoin(c).crossJoin(e)
    return row.withColumn("coverage", F.when(F.col("concepts") > 0, half_up(F.col("embedded") / F.col("concepts") * 100, 1)).otherwise(0.0))


def log_list(rows: DataFrame, as_of: str, days: int | None = None, day: str | None = None, owner: int | None = None, limit: int = 100) -> DataFrame:
    """The newest rows of a log; a window of days and a calendar day in the library's zone both apply where given."""
    if days is not None:
        rows = recent(rows, as_of, days)
    if day is not None:
        rows = rows.where(F.from_utc_timestamp("ts", ZONE).cast("date") == F.lit(day).cast("date"))
    if owner is not None:
        rows = rows.where(F.col("user_id") == owner)
    return rows.orderBy(F.desc("ts"), F.desc("event_id")).limit(limit)


def user_activity(users: DataFrame, corpus: DataFrame, keys: DataFrame) -> DataFrame:
    """Per user: live entries, keys that are not revoked, last login; each side counted before it is joined."""
    entries = corpus.groupBy(F.col("owner_id").alias("user_id")).agg(F.count(F.lit(1)).alias("entries"))
    owned = keys.where("NOT revoked").groupBy(F.col("owner_id").alias("user_id")).agg(F.count(F.lit(1)).alias("keys"))
    zero = F.lit(0).cast("long")
    return users.join(entries, "user_id", "left").join(owned, "user_id", "left").select("user_id", "role", "disabled", F.coalesce("entries", zero).alias("entries"), F.coalesce("keys", zero).alias("keys"), F.col("last_login_at").cast("date").alias("last_login_on"))


def library_tiles(corpus: DataFrame, sources: DataFrame, reviews: DataFrame, recent_rows: int = 10) -> DataFrame:
    """(owner_id, tile, rank, value): entries, sources, pending reviews, quality risks, and the last updated concepts."""
    one = lambda df, name: df.groupBy("owner_id").agg(F.count(F.lit(1)).alias("value")).select("owner_id", F.lit(name).alias("tile"), F.lit(0).alias("rank"), "value")
    pending = reviews.where("status = 'pending'")
    rank = F.expr("row_number() OVER (PARTITION BY owner_id ORDER BY updated_at DESC, id)")
    latest = corpus.withColumn("rank", rank).where(F.col("rank") <= recent_rows).select("owner_id", F.lit("recent").alias("tile"), "rank", F.col("id").alias("value"))
    return one(corpus, "entries").unionByName(one(sources, "sources")).unionByName(one(pending, "pending")).unionByName(one(pending.where("kind = 'quality_risk'"), "quality_risks")).unionByName(latest)


def budget_snapshot(calls: DataFrame, at: str) -> DataFrame:
    """At one instant, per actor and overall (null): active leases, calls in the last minute, tokens charged that day."""
    now = F.lit(at).cast("timestamp")
    same_day = F.from_utc_timestamp("ts", ZONE).cast("date") == F.from_utc_timestamp(now, ZONE).cast("date")
    seen = calls.where(F.col("ts") <= now).where(same_day | (F.col("expires_at") > now) | (F.col("ts") > now - F.expr("INTERVAL 1 MINUTE")))
    seen = seen.select("actor", (F.col("actual").isNull() & (F.col("expires_at") > now)).alias("active"), (F.col("ts") > now - F.expr("INTERVAL 1 MINUTE")).alias("minute"), F.when(same_day, F.coalesce("actual", "reserved")).otherwise(0).alias("tokens"))
    return seen.rollup("actor").agg(F.count_if("active").alias("active"), F.count_if("minute").alias("last_minute"), F.sum("tokens").alias("tokens_today"))


def admission_replay(calls: DataFrame, limits: dict | None = None) -> DataFrame:
    """(call_id, actor, verdict) of historical requests, each judged by those admitted before it.

    Admission depends on the owner's earlier admissions, which no window expresses;
    rows stream through a partition in order, so that no owner is held whole.  Tokens
    count by the day of the library's zone; leases and the last minute go on over
    midnight.
    """
    limits = limits or CALL_LIMITS
    day = F.from_utc_timestamp("ts", ZONE).cast("date")
    rows = calls.select("call_id", "actor", day.cast("string").alias("day"), F.unix_micros("ts").alias("at"), F.unix_micros("expires_at").alias("end"), F.coalesce("actual", "reserved").alias("tokens"))
    rows = rows.repartition("actor").sortWithinPartitions("actor", "at", "call_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, day, kept, spent = None, None, [], 0
        for part in batches:
            out = []
            for actor, d, at, end, tokens in zip(part["actor"], part["day"], part["at"], part["end"], part["tokens"], strict=True):
                if key != actor:
                    key, day, kept = actor, None, []
                if day != d:
                    day, spent = d, 0
                now = at / 1e6
                kept = [r for r in kept if r[1] > now or r[0] > now - 60]
                verdict = admit_one(kept, spent, now, int(tokens), limits)
                if verdict == "admitted":
                    kept.append((now, end / 1e6))
                    spent += int(tokens)
                out.append(verdict)
            yield pd.DataFrame({"call_id": part["call_id"], "actor": part["actor"], "verdict": out})

    return rows.mapInPandas(run, "call_id long, actor long, verdict string")


def admit_one(kept: list[tuple], spent: int, now: float, tokens: int, limits: dict) -> str:
    """The verdict on one request, given the admitted (time, lease end) that still matter and the tokens spent."""
    if sum(end > now for _, end in kept) >= limits["active"]:
        return "active"
    if sum(at > now - 60 for at, _ in kept) >= limits["minute"]:
        return "minute"
    if limits["day_tokens"] is not None and spent + tokens > limits["day_tokens"]:
        return "tokens"
    return "admitted"
