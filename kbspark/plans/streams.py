"""Streaming jobs over the test tables, each run until all that is there is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import register
from ..streaming import jobs, rules
from ..streaming.ordered import stateful
from . import fixtures as fx
from .duck import sql


def _events(spark, d, files=8):
    return jobs.stream(spark, f"{d}/events.parquet", files).withColumn("ts", F.col("ts").cast("timestamp"))


class _Streamed:
    """The fixtures' derivations over a stream of events."""

    def __init__(self, spark, files=8):
        self.spark = spark
        self.files = files
        self.read = self

    def parquet(self, path):
        return jobs.stream(self.spark, path, self.files)


def _calls(spark, d, files=8):
    return fx.model_calls(_Streamed(spark, files), d)


def _reports(events):
    kind = "CASE WHEN event_id % 7 = 0 THEN 'other' WHEN event_id % 2 = 0 THEN 'llm' ELSE 'embedding' END"
    json = f"""CASE WHEN event_id % 19 = 0 THEN 'no json' ELSE to_json(named_struct('kind', {kind}, 'purpose', CASE WHEN event_id % 11 = 0 THEN ' ' ELSE ' chat ' END, 'model', 'm', 'tokens', CASE WHEN event_id % 13 = 0 THEN -1 ELSE CAST(floor(value) AS BIGINT) END)) END"""
    return events.select("event_id", F.expr(json).alias("json"))


@register("s_log_ingest", sql("""
SELECT event_id, CASE WHEN event_id % 19 = 0 THEN 'unreadable' WHEN event_id % 7 = 0 THEN 'kind' WHEN event_id % 11 = 0 THEN 'purpose' WHEN event_id % 13 = 0 THEN 'number' END AS fault,
  CASE WHEN event_id % 19 = 0 OR event_id % 13 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS tokens FROM events"""))
def s_log_ingest(spark, d):
    good, bad = jobs.log_ingest_sinks(_reports(_events(spark, d)))
    return good.unionByName(bad).select("event_id", "fault", F.expr("CASE WHEN tokens >= 0 THEN tokens END").alias("tokens"))


@register("s_traffic", sql("""
SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, path, count(*) AS total, count(*) FILTER (WHERE status >= 400) AS failed, round(avg(took_ms), 6) AS avg_ms FROM request_log
WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM request_log) GROUP BY 1, 2"""))
def s_traffic(spark, d):
    rows = jobs.drained(jobs.traffic(fx.request_log(_Streamed(spark, None), d)), "traffic")
    return rows.select(F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "path", "total", "failed", F.round("avg_ms", 6).alias("avg_ms"))


@register("s_call_rate", sql("""
WITH w AS (SELECT actor, date_trunc('minute', ts) + to_seconds(CAST(floor(second(ts) / 10) AS INT) * 10) - to_seconds(k * 10) AS since, ts FROM model_calls, (VALUES (0), (1), (2), (3), (4), (5)) AS ks(k))
SELECT CAST(since AS VARCHAR) AS since, CASE WHEN grouping(actor) = 1 THEN 'all' ELSE 'actor' END AS scope, actor, count(*) AS n FROM w
WHERE ts < since + INTERVAL 1 MINUTE AND since + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM model_calls)
GROUP BY GROUPING SETS ((since, actor), (since)) HAVING count(*) > CASE WHEN grouping(actor) = 1 THEN 1 ELSE 0 END"""))
def s_call_rate(spark, d):
    rows = jobs.drained(jobs.call_rate(_calls(spark, d, None), 0, 1), "call-rate")
    return rows.select(F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "scope", "actor", "n")


@register("s_token_budget", sql("""
WITH c AS (SELECT actor, CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, coalesce(actual, reserved) AS t FROM model_calls)
SELECT CASE WHEN grouping(actor) = 1 THEN 'all' ELSE 'actor' END AS scope, actor, day, CAST(sum(t) AS BIGINT) AS tokens, sum(t) > CASE WHEN grouping(actor) = 1 THEN 100000 ELSE 20000 END AS over FROM c GROUP BY GROUPING SETS ((actor, day), (day))"""))
def s_token_budget(spark, d):
    return jobs.latest(jobs.token_budget(_calls(spark, d), 20_000, 100_000), ["scope", "actor", "day"], "token-budget")


_TASK = "CASE {first} WHEN true THEN 'enqueue' ELSE CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'claim' WHEN 'click' THEN 'progress' WHEN 'purchase' THEN 'finish' ELSE 'fail' END END"
#: (rule, key, sub, kind, how much slower than the table's the clock runs); ``DIV`` divides integers.
RULES = {
    "s_login_throttle": (rules.Throttle(), "concat(lower(trim(concat(' User ', event_id DIV 40, ' '))), '|10.0.0.', event_id % 2)", "''", "CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'check' ELSE 'failure' END", 8),
    "s_task_lifecycle": (rules.Tasks(), "concat('task-', event_id DIV 8)", "''", _TASK.format(first="event_id % 8 = 0"), 1),
    "s_inflight_dedup": (rules.Tasks(), "concat('owner-', event_id DIV 30)", "concat('question-', event_id % 3)", _TASK.format(first="event_id % 30 < 3"), 1),
    "s_repeat_search": (rules.Repeats(), "concat('user-', event_id DIV 100)", "coalesce(event_type, '')", "'search'", 8),
}


def keyed(events, name):
    """(key, sub, id, ts, kind) of the table's events."""
    _, key, sub, kind, slower = RULES[name]
    return events.select(F.expr(key).alias("key"), F.expr(sub).alias("sub"), F.col("event_id").alias("id"), F.expr(f"timestamp_micros(unix_micros(ts) DIV {slower})").alias("ts"), F.expr(kind).alias("kind"))


def _folded(name, columns, step, lapse, due):
    """A twin that takes one event after another: ``step`` gives the state's ``columns`` and the output from those before, null where there is no state."""
    _, key, sub, kind, slower = RULES[name]
    names = list(columns)
    was = ", ".join(f"CASE WHEN gone THEN NULL ELSE f.{c} END AS {c}" for c in names)
    return f"""
WITH RECURSIVE e AS (SELECT {key.replace("DIV", "//")} AS key, {sub} AS sub, event_id AS id, epoch_us(ts) // {slower} AS us, {kind} AS kind FROM events WHERE ts IS NOT NULL AND event_id IS NOT NULL),
w AS (SELECT (max(us) // 1000 - 600000) / 1000.0::DOUBLE AS now FROM e),
ev AS (SELECT key, sub, id, us / 1e6 AS tm, kind, row_number() OVER (PARTITION BY key, sub ORDER BY us, id) AS rn FROM e, w WHERE us / 1e6 <= now),
f AS (SELECT DISTINCT key, sub, 0::BIGINT AS rn, NULL::BIGINT AS id, NULL::DOUBLE AS tm, NULL::VARCHAR AS output, {", ".join(f"NULL::{t} AS {c}" for c, t in columns.items())}, NULL::VARCHAR AS lapse, NULL::DOUBLE AS lapsed_at FROM ev
  UNION ALL SELECT key, sub, rn, id, tm, {step}, lapse, lapsed_at
  FROM (SELECT key, sub, rn, id, tm, kind, lapse, lapsed_at, {", ".join(names)} FROM (
    SELECT e.key, e.sub, e.rn, e.id, e.tm, e.kind, coalesce({due} < e.tm, false) AS gone, CASE WHEN gone THEN {lapse} END AS lapse, CASE WHEN gone THEN {due} END AS lapsed_at, {was}
    FROM f JOIN ev e ON e.key = f.key AND e.sub = f.sub AND e.rn = f.rn + 1))),
ends AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY key, sub ORDER BY rn DESC) = 1),
rows AS (SELECT key, sub, id, tm, output FROM f WHERE rn > 0
  UNION ALL SELECT key, sub, NULL, lapsed_at, lapse FROM f WHERE lapse IS NOT NULL
  UNION ALL SELECT key, sub, NULL, {due}, {lapse} FROM ends f, w WHERE {due} < now AND {lapse} IS NOT NULL)
SELECT key, sub, id, CAST(round(tm * 1e6) AS BIGINT) AS at_us, output FROM rows"""


_TASK_STEP = """CASE WHEN status IS NULL THEN CASE WHEN kind = 'enqueue' THEN 'queued' ELSE 'ignored' END WHEN kind = 'enqueue' THEN 'reuse ' || task
    WHEN (status = 'queued' AND kind = 'claim') OR (status = 'running' AND kind = 'progress') THEN 'running' WHEN kind = 'fail' THEN 'failed' WHEN status = 'running' AND kind = 'finish' THEN 'done' ELSE 'ignored' END,
  CASE WHEN status IS NULL THEN CASE WHEN kind = 'enqueue' THEN 'queued' END WHEN (status = 'queued' AND kind = 'claim') OR (status = 'running' AND kind = 'progress') THEN 'running'
    WHEN kind = 'fail' OR (status = 'running' AND kind = 'finish') THEN NULL ELSE status END,
  CASE WHEN (status IS NULL AND kind = 'enqueue') OR (status = 'queued' AND kind = 'claim') OR (status = 'running' AND kind = 'progress') THEN tm ELSE seen END,
  CASE WHEN status IS NULL THEN id ELSE task END"""
_TASK_TWIN = ({"status": "VARCHAR", "seen": "DOUBLE", "task": "BIGINT"}, _TASK_STEP, "CASE f.status WHEN 'queued' THEN 'failed: never started' WHEN 'running' THEN 'failed: lost' END", "CASE WHEN f.status IS NOT NULL THEN f.seen + 300 END")
TWINS = {
    "s_login_throttle": ({"start": "DOUBLE", "fails": "BIGINT"}, """CASE WHEN fails >= 5 THEN 'locked' ELSE 'allowed' END,
  CASE WHEN coalesce(fails, 0) >= 5 OR kind = 'check' THEN start WHEN kind = 'success' THEN NULL ELSE coalesce(start, tm) END,
  CASE WHEN coalesce(fails, 0) >= 5 OR kind = 'check' THEN fails WHEN kind = 'success' THEN NULL ELSE coalesce(fails, 0) + 1 END""", "NULL::VARCHAR", "f.start + 900"),
    "s_task_lifecycle": _TASK_TWIN,
    "s_inflight_dedup": _TASK_TWIN,
    "s_repeat_search": ({"start": "DOUBLE"}, "CASE WHEN tm - start < 60 THEN 'repeat' ELSE 'logged' END, CASE WHEN tm - start < 60 THEN start ELSE tm END", "NULL::VARCHAR", "f.start + 60"),
}


def _ruled(name):
    def run(spark, d):
        rows = jobs.drained(stateful(keyed(_events(spark, d, None), name), RULES[name][0]), name)
        return rows.select("key", "sub", "id", F.expr("CAST(round(at * 1e6) AS BIGINT)").alias("at_us"), "output")

    return run


for _name in RULES:
    register(_name, _folded(_name, *TWINS[_name]))(_ruled(_name))


@register("s_retrieval", sql("""
WITH h AS (SELECT user_id AS id, count(*) AS n FROM events WHERE event_type IN ('view', 'click') GROUP BY 1)
SELECT coalesce(c.id, h.id) AS id, CAST(coalesce(c.retrieval_count, 0) + coalesce(h.n, 0) AS BIGINT) AS n FROM corpus c FULL JOIN h ON h.id = c.id"""))
def s_retrieval(spark, d):
    hits = _events(spark, d).where("event_type IN ('view', 'click')").select(F.col("user_id").alias("id"))
    return jobs.retrieval(hits, fx.corpus(spark, d).select("id", F.col("retrieval_count").alias("n")))


@register("s_retention", sql("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM request_log WHERE CAST(ts AS DATE) >= DATE '2024-01-31' - 15 GROUP BY 1"))
def s_retention(spark, d):
    return jobs.retention(fx.request_log(_Streamed(spark), d), fx.AS_OF, 15).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@register("s_chunk_refresh")
def s_chunk_refresh(spark, d):
    saves = jobs.stream(spark, f"{d}/documents.parquet").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), F.lit(1).alias("seq"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.col("text").alias("body"))
    stored = fx.table(spark, d, "documents").where("text IS NOT NULL").selectExpr("doc_id AS id", "0 AS ordinal", "CASE WHEN doc_id % 2 = 0 THEN sha2(CAST(text AS BINARY), 256) ELSE 'old' END AS content_hash", "text")
    return jobs.chunk_refresh(saves, stored)


@register("s_capture", sql(r"""
WITH n AS (SELECT conv_id * 1000 + turn AS note_id, trim(text) AS text, CASE WHEN turn % 4 = 0 THEN 'given ' || conv_id END AS title FROM conversations)
SELECT note_id, substr(coalesce(title, '2024-01-31 ' || substr(trim(regexp_replace(string_split(text, chr(10))[1], '\s+', ' ', 'g')), 1, 60)), 1, 200) AS title, CAST(length(text) AS INT) AS n_chars, 'draft' AS status, CASE WHEN length(text) < 1 THEN 'empty' WHEN length(text) > 5000 THEN 'long' END AS fault FROM n"""))
def s_capture(spark, d):
    notes = jobs.stream(spark, f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("note_id"), F.expr("CASE WHEN turn % 4 = 0 THEN concat(' given ', conv_id) END").alias("title"), "text", F.lit("2024-01-31").cast("date").alias("day"))
    return jobs.drained(jobs.capture(notes), "capture")
