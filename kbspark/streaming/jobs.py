"""Structured Streaming jobs.  Each has a batch twin: the same DataFrame code, or the same rule replayed in order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import squeezed
from ..operators.usage import ZONE
from ..operators.vectors import chunk_corpus
from ..session import materialise, new_dir
from .versions import Layered, Versioned


def stream(spark: SparkSession, path: str, files: int | None = 8) -> DataFrame:
    """A table as a file stream; ``path`` names a file or a folder.

    Files come in no order of time.  A job with a watermark, or one that goes by
    the order of events, must have all that is stored in one trigger: ``files`` None.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader if files is None else reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def drained(df: DataFrame, name: str, mode: str = "append", root: str | None = None) -> DataFrame:
    """Run a stream over all that is there and read what it wrote; with the ``root`` of an earlier run it goes on from there."""
    spark = df.sparkSession
    root = root or new_dir(spark, name)
    query = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def each_batch(df: DataFrame, name: str, put: Callable[[DataFrame, int], None], mode: str = "append", root: str | None = None) -> None:
    """Run a stream over all that is there through ``put(rows, batch)``; with the ``root`` of an earlier run it goes on from there."""
    root = root or new_dir(df.sparkSession, name)
    df.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()


# What a usage report may say.
KINDS = ["llm", "embedding"]
REPORT = "kind string, purpose string, model string, input_chars long, tokens long, ok boolean, error string"


def log_ingest(raw: DataFrame) -> DataFrame:
    """(event_id, json) usage reports, clamped; ``fault`` names what is wrong with one."""
    x = raw.withColumn("r", F.from_json("json", REPORT))
    bad = lambda c: F.col(c).isNotNull() & ((F.col(c) < 0) | (F.col(c) > 10_000_000))
    fault = (
        F.when(F.col("r").isNull() | F.col("r.kind").isNull(), "unreadable")
        .when(~F.col("r.kind").isin(KINDS), "kind")
        .when(F.coalesce(F.trim("r.purpose"), F.lit("")) == "", "purpose")
        .when(F.coalesce(F.trim("r.model"), F.lit("")) == "", "model")
        .when(bad("r.input_chars") | bad("r.tokens"), "number")
    )
    return x.select("event_id", fault.alias("fault"), "r.kind", F.substring(F.trim("r.purpose"), 1, 64).alias("purpose"), F.substring(F.trim("r.model"), 1, 128).alias("model"), "r.tokens", F.substring("r.error", 1, 500).alias("error"))


def log_ingest_sinks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Run ``log_ingest`` into two tables, rows and quarantine, each batch under its number."""
    spark = raw.sparkSession
    root = new_dir(spark, "usage")

    def put(rows: DataFrame, batch: int) -> None:
        rows.where("fault IS NULL").write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")
        rows.where("fault IS NOT NULL").write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch}")

    checked = log_ingest(raw)
    each_batch(checked, "usage-ingest", put)
    return tuple(spark.read.schema(checked.schema).parquet(f"{root}/{part}") for part in ("rows", "quarantine"))


def traffic(log: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Totals, failures and mean latency by route and hour; an hour is final once the watermark has passed it."""
    rows = log.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "path")
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") >= 400).alias("failed"), F.avg("took_ms").alias("avg_ms")).select(F.col("w.start").alias("hour"), "path", "total", "failed", "avg_ms")


def _with_all(calls: DataFrame) -> DataFrame:
    """Each call once for its actor and once for all of them together, ``scope`` actor or all; partial sums keep the latter small."""
    return calls.withColumn("scope", F.explode(F.array(F.lit("actor"), F.lit("all")))).withColumn("actor", F.when(F.col("scope") == "actor", F.col("actor")))


def call_rate(calls: DataFrame, limit: int, overall: int, late: str = "10 minutes") -> DataFrame:
    """Actors with more calls than ``limit`` in a sliding minute, and minutes with more than ``overall`` of all actors (``scope`` all, null actor)."""
    rows = _with_all(calls.withWatermark("ts", late)).groupBy(F.window("ts", "1 minute", "10 seconds").alias("w"), "scope", "actor").agg(F.count(F.lit(1)).alias("n"))
    most = F.when(F.col("scope") == "all", overall).otherwise(limit)
    return rows.where(F.col("n") > most).select(F.col("w.start").alias("since"), "scope", "actor", "n")


def token_budget(calls: DataFrame, limit: int, overall: int) -> DataFrame:
    """Tokens of each actor, and of all (``scope`` all, null actor), by calendar day of the library's zone, and whether they exceed the budget."""
    day = F.from_utc_timestamp("ts", ZONE).cast("date")
    sums = _with_all(calls).groupBy("scope", "actor", day.alias("day")).agg(F.sum(F.coalesce("actual", "reserved")).alias("tokens"))
    return sums.withColumn("over", F.col("tokens") > F.when(F.col("scope") == "all", overall).otherwise(limit))


def latest(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run an aggregation in update mode; of each key's states the last is kept."""
    spark = df.sparkSession
    root = new_dir(spark, name)

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("__batch", F.lit(batch)).write.mode("overwrite").parquet(f"{root}/out/{batch:06d}")

    each_batch(df, name, put, "update")
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__batch", T.IntegerType())])).option("recursiveFileLookup", True).parquet(f"{root}/out")
    rest = [c for c in df.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("r")).select(*keys, "r.*")


def retrieval(hits: DataFrame, start: DataFrame, root: str | None = None) -> DataFrame:
    """Merge a stream of hits (id) into a counter table (id, n), versions of which are kept below ``root``: each batch counts once."""
    spark = hits.sparkSession
    root = root or new_dir(spark, "counters")
    table = Versioned(spark, f"{root}/table")
    table.start(start.select("id", F.col("n").cast("long").alias("n")))

    def merge(old: DataFrame, rows: DataFrame) -> DataFrame:
        new = rows.groupBy("id").agg(F.count(F.lit(1)).alias("more"))
        return old.join(new, "id", "full_outer").select("id", (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"))

    each_batch(hits.select("id"), "retrieval", table.step(merge), root=root)
    return table.read()


def retention(log: DataFrame, as_of: str, days: int = 180, root: str | None = None) -> DataFrame:
    """Write a log by day, and drop the days behind the horizon after each batch.

    A batch overwrites the folders of its own number in each day, so a batch that is
    done again changes nothing.
    """
    spark = log.sparkSession
    root = root or new_dir(spark, "retention")
    oldest = spark.range(1).select(F.date_sub(F.lit(as_of).cast("date"), days).cast("string")).first()[0]

    def put(rows: DataFrame, batch: int) -> None:
        kept = rows.withColumn("day", F.col("ts").cast("date").cast("string")).withColumn("batch", F.lit(batch)).where(F.col("day") >= oldest)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{root}/log")
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("day=") and name[4:] < oldest:
                files.delete(status.getPath(), True)

    each_batch(log, "retention-stream", put, root=root)
    return spark.read.schema(T.StructType([*log.schema.fields, T.StructField("day", T.StringType()), T.StructField("batch", T.IntegerType())])).parquet(f"{root}/log")


def chunk_refresh(saves: DataFrame, stored: DataFrame, root: str | None = None) -> DataFrame:
    """A stream of saves (id, seq, content_hash, body): only concepts whose text has changed are cut again, and published whole.

    The chunk table is kept below ``root``, with a layer for each batch that has only the
    concepts that it has cut.  A batch's texts are shuffled once, to find each concept's
    last save; what the table holds is met by id and hash, and no stored text is read.
    A concept is cut in one place from one save, so its set is whole.
    """
    spark = saves.sparkSession
    root = root or new_dir(spark, "chunks")
    columns = stored.select("id", "ordinal", "content_hash", "text")
    table = Layered(spark, f"{root}/table", "id", ", ".join(f"{c} {kind}" for c, kind in columns.dtypes))
    table.start(columns)

    def publish(held: DataFrame, rows: DataFrame) -> DataFrame:
        saved = materialise(rows.select("id", "content_hash").distinct(), "saved")
        same = held.select("id", "content_hash").join(saved, ["id", "content_hash"], "left_semi").groupBy("id").agg(F.collect_set("content_hash").alias("same"))
        last = rows.groupBy("id").agg(F.max_by(F.struct("content_hash", "body"), "seq").alias("s")).select("id", "s.*")
        # By id alone, as they lie already: texts are not shuffled again.
        met = last.where("id IS NOT NULL AND content_hash IS NOT NULL").join(same, "id", "left")
        changed = met.where(~F.coalesce(F.array_contains("same", F.col("content_hash")), F.lit(False)))
        return chunk_corpus(changed, keep=("content_hash",)).select("id", "ordinal", "content_hash", "text")

    each_batch(saves, "chunk-refresh", table.step(publish), root=root)
    return table.read()


def capture(notes: DataFrame) -> DataFrame:
    """(note_id, title, text, day) notes as drafts; texts of 1 to 5000 characters, a given title or the dated first line."""
    text = F.trim(F.coalesce("text", F.lit("")))
    first = F.substring(squeezed(F.element_at(F.split(text, "\n"), 1)), 1, 60)
    title = F.substring(F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.trim("title")).otherwise(F.concat(F.col("day").cast("string"), F.lit(" "), first)), 1, 200)
    fault = F.when(F.length(text) < 1, "empty").when(F.length(text) > 5000, "long")
    return notes.select("note_id", title.alias("title"), F.length(text).alias("n_chars"), F.lit("draft").alias("status"), fault.alias("fault"))
