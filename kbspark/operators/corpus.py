"""The versioned corpus: folding feeds into versions, current state, trash and lists."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import common_lines


def content_hash(body: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(body.cast("binary"), 256))


def corpus_current(concepts: DataFrame, versions: DataFrame, users: DataFrame, attachments: DataFrame) -> DataFrame:
    """Live concepts at their current version, with the owner's name and the number of attachments."""
    at = versions.select(F.col("concept_id").alias("id"), F.col("version_number").alias("current_version"), F.col("body").alias("version_body"))
    files = attachments.groupBy(F.col("concept_id").alias("id")).agg(F.count(F.lit(1)).alias("attachment_count"))
    names = users.select(F.col("user_id").alias("owner_id"), "username")
    joined = concepts.where("deleted_at IS NULL").join(at, ["id", "current_version"]).join(names, "owner_id", "left").join(files, "id", "left")
    return joined.withColumn("attachment_count", F.coalesce("attachment_count", F.lit(0)))


def version_fold(feed: DataFrame, metadata: list[str]) -> DataFrame:
    """A feed of saves (concept_id, seq, body, metadata, saved_on) as immutable versions.

    A save opens a version when its body differs from the save before; the last
    save within a version gives the version's metadata.
    """
    order = Window.partitionBy("concept_id").orderBy("seq")
    hashed = feed.withColumn("content_hash", content_hash(F.col("body")))
    changed = F.coalesce((F.lag("content_hash").over(order) != F.col("content_hash")).cast("int"), F.lit(1))
    numbered = hashed.withColumn("changed", changed).withColumn("version_number", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    last = F.max_by(F.struct(*metadata), "seq").alias("last")
    rows = numbered.groupBy("concept_id", "version_number").agg(last, F.min_by("content_hash", "seq").alias("content_hash"), F.min_by("body", "seq").alias("body"), F.min("saved_on").alias("created_on"), F.max("saved_on").alias("updated_on"))
    return rows.select("concept_id", "version_number", *[F.col(f"last.{m}").alias(m) for m in metadata], "content_hash", "body", "created_on", "updated_on")


def current_state(versions: DataFrame, metadata: list[str]) -> DataFrame:
    """One current row per concept from its version rows."""
    last = F.max_by(F.struct("version_number", *metadata, "content_hash"), "version_number").alias("last")
    return versions.groupBy("concept_id").agg(last, F.min("created_on").alias("created_on"), F.max("updated_on").alias("updated_on")).select(
        "concept_id", F.col("last.version_number").alias("current_version"), *[F.col(f"last.{m}").alias(m) for m in metadata], F.col("last.content_hash").alias("content_hash"), "created_on", "updated_on"
    )


def version_restore(feed: DataFrame, versions: DataFrame, current: DataFrame, requests: DataFrame, metadata: list[str]) -> DataFrame:
    """The feed with one more save per restore request (concept_id, version_number, seq, saved_on).

    The save carries the version's snapshot; a null type or title falls back to
    the current one.  Requests for versions that are not there are dropped.
    """
    now = current.select("concept_id", F.col("title").alias("now_title"), F.col("type").alias("now_type"))
    asked = requests.join(versions.select("concept_id", "version_number", "body", *metadata), ["concept_id", "version_number"]).join(now, "concept_id", "left")
    for c in ("title", "type"):
        asked = asked.withColumn(c, F.coalesce(c, f"now_{c}"))
    return feed.unionByName(asked.select(feed.columns))


def snapshot_asof(versions: DataFrame, instants: DataFrame) -> DataFrame:
    """For every (concept_id, as_of) the version in force then; none before the first.

    Versions and instants are one sorted list for each concept, in which an instant
    takes the last version before it.
    """
    v = F.struct("version_number", "title", "created_on")
    made = versions.select("concept_id", F.col("created_on").alias("at"), F.col("version_number").alias("n"), v.alias("v"), F.lit(False).alias("asked"))
    asked = instants.select("concept_id", F.col("as_of").alias("at"), F.lit(None).alias("n"), F.lit(None).alias("v"), F.lit(True).alias("asked")).distinct()
    held = F.last("v", ignorenulls=True).over(Window.partitionBy("concept_id").orderBy("at", "asked", "n").rowsBetween(Window.unboundedPreceding, 0))
    found = made.unionByName(asked).withColumn("held", held).where(F.col("asked") & F.col("held").isNotNull() & F.col("at").isNotNull())
    return found.select("concept_id", F.col("at").alias("as_of"), "held.*")


def snapshot_backfill(versions: DataFrame, current: DataFrame, metadata: list[str]) -> DataFrame:
    """Version rows without a snapshot (null title) take the current metadata; others stay as they are."""
    now = current.select(F.col("id").alias("concept_id"), *[F.col(m).alias(f"now_{m}") for m in metadata])
    joined = versions.join(now, "concept_id", "left")
    fill = {m: F.when(F.col("title").isNull(), F.col(f"now_{m}")).otherwise(F.col(m)) for m in metadata}
    return joined.select(*[fill.get(c, F.col(c)).alias(c) for c in versions.columns])


def source_lineage(feed: DataFrame, concepts: DataFrame) -> DataFrame:
    """The first save of each body of each concept that is still there."""
    first = feed.withColumn("content_hash", content_hash(F.col("body"))).groupBy("concept_id", "content_hash").agg(F.min("seq").alias("first_seq"), F.min("saved_on").alias("created_on"), F.min_by(F.length("body"), "seq").alias("n_chars"))
    return first.join(concepts.select(F.col("id").alias("concept_id"), "owner_id", "title"), "concept_id")


def exact_dup_guard(creates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Creates (seq, owner_id, content_hash) against the live corpus and the ones before them in the batch."""
    have = corpus.groupBy("owner_id", "content_hash").agg(F.min("id").alias("existing_id"))
    rows = creates.join(have, ["owner_id", "content_hash"], "left")
    place = F.row_number().over(Window.partitionBy("owner_id", "content_hash").orderBy("seq"))
    first = F.first("seq").over(Window.partitionBy("owner_id", "content_hash").orderBy("seq"))
    verdict = F.when(F.col("existing_id").isNotNull(), "rejected").when(F.col("place") > 1, "rejected").otherwise("accepted")
    return rows.withColumn("place", place).withColumn("first_seq", first).select("seq", "owner_id", verdict.alias("verdict"), "existing_id", F.when(F.col("existing_id").isNull() & (F.col("place") > 1), F.col("first_seq")).alias("same_as_seq"))


def trash_apply(concepts: DataFrame, requests: DataFrame) -> DataFrame:
    """Trash requests (concept_id, seq, action, on) applied in order: each one's outcome, and deleted_on after it.

    Outcomes are trashed, restored, purged, or the refusals not-found and
    not-trashed.  What a request finds follows from the last trash or restore before
    it, and from whether a purge before it found the concept in the trash, so running
    values in one order give what applying one after the other gives.
    """
    have = concepts.select(F.col("id").alias("concept_id"), F.lit(True).alias("there"), F.col("deleted_at").cast("date").alias("was"))
    rows = requests.join(have, "concept_id", "left")
    order = Window.partitionBy("concept_id").orderBy("seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turned = F.last(F.when(F.col("action").isin("trash", "restore"), F.col("action")), ignorenulls=True).over(before)
    rows = rows.withColumn("trashed", F.coalesce(turned == "trash", F.col("was").isNotNull()))
    emptied = (F.col("action") == "purge") & F.col("trashed")
    rows = rows.withColumn("gone", F.col("there").isNull() | F.coalesce(F.max(emptied).over(before), F.lit(False)))
    outcome = (
        F.when(F.col("gone") | ((F.col("action") == "trash") & F.col("trashed")), "not-found")
        .when(F.col("action") == "trash", "trashed")
        .when(~F.col("trashed"), "not-trashed")
        .when(F.col("action") == "restore", "restored")
        .otherwise("purged")
    )
    rows = rows.withColumn("outcome", outcome)
    since = F.last(F.when(F.col("outcome") == "trashed", F.col("on")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = (F.col("outcome") == "trashed") | (F.col("trashed") & ~F.col("gone") & ~F.col("outcome").isin("restored", "purged"))
    return rows.select("concept_id", "seq", "action", "outcome", F.when(kept, F.coalesce(since, "was")).alias("deleted_on"))


def purge_cascade(purged: DataFrame, versions: DataFrame, sources: DataFrame, attachments: DataFrame, chunks: DataFrame, reviews: DataFrame) -> DataFrame:
    """What a purge does to each dependent table: (part, key, action).

    Versions, files and chunks (concept_id, chunk_id) go with the concept; its sources,
    and review items (item_id, target_id, resolved_id) that point to it, stay and lose it.
    """
    ids = purged.select("concept_id").distinct()
    gone = versions.join(ids, "concept_id", "left_semi").select(F.lit("version").alias("part"), F.concat_ws(":", "concept_id", "version_number").alias("key"), F.lit("delete").alias("action"))
    files = attachments.join(ids, "concept_id", "left_semi").select(F.lit("attachment").alias("part"), F.col("storage_key").alias("key"), F.lit("delete").alias("action"))
    kept = sources.join(ids, "concept_id", "left_semi").select(F.lit("source").alias("part"), F.concat_ws(":", "concept_id", "content_hash").alias("key"), F.lit("unlink").alias("action"))
    cut = chunks.join(ids, "concept_id", "left_semi").select(F.lit("chunk").alias("part"), F.col("chunk_id").cast("string").alias("key"), F.lit("delete").alias("action"))
    points = reviews.select("item_id", F.explode(F.create_map(F.lit("target"), F.col("target_id"), F.lit("resolved"), F.col("resolved_id"))).alias("role", "concept_id"))
    lost = points.join(ids, "concept_id", "left_semi").select(F.concat(F.lit("review-"), "role").alias("part"), F.col("item_id").cast("string").alias("key"), F.lit("unlink").alias("action"))
    return gone.unionByName(files).unionByName(kept).unionByName(cut).unionByName(lost)


def trash_list(concepts: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of soft-deleted rows, last deleted first."""
    page = concepts.where("deleted_at IS NOT NULL").orderBy(F.desc("deleted_at"), "id").offset(offset).limit(min(max(limit, 1), 200))
    return page.select("id", "owner_id", "title", F.col("deleted_at").cast("date").alias("deleted_on"))


def version_churn(versions: DataFrame) -> DataFrame:
    """Each version's lines against its successor's: added, removed and kept, repeated lines counted."""
    lines = versions.select("concept_id", "version_number", F.explode(F.split("body", "\n")).alias("line")).groupBy("concept_id", "version_number", "line").agg(F.count(F.lit(1)).alias("n"))
    old = lines.select("concept_id", F.col("version_number").alias("from_version"), "line", F.col("n").alias("n_old"))
    new = lines.select("concept_id", (F.col("version_number") - 1).alias("from_version"), "line", F.col("n").alias("n_new"))
    pairs = versions.select("concept_id", (F.col("version_number") - 1).alias("from_version")).where("from_version > 0")
    met = old.join(new, ["concept_id", "from_version", "line"], "full_outer").join(pairs, ["concept_id", "from_version"], "left_semi")
    a, b = F.coalesce("n_old", F.lit(0)), F.coalesce("n_new", F.lit(0))
    sums = met.groupBy("concept_id", "from_version").agg(F.sum(F.greatest(b - a, F.lit(0))).alias("added"), F.sum(F.greatest(a - b, F.lit(0))).alias("removed"), F.sum(F.least(a, b)).alias("kept"))
    total = F.col("added") + F.col("removed") + F.col("kept")
    return sums.withColumn("churn", F.round((F.col("added") + F.col("removed")) / total, 4))


def version_diff(versions: DataFrame, current: DataFrame) -> DataFrame:
    """Each version (concept_id, version_number, body) against its concept as it is now (concept_id, body): lines added, removed, kept and moved.

    ``kept`` is the longest run of lines that both have in the same order, so a line
    that only changed its place counts as removed and added; ``moved`` says how many
    did.  An empty or null body has no lines; a concept that is gone gives no rows.
    """
    now = current.select("concept_id", F.coalesce("body", F.lit("")).alias("new"))
    pairs = versions.select("concept_id", "version_number", F.coalesce("body", F.lit("")).alias("old")).join(now, "concept_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [common_lines(a, b) for a, b in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True)]
            counts = [pa.array([x[i] for x in found], pa.int32()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("concept_id"), batch.column("version_number"), *counts], names=["concept_id", "version_number", "n_old", "n_new", "kept", "shared"])

    kinds = dict(pairs.dtypes)
    # Equal bodies need no comparison.
    other = pairs.where("old <> new").mapInArrow(compare, f"concept_id {kinds['concept_id']}, version_number {kinds['version_number']}, n_old int, n_new int, kept int, shared int")
    n = F.when(F.col("old") == "", 0).otherwise(F.size(F.split("old", "\n"))).cast("int")
    same = pairs.where("old = new").select("concept_id", "version_number", n.alias("n_old"), n.alias("n_new"), n.alias("kept"), n.alias("shared"))
    rows = other.unionByName(same)
    return rows.select("concept_id", "version_number", (F.col("n_new") - F.col("kept")).alias("added"), (F.col("n_old") - F.col("kept")).alias("removed"), "kept", (F.col("shared") - F.col("kept")).alias("moved"))


def in_subtree(category: Column, path: Column) -> Column:
    return (category == path) | F.startswith(category, F.concat(path, F.lit("/")))


def concept_list(corpus: DataFrame, status: str | None = None, path: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of live concepts, last updated first."""
    rows = corpus
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if path is not None:
        rows = rows.where(in_subtree(F.col("category"), F.lit(path)))
    return rows.orderBy(F.desc("updated_at"), "id").offset(offset).limit(limit).select("id", "title", "category", "status", F.col("updated_at").cast("date").alias("updated_on"))


def concept_count(corpus: DataFrame, requests: DataFrame, per_page: int = 20) -> DataFrame:
    """Totals and pages for a table of requests (request_id, owner_id, status?, path?).

    The corpus is counted once by (owner, status, category path); a request then
    adds up few rows.
    """
    counts = corpus.groupBy("owner_id", "status", "category").agg(F.count(F.lit(1)).alias("n"))
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("category", "/"))), lambda i: F.array_join(F.slice(F.split("category", "/"), 1, i), "/")))
    by_path = counts.select("owner_id", "status", prefix.alias("path"), "n").unionByName(counts.select("owner_id", "status", F.lit(None).cast("string").alias("path"), "n"))
    by_path = by_path.groupBy("owner_id", "path", "status").agg(F.sum("n").alias("n"))
    r, c = requests.alias("r"), by_path.alias("c")
    met = r.join(c, (F.col("r.owner_id") == F.col("c.owner_id")) & F.col("r.path").eqNullSafe(F.col("c.path")) & (F.col("r.status").isNull() | (F.col("r.status") == F.col("c.status"))), "left")
    total = met.groupBy("r.request_id").agg(F.coalesce(F.sum("c.n"), F.lit(0)).alias("total"))
    return total.select("request_id", "total", F.greatest(F.ceil(F.col("total") / per_page), F.lit(1)).cast("long").alias("pages"))
