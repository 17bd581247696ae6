"""Bundles of Markdown files with a header, and attachments."""

from __future__ import annotations

import json
import os
import re
import textwrap
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.places import numbered
from ..session import materialise, over_all_cores

# Limits of header fields, states, and folders of type words.
CLAMPS = {"type": 64, "description": 1000, "category": 200}
MAX_TAGS = 30
#: Titles of one page of a folder's listing.
PAGE_TITLES = 500
STATUSES = ("draft", "stable", "deprecated")
FOLDERS = {"note": "notes", "notes": "notes", "reference": "references", "references": "references", "procedure": "procedures", "procedures": "procedures"}
ROWS = "file string, error string, id long, title string, type string, description string, category string, status string, tags array<string>, body string"


def render(row: dict) -> str:
    """One concept as Markdown: header lines as JSON strings (which YAML reads), then the body as it is."""
    head = {"id": row["id"], "title": row["title"], "type": row["type"], "description": row["description"], "category": row["category"], "status": row["status"], "tags": list(row["tags"] if row["tags"] is not None else []), "title_heading": "body"}
    return "---\n" + "".join(f"{k}: {json.dumps(v, ensure_ascii=False)}\n" for k, v in head.items() if v is not None) + "---\n" + row["body"]


_HEADER = re.compile(r"---\r?\n(.*?)\r?\n---(?:\r?\n|\Z)", re.S)


def _scalar(text: str):
    """A value on one line: JSON, a plain list in brackets, or text with its quotes off; None for nothing."""
    text = text.strip()
    try:
        return json.loads(text)
    except ValueError:
        pass
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    return None if text in ("", "~", "null") else text


def header(text: str) -> dict:
    """The fields of a header: values of one line, lists of dashes, blocks of text, and maps of such fields one level below."""
    lines, fields, i = text.split("\n"), {}, 0
    while i < len(lines):
        key, found, value = lines[i].partition(":")
        i += 1
        if not found or not key.strip() or key[:1] in " \t#-":
            continue
        inner = []
        while i < len(lines) and (not lines[i].strip() or lines[i][0] in " \t" or lines[i].startswith("- ")):
            inner.append(lines[i])
            i += 1
        key, mark = key.strip().strip("'\""), value.strip()
        items = [x.strip() for x in inner if x.strip()]
        if mark[:1] in ("|", ">"):
            kept = textwrap.dedent("\n".join(inner)).rstrip("\n")
            fields[key] = kept if mark[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", kept)
        elif not mark and items and all(x == "-" or x.startswith("- ") for x in items):
            fields[key] = [_scalar(x[1:]) for x in items]
        elif not mark and items:
            fields[key] = header(textwrap.dedent("\n".join(inner)))
        else:
            # A plain or quoted value may go on over lines that are set in.
            fields[key] = _scalar(" ".join([mark, *items]))
    return fields


def parse(text: str) -> dict:
    """The fields of a bundle file, or its error."""
    found = _HEADER.match(text)
    if not found:
        return {"error": "no header"}
    fields = header(found[1].replace("\r\n", "\n"))
    body = text[found.end() :]
    title = str(fields.get("title") or "").strip()
    if not title:
        return {"error": "no title"}
    if fields.get("status", "stable") not in STATUSES:
        return {"error": "unknown status"}
    layout = fields.get("title_heading") or (fields["kb"].get("title_heading") if isinstance(fields.get("kb"), dict) else None)
    if layout != "body" and body.lstrip("\n").startswith(f"# {title}\n"):
        body = body.lstrip("\n")[len(title) + 3 :].lstrip("\n")
    if not body.strip():
        return {"error": "empty body"}
    tags = fields.get("tags") or []
    out = {"id": fields.get("id"), "title": title, "status": fields.get("status", "stable"), "tags": [str(t).strip() for t in tags if t is not None and str(t).strip()][:MAX_TAGS] if isinstance(tags, list) else [], "body": body}
    return out | {k: (str(fields[k])[:n] if fields.get(k) is not None else None) for k, n in CLAMPS.items()}


def slug(title: str, key: str) -> str:
    """A file name: letters and digits of the title joined by hyphens, and part of the key."""
    words = "".join(c.lower() if c.isalnum() else " " for c in title).split()
    return f"{'-'.join(words)[:60] or 'untitled'}-{key[:32]}.md"


def folder(kind: str) -> str:
    words = "".join(c.lower() if c.isalnum() else " " for c in kind or "").split()
    return next((FOLDERS[w] for w in words if w in FOLDERS), words[0] if words else "notes")


def _store(uri: str):
    """A folder's file system and its path there, as tasks open it."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def bundle_write(corpus: DataFrame, uri: str) -> DataFrame:
    """Write one Markdown file per concept below ``uri``; returns (id, path, n_bytes).

    Bytes and names follow from the rows alone; each file appears under its name
    only when it is whole.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(uri)
        made: set[str] = set()
        for rows in batches:
            out = []
            for row in rows.to_dict("records"):
                where = ("deprecated/" if row["status"] == "deprecated" else "") + folder(row["type"])
                path = f"{where}/{slug(row['title'], row['key'])}"
                data = render(row).encode()
                if where not in made:
                    store.create_dir(f"{base}/{where}", recursive=True)
                    made.add(where)
                held = f"{base}/{where}/.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(held) as f:
                    f.write(data)
                store.move(held, f"{base}/{path}")
                out.append((row["id"], path, len(data)))
            yield pd.DataFrame(out, columns=["id", "path", "n_bytes"])

    key = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 32)
    rows = corpus.select("id", "title", "type", "description", "category", "status", "tags", "body", key.alias("key"))
    return materialise(rows.mapInPandas(run, "id long, path string, n_bytes long"), "bundle")


#: Parts of a file listing that one task reads at most, where the cores have enough; Spark deals some thirty small files to a part.
PARTS_TOGETHER = 256


#: Bytes of files that a task parses together.
BYTES_TOGETHER = 4 << 20


def bundle_read(spark: SparkSession, uri: str, written: DataFrame | None = None) -> DataFrame:
    """All Markdown files below ``uri`` but index.md and log.md, as rows or with an error (``ROWS``).

    Where a table of the files' paths is at hand (``written``, as ``bundle_write`` gives
    it), tasks open the files by it and no list of them is made on the driver.
    """
    named = written is not None
    if named:
        paths = over_all_cores(written.select("path"), "path").distinct()
        files = paths.where(F.endswith("path", F.lit(".md")) & ~F.element_at(F.split("path", "/"), -1).isin("index.md", "log.md"))
    else:
        files = spark.read.text(uri, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
        files = files.where(~F.element_at(F.split("file", "/"), -1).isin("index.md", "log.md"))
        # Each task starts a Python worker; a task for thirty files would take longer for that than for them.
        files = files.coalesce(max(8 * spark.sparkContext.defaultParallelism, files.rdd.getNumPartitions() // PARTS_TOGETHER))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, str]]]:
        store, base = _store(uri)
        held, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with store.open_input_stream(f"{base}/{path}") as f:
                    data = f.read()
                held.append((path, data.decode("utf-8", "replace")))
                size += len(data)
                if size >= BYTES_TOGETHER:
                    yield held
                    held, size = [], 0
        yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("file", pa.string()), ("error", pa.string()), ("id", pa.int64()), ("title", pa.string()), ("type", pa.string()), ("description", pa.string()), ("category", pa.string()), ("status", pa.string()), ("tags", pa.list_(pa.string())), ("body", pa.string())])
        for texts in opened(batches) if named else (zip(b.column("file").to_pylist(), b.column("text").to_pylist(), strict=True) for b in batches):
            yield pa.RecordBatch.from_pylist([{"file": os.path.basename(f)} | parse(t) for f, t in texts], kinds)

    return files.mapInArrow(run, ROWS)


def bundle_manifest(corpus: DataFrame, page_titles: int = PAGE_TITLES) -> DataFrame:
    """(dir, page, n, listing, exported_at): each folder's concepts in order of their titles, in pages from 0, and the last change of all.

    ``listing`` is the digest of a page's lines.  A folder is as many pages as it
    needs, so no row grows with the corpus.
    """
    words = F.filter(F.split(F.lower("type"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    alias = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])
    known = F.filter(F.transform(words, lambda w: F.element_at(alias, w)), lambda x: x.isNotNull())
    where = F.concat(F.when(F.col("status") == "deprecated", "deprecated/").otherwise(""), F.coalesce(F.get(known, F.lit(0)), F.get(words, F.lit(0)), F.lit("notes")))
    rows = corpus.select(where.alias("dir"), "title", "id", F.col("updated_at").cast("date").alias("on"))
    last = rows.agg(F.max("on").alias("exported_at"))
    placed = numbered(rows.select("dir", "title", "id"), ["dir"], ["title", "id"], "listing").withColumn("page", F.floor(F.col("place") / page_titles).cast("int"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "title"))), lambda x: F.concat(F.lit("- "), x["title"]))
    listed = placed.groupBy("dir", "page").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("listing"))
    return listed.crossJoin(F.broadcast(last))


def bundle_classify(docs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(seq, verdict) of incoming docs (seq, title, content_hash) against a library that grows with them.

    In order, a doc is created unless the library, or a doc created before it, has
    its hash (duplicate) or its title (conflict).  Each round creates every
    undecided doc that comes first among those of its hash and of its title, and
    drops the ones that it hits; rounds end when none is left.
    """
    spark = docs.sparkSession
    rows = materialise(docs.select("seq", F.col("content_hash").alias("h"), F.lower("title").alias("t")), "bundle")
    have_h, have_t = corpus.select(F.col("content_hash").alias("h")).distinct(), corpus.select(F.lower("title").alias("t")).distinct()
    open_rows = materialise(rows.join(have_h, "h", "left_anti").join(have_t, "t", "left_anti"), "bundle")
    rounds = [spark.createDataFrame([], rows.schema)]
    while not open_rows.isEmpty():
        first_h = open_rows.groupBy("h").agg(F.min("seq").alias("fh"))
        first_t = open_rows.groupBy("t").agg(F.min("seq").alias("ft"))
        ranked = open_rows.join(first_h, "h").join(first_t, "t")
        fresh = materialise(ranked.where("seq = fh AND seq = ft").select("seq", "h", "t"), "created")
        # Each round's rows stay as they were written; they meet once, at the end.
        rounds.append(fresh)
        rest = open_rows.join(fresh.select("seq"), "seq", "left_anti")
        open_rows = materialise(rest.join(fresh.select("h"), "h", "left_anti").join(fresh.select("t"), "t", "left_anti"), "bundle")
    created = rounds[0]
    for fresh in rounds[1:]:
        created = created.unionByName(fresh)
    made = created.groupBy("h").agg(F.min("seq").alias("made"))
    state = rows.join(created.select("seq", F.lit(True).alias("new")), "seq", "left").join(have_h.withColumn("held", F.lit(True)), "h", "left").join(made, "h", "left")
    verdict = F.when(F.col("new"), "create").when(F.col("held") | (F.col("made") < F.col("seq")), "duplicate").otherwise("conflict")
    return state.select("seq", verdict.alias("verdict"))


# Leading bytes of the accepted kinds (hexadecimal patterns), and kinds that may carry scripts.
MAGIC = [("image/png", "^89504E470D0A1A0A"), ("image/jpeg", "^FFD8FF"), ("image/gif", "^47494638(37|39)61"), ("image/webp", "^52494646.{8}57454250"), ("image/avif", "^.{8}6674797061766966"), ("application/pdf", "^255044462D")]
SCRIPTED = ["text/html", "image/svg+xml", "application/xhtml+xml", "text/xml", "application/xml"]


def attachment_scan(files: DataFrame) -> DataFrame:
    """(storage_key, declared, content) as the kind to store: sniffed, or declared if it is harmless; rejected where they disagree."""
    head = F.hex(F.substring(F.col("content"), 1, 12))
    sniffed = F.coalesce(*[F.when(F.rlike(head, F.lit(p)), F.lit(m)) for m, p in MAGIC])
    claims = F.col("declared").isin([m for m, _ in MAGIC])
    kind = F.when(claims & ~F.col("declared").eqNullSafe(F.col("sniffed")), F.lit(None)).when(F.col("declared").isin(SCRIPTED), "application/octet-stream").otherwise(F.coalesce("sniffed", "declared", F.lit("application/octet-stream")))
    rows = files.withColumn("sniffed", sniffed)
    return rows.select("storage_key", kind.alias("stored_as"), F.when(kind.isNull(), "rejected").otherwise("stored").alias("verdict"))


def attachment_audit(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """(storage_key, finding): metadata without a file, or a file without metadata; uploads in progress do not count."""
    a = metadata.select("storage_key", F.lit(True).alias("meta"))
    b = files.where(~F.endswith("storage_key", F.lit(".uploading"))).select("storage_key", F.lit(True).alias("file"))
    met = a.join(b, "storage_key", "full_outer").where("meta IS NULL OR file IS NULL")
    return met.select("storage_key", F.when(F.col("meta").isNull(), "orphaned").otherwise("missing").alias("finding"))


def attachment_usage(attachments: DataFrame, concepts: DataFrame, cap: int) -> DataFrame:
    """(storage_key, owner_id, used, over): bytes of an owner up to each upload, and whether it would have been refused."""
    rows = attachments.join(concepts.select(F.col("id").alias("concept_id"), "owner_id"), "concept_id")
    used = F.sum("size_bytes").over(Window.partitionBy("owner_id").orderBy("page_id").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", used).select("storage_key", "owner_id", "used", (F.col("used") > cap).alias("over"))
