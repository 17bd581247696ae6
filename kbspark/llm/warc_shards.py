"""Deterministic sharded WARC archives.

Pages are range-sorted by id.  Each task writes its range as files of one gzip
member per record and begins a new file once the compressed size passes a limit.
Headers, record ids and digests are made anew from the page alone, and the date is
a parameter, so the same table gives the same bytes.  Of equal payloads the page of
largest id is stored as a response and the others as revisits of it.

A task writes under temporary names, renames each finished file to its final name,
and reports it; the manifest that Spark commits lists the files that count, with
their sizes and SHA-256 digests, so failed and repeated attempts do no harm.

Defined results: null html is an empty payload; a null id is less than any other;
a repeated row with the largest id of its payload is a response each time; payloads
below ``min_revisit_bytes`` are always responses; an empty table has no files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 64 << 20
LEVEL = 4
#: Bytes of payload for each task's range.
RANGE_BYTES = 64 << 20
MANIFEST = "shard int, file int, path string, n_records long, n_bytes long, sha256 string"
_SPACE = uuid.UUID("8c6bf5b2-6f0f-5b60-9d4e-2f1f6a8d7c31")


def digest_of(payload: bytes) -> str:
    """Upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {digest}')}>"


def _clean(url: str | None) -> str:
    """A header value without line ends."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool, date: str = DATE) -> bytes:
    """One WARC record, not yet compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-Id: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """One gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _payload(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest_of(_payload(x)) for x in batch.column("html")], pa.string())], names=[*batch.schema.names, "digest"])


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES, date: str = DATE) -> DataFrame:
    """Write all pages; returns the committed manifest of files."""
    spark = pages.sparkSession
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("html"))
    keyed = rows.mapInArrow(_digested, "page_id long, url string, html string, digest string")
    # The pages' keys alone find each payload's response; their answers then travel beside the pages.
    keys = storage.materialise(keyed.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "digest"), spark, "payloads")
    first = keys.groupBy("digest").agg(F.max("page_id").alias("first"))
    known = keys.distinct().join(first, "digest").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    root = storage.new_dir(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, attempt, number, done = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, []
        files, base = storage.filesystem(root)
        out = None

        def finish() -> None:
            nonlocal out, number
            out.close()
            name = f"{base}/part-{attempt}/pages-{shard:06d}-{number:04d}.warc.gz"
            files.move(f"{name}.tmp", name)
            done.append((shard, number, f"{root}/part-{attempt}/pages-{shard:06d}-{number:04d}.warc.gz", n, written, sha.hexdigest()))
            out, number = None, number + 1

        answer: tuple = (None, None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                own, digest = batch.column("page_id")[i].as_py(), batch.column("digest")[i].as_py()
                if not batch.column("html")[i].is_valid:
                    answer = (own, digest, batch.column("first")[i].as_py())
                    continue
                if out is None:
                    files.create_dir(f"{base}/part-{attempt}", recursive=True)
                    out, n, written, sha = files.open_output_stream(f"{base}/part-{attempt}/pages-{shard:06d}-{number:04d}.warc.gz.tmp"), 0, 0, hashlib.sha256()
                refers = answer[2] if answer[:2] == (own, digest) else own
                data = member(record(own, batch.column("url")[i].as_py(), _payload(batch.column("html")[i]), digest, refers, refers != own, date))
                out.write(data)
                sha.update(data)
                n, written = n + 1, written + len(data)
                if written >= file_bytes:
                    finish()
        if out is not None:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["shard", "file", "path", "n_records", "n_bytes", "sha256"]).cast(pa.schema([("shard", pa.int32()), ("file", pa.int32()), ("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    # An answer has no html and sorts before the pages of its id and digest.
    both = keyed.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("first")).unionByName(known)
    ranged = both.repartitionByRange(int(size // range_bytes) + 1, "page_id", "digest").sortWithinPartitions("page_id", "digest", F.col("html").isNotNull(), "url")
    return storage.materialise(ranged.mapInArrow(write, MANIFEST), spark, "warc-manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The records of one archive, one gzip member after another."""
    held = b""
    unpacker, out = zlib.decompressobj(31), []
    while True:
        data = held or stream.read(size)
        if not data:
            break
        out.append(unpacker.decompress(data))
        held = b""
        if unpacker.eof:
            held = unpacker.unused_data
            yield b"".join(out)
            unpacker, out = zlib.decompressobj(31), []


def parse(data: bytes) -> dict:
    """Header fields, lower-cased, and the payload of a record; checks its block digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    if f"sha1:{digest_of(block)}" != fields["warc-block-digest"]:
        raise ValueError(f"record {fields['warc-record-id']} is damaged")
    http, _, payload = block.partition(b"\r\n\r\n")
    for line in http.decode().split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[f"http-{k.lower()}"] = v.strip()
    return fields | {"payload": payload}


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(manifest: DataFrame, payload: bool = True) -> DataFrame:
    """All records of a manifest's files; ``payload`` is null for revisits, or for all if not asked for."""
    n = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, inner = storage.filesystem(path)
                with files.open_input_stream(inner, compression=None) as stream:
                    rows, held = [], 0
                    for data in members(stream):
                        x = parse(data)
                        revisit = x["warc-type"] == "revisit"
                        body = None if revisit or not payload else x["payload"]
                        size = int(x["http-content-length"])
                        digest = x["warc-payload-digest"].removeprefix("sha1:")
                        if not revisit and (size != len(x["payload"]) or digest != digest_of(x["payload"])):
                            raise ValueError(f"the payload of {x['warc-record-id']} is damaged")
                        own, to = x.get("x-page-id"), x.get("x-refers-to-page-id")
                        rows.append((own and int(own), x["warc-target-uri"], size, digest, x["warc-type"], to and int(to), body))
                        held += len(body or b"") + 200
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows)

    return manifest.select("path").repartition(n).mapInArrow(run, RECORDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])
