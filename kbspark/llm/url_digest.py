"""URL rules in sorted digest arrays.

A rule is a host and a path prefix; its key is the 64-bit xxhash of both.  Rules
are range-sorted by key and written as one file per range: the sorted keys, then
offsets, verdicts and the full rule strings.  A task maps the file into memory (from a
store that cannot be mapped it reads it) and probes the key array, for a whole batch at once, with every host suffix and every path
prefix of a length that some rule has; a key that is found counts only if the
stored strings are equal.

Defined results: a null url, or one without ``://``, has an empty host and path and
fits no rule; a rule with an empty host fits nothing; of several fitting rules the
longest string wins, then the longer host; of repeated equal rules "allow" wins.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage

ALLOW, BLOCK = "allow", "block"
DEFAULT = ALLOW
MAGIC = b"KBURL\x00\x00\x01"
#: Rules of one file.
SHARD_RULES = 1 << 20
#: Bytes of files that a worker keeps where they cannot be mapped.
HELD_BYTES = 128 << 20
FILES = "shard int, path string, first decimal(20,0), n_rules long, lengths array<int>"


#: A-Z only.
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def key_of(host: str, path: str) -> int:
    return xxhash.xxh64_intdigest(f"{host}\n{path}".encode())


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): see the rules of the module."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host = rest[:end].translate(_FOLD)
    tail = rest[end:]
    return host, tail[: min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))]


def write_rules(rules: DataFrame, shard_rules: int = SHARD_RULES) -> DataFrame:
    """Write (host, path, verdict) rules; returns the manifest of files."""
    spark = rules.sparkSession
    root = storage.new_dir(spark, "url-rules")
    # Equal rules meet before they are sorted; the least verdict is "allow".
    rules = rules.where((F.col("host") != "") & F.col("verdict").isin(ALLOW, BLOCK)).select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        for batch in batches:
            keys = [Decimal(key_of(h, p)) for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.decimal128(20, 0)), *batch.columns], names=["key", "host", "path", "verdict"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a whole file only numbers and encoded texts are held, never rows as objects.
        keys, sizes, verdicts, texts, lengths, first = [], [], [], [], set(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = batch.column("key")[0].as_py() if first is None else first
            paths = batch.column("path").to_pylist()
            encoded = [f"{h}\n{p}".encode() for h, p in zip(batch.column("host").to_pylist(), paths, strict=True)]
            keys.append(np.array([int(x) for x in batch.column("key").to_pylist()], "<u8"))
            sizes.append(np.array([len(x) for x in encoded], "<i8"))
            verdicts.append(np.array([v == BLOCK for v in batch.column("verdict").to_pylist()], np.uint8))
            texts.append(b"".join(encoded))
            lengths.update(map(len, paths))
        if first is None:
            return
        n = sum(map(len, keys))
        at = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
        path = f"{root}/rules-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.bin"
        files, inner = storage.filesystem(path)
        files.create_dir(os.path.dirname(inner), recursive=True)
        with files.open_output_stream(inner) as out:
            for part in (MAGIC, np.array([n], "<i8").tobytes(), *(x.tobytes() for x in keys), at.tobytes(), *(x.tobytes() for x in verdicts), *texts):
                out.write(part)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([TaskContext.get().partitionId()], pa.int32()), "path": [path], "first": pa.array([first], pa.decimal128(20, 0)), "n_rules": [n], "lengths": pa.array([sorted(lengths)], pa.list_(pa.int32()))})

    n = rules.count()
    sorted_rules = rules.mapInArrow(keyed, "key decimal(20,0), host string, path string, verdict string").repartitionByRange(int(n // shard_rules) + 1, "key").sortWithinPartitions("key")
    return storage.materialise(sorted_rules.mapInArrow(write, FILES), spark, "url-manifest")


class Rules:
    """One file of rules, mapped into memory."""

    def __init__(self, uri: str):
        files, inner = storage.filesystem(uri)
        if uri.startswith("file:"):
            data, self.held = np.memmap(inner, np.uint8, "r"), 0
        else:
            with files.open_input_file(inner) as src:
                data = np.frombuffer(src.read(), np.uint8)
            self.held = len(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError(f"{uri} holds no rules")
        self.n = n = int(data[8:16].view("<i8")[0])
        self.keys, self.at = data[16 : 16 + 8 * n].view("<u8"), data[16 + 8 * n : 24 + 16 * n].view("<i8")
        self.verdicts, self.texts = data[24 + 16 * n : 24 + 17 * n], data[24 + 17 * n :]

    def probe(self, keys: np.ndarray) -> np.ndarray:
        """Where each key stands, or -1."""
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[np.minimum(at, self.n - 1)] == keys, at, -1)

    def run(self, key: int, at: int) -> Iterator[int]:
        """All places of one key."""
        while at < self.n and self.keys[at] == key:
            yield at
            at += 1

    def text(self, at: int) -> bytes:
        return bytes(self.texts[self.at[at] : self.at[at + 1]])


_mapped: dict[str, Rules] = {}


def _rules(path: str) -> Rules:
    if path not in _mapped:
        if len(_mapped) > 64 or sum(r.held for r in _mapped.values()) > HELD_BYTES:
            _mapped.clear()
        _mapped[path] = Rules(path)
    return _mapped[path]


def judge(urls: list[str | None], files: list[str], firsts: np.ndarray, lengths: list[int]) -> tuple[list, list, list, list]:
    """(hosts, paths, rules, verdicts) of a batch of urls."""
    hosts, paths = [], []
    owner: list[int] = []
    probes: list[bytes] = []
    for i, url in enumerate(urls):
        host, path = split_url(url)
        hosts.append(host)
        paths.append(path)
        labels = host.split(".") if host else []
        ends = [path[:n] for n in lengths if n <= len(path)]
        for j in range(len(labels)):
            suffix = ".".join(labels[j:])
            for end in ends:
                owner.append(i)
                probes.append(f"{suffix}\n{end}".encode())
    best: list[tuple | None] = [None] * len(urls)
    if files and probes:
        keys = np.array([xxhash.xxh64_intdigest(p) for p in probes], np.uint64)
        shard = np.maximum(np.searchsorted(firsts, keys, "right") - 1, 0)
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            rules = _rules(files[s])
            places = rules.probe(keys[mine])
            for k, at in zip(mine[places >= 0].tolist(), places[places >= 0].tolist(), strict=True):
                for place in rules.run(int(keys[k]), at):
                    if rules.text(place) == probes[k]:
                        host, path = probes[k].decode().split("\n", 1)
                        found = (len(host) + len(path), len(host), host + path, BLOCK if rules.verdicts[place] else ALLOW)
                        if best[owner[k]] is None or found > best[owner[k]]:
                            best[owner[k]] = found
    return hosts, paths, [b and b[2] for b in best], [b[3] if b else DEFAULT for b in best]


def filtered(pages: DataFrame, manifest: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; only its id and url are read."""
    # One row for each file of SHARD_RULES rules.
    held = sorted(manifest.collect(), key=lambda r: r["first"])
    files = [r["path"] for r in held]
    firsts = np.array([int(r["first"]) for r in held], np.uint64)
    lengths = sorted({n for r in held for n in r["lengths"]})
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch.column("url").to_pylist(), files, firsts, lengths)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(x, pa.string()) for x in found)], names=["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, schema)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of (host, path, verdict) as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
