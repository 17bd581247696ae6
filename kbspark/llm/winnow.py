"""Benchmark decontamination by winnowing.

Every run of ``WINDOW`` words of a benchmark item is a window; an item of fewer
words is one window by itself.  Training documents and items are fingerprinted
alike: of each ``WINDOW - K + 1`` consecutive k-gram hashes the least is kept, so
two texts that share a window always share the fingerprint chosen in it.
Documents whose fingerprints join with the benchmark's are extended around each
shared fingerprint to all windows that hold it, and those windows are compared.

The benchmark is cut into blocks of bounded size; the index of each is built once and
written to the shared folder.  A task keeps the blocks that fit ``HELD_BYTES`` and
reads the others once for each batch of documents, so documents are never shuffled
and a benchmark of any size takes bounded memory.

Defined results: null and empty texts have no words and no hits; repeated
documents are judged each by itself; items repeated under one id count once; a
null item id is listed as an empty string; an empty benchmark hits nothing.
"""

from __future__ import annotations

import os
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage, textscan

WINDOW = 13
K = 7
#: Bytes of benchmark text in a block, and of index files that a worker keeps.
BLOCK_BYTES = 8 << 20
HELD_BYTES = 192 << 20


def fingerprints(grams: np.ndarray, width: int) -> np.ndarray:
    """Mask of the hashes that are least within some ``width`` consecutive ones."""
    if len(grams) <= width:
        return grams == grams.min() if len(grams) else np.zeros(0, bool)
    low = np.lib.stride_tricks.sliding_window_view(grams, width)
    least = low[:, 0].copy()
    for i in range(1, width):
        np.minimum(least, low[:, i], out=least)
    # A hash is chosen if it equals the least of one of the windows over it, that is, the largest of these.
    best = np.zeros(len(grams), np.uint64)
    for i in range(width):
        np.maximum(best[i : i + len(least)], least, out=best[i : i + len(least)])
    return best == grams


class Index:
    """Windows and fingerprints of one block of benchmark items, by window length."""

    def __init__(self, ids: list[str], texts: pa.Array, window: int = WINDOW, k: int = K):
        self.ids, self.window, self.k = ids, window, k
        grams: dict[int, list] = {}
        for a, _, hashes, counts in textscan.word_hashes(texts, textscan.ALNUM):
            at = np.concatenate([[0], np.cumsum(counts)])
            for i in range(len(counts)):
                h = hashes[at[i] : at[i + 1]]
                if len(h):
                    m = min(window, len(h))
                    rolled = textscan.rolling(h, min(k, m) if m == window else m)
                    marks = rolled[fingerprints(rolled, window - k + 1)] if m == window else rolled
                    grams.setdefault(m, []).append((a + i, textscan.rolling(h, m), marks))
        self.by_length = {}
        for m, found in grams.items():
            keys = np.concatenate([w for _, w, _ in found])
            owners = np.concatenate([np.full(len(w), i) for i, w, _ in found])
            order = np.lexsort((owners, keys))
            keys, owners = keys[order], owners[order]
            fresh = np.ones(len(keys), bool)
            fresh[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
            keys, owners = keys[fresh], owners[fresh]
            unique, first = np.unique(keys, return_index=True)
            marks = np.unique(np.concatenate([x for _, _, x in found]))
            coarse = np.zeros(1 << 18, bool)
            coarse[marks >> np.uint64(46)] = True
            self.by_length[m] = (unique, np.append(first, len(keys)), owners, marks, coarse)

    def hits(self, hashes: np.ndarray, counts: np.ndarray):
        """Of a slice of documents: mask of hit words, and (document, item) pairs without repeats."""
        at = np.concatenate([[0], np.cumsum(counts)])
        doc = np.repeat(np.arange(len(counts)), counts)
        edge = np.zeros(len(hashes) + 1, np.int64)
        pairs = []
        for m, (windows, first, owners, marks, coarse) in self.by_length.items():
            k = self.k if m == self.window else m
            grams = textscan.rolling(hashes, k)
            if not len(grams):
                continue
            whole = doc[: len(grams)] == doc[k - 1 :]
            if m == self.window:
                chosen = fingerprints(np.where(whole, grams, np.uint64(2**64 - 1)), m - k + 1) & whole
            else:
                chosen = whole
            near = np.flatnonzero(chosen & coarse[grams >> np.uint64(46)])
            at_mark = np.searchsorted(marks, grams[near])
            near = near[marks[np.minimum(at_mark, len(marks) - 1)] == grams[near]]
            if not len(near):
                continue
            # Extend: all windows of m words that hold the shared fingerprint and lie within the document.
            starts = np.unique((near[:, None] - np.arange(m - k + 1)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts + m <= len(hashes))]
            starts = starts[(doc[starts] == doc[starts + m - 1])]
            if not len(starts):
                continue
            held = np.zeros(len(starts), np.uint64)
            with np.errstate(over="ignore"):
                for i in range(m):
                    held *= np.uint64(0x5851F42D4C957F2D)
                    held += hashes[starts + i]
            held = textscan.mix(held)
            to = np.searchsorted(windows, held)
            same = windows[np.minimum(to, len(windows) - 1)] == held
            starts, to = starts[same], to[same]
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + m, -1)
            # A passage met again in the same document adds no item.
            met = np.unique(doc[starts].astype(np.int64) * len(windows) + to)
            d, to = met // len(windows), met % len(windows)
            n = first[to + 1] - first[to]
            each = np.repeat(first[to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            pairs.append(np.unique(np.stack([np.repeat(d, n), owners[each]]), axis=1))
        hit = np.cumsum(edge[:-1]) > 0
        both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        return hit, at, both


_held: dict[str, tuple[int, Index]] = {}


def _load(path: str) -> Index:
    """One block's index; a worker keeps those that fit, and beside them the last one read."""
    if path not in _held:
        files, inner = storage.filesystem(path)
        with files.open_input_file(inner) as src:
            raw = src.read()
        while _held and sum(n for n, _ in _held.values()) + len(raw) > HELD_BYTES:
            # The newest goes: blocks are met in one order, so the first ones are met again soonest.
            _held.popitem()
        _held[path] = len(raw), pickle.loads(raw)
    return _held[path][1]


def _indexed(path: str, folder: str, window: int, k: int) -> str:
    """Build one block's index and write it to the shared folder."""
    files, inner = storage.filesystem(path)
    table = pq.read_table(inner, filesystem=files, partitioning=None)
    index = Index([x or "" for x in table.column("item_id").to_pylist()], table.column("text").combine_chunks(), window, k)
    out = f"{folder}/{uuid.uuid4().hex}.index"
    files, inner = storage.filesystem(out)
    files.create_dir(os.path.dirname(inner), recursive=True)
    with files.open_output_stream(inner) as sink:
        sink.write(pickle.dumps(index, protocol=5))
    return out


def write_blocks(benchmark: DataFrame, spark: SparkSession, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES, window: int = WINDOW, k: int = K) -> list[str]:
    """The benchmark's indices, each of about ``block_bytes`` of text, in files of the shared folder."""
    kept = benchmark.select(F.col(item_id).cast("string").alias("item_id"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    size = kept.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if not size:
        return []
    root = storage.new_dir(spark, "benchmark")
    kept.repartition(int(size // block_bytes) + 1).write.parquet(f"{root}/blocks")
    texts = storage.data_files(spark, f"{root}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_indexed(x, f"{root}/index", window, k) for x in batch.column("path").to_pylist()], pa.string())], names=["path"])

    # One row for each block.
    paths = spark.createDataFrame([(x,) for x in texts], "path string").repartition(len(texts))
    return sorted(r["path"] for r in paths.mapInArrow(run, "path string").collect())


def judge(batch: pa.RecordBatch, text: str, blocks: list[str]):
    """For each row of a batch: words, hit words, sorted item ids, hit spans as word ranges."""
    n = batch.num_rows
    words, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    items: list[list[str]] = [[] for _ in range(n)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    # A batch is bounded by bytes, so its words are held while each block is met once.
    parts = list(textscan.word_hashes(batch.column(text), textscan.ALNUM))
    masks = [np.zeros(len(hashes), bool) for _, _, hashes, _ in parts]
    for path in blocks:
        index = _load(path)
        for (a, _, hashes, counts), hit in zip(parts, masks, strict=True):
            found, _, pairs = index.hits(hashes, counts)
            hit |= found
            for d, i in pairs.T.tolist():
                items[a + d].append(index.ids[i])
    for (a, b, _, counts), hit in zip(parts, masks, strict=True):
        words[a:b] = counts
        if hit.any():
            at = np.concatenate([[0], np.cumsum(counts)])
            sums = np.concatenate([[0], np.cumsum(hit)])
            hits[a:b] = sums[at[1:]] - sums[at[:-1]]
            for d in np.flatnonzero(hits[a:b]):
                own = np.diff(np.concatenate([[0], hit[at[d] : at[d + 1]].view(np.int8), [0]]))
                spans[a + d] = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(own > 0).tolist(), np.flatnonzero(own < 0).tolist(), strict=True)]
    return words, hits, [sorted(set(x)) for x in items], spans


REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("contaminated", T.BooleanType()),
    ]
)


def is_contaminated(words: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """At least one word, and at least a twentieth of all words, is hit."""
    return (hits > 0) & (20 * hits >= words)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its id and ``REPORT``.  Only the id and the text are read."""
    blocks = write_blocks(benchmark, docs.sparkSession, block_bytes=block_bytes, window=window, k=k)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *REPORT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            words, hits, items, spans = judge(batch, "text", blocks)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words), pa.array(hits), pa.array(items, pa.list_(pa.string())), pa.array(spans, span), pa.array(is_contaminated(words, hits))], names=schema.names
            )

    return rows.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    blocks = write_blocks(benchmark, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hits, _, _ = judge(batch, text, blocks)
            yield batch.filter(pa.array(~is_contaminated(words, hits)))

    return docs.mapInArrow(run, docs.schema)
