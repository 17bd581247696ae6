"""Near-duplicate classes by DartMinHash over weighted word shingles.

A document is a weighted set: its shingles of five words, each with weight
``1 + ln(occurrences)``.  Every shingle owns a strip of the plane of weight and
rank; a hash of the shingle throws darts into the strip's unit cells, one for each
unit of area on average.  A document takes the darts below its shingles' weights
and below a rank at which it expects ``k (ln k + 6)`` of them; of each of ``k``
coordinates it keeps the dart of least rank.  Two documents agree in a coordinate
with the probability of their weighted Jaccard similarity.

Signatures are banded.  Exact copies are one node throughout.  Within a bucket
every node is compared with the least one, and the links found are put together to
classes.  In a bucket that still holds several classes, all pairs of nodes of
different classes are compared (``across``): in blocks of bounded size, as products
of matrices inside tasks, which give no more rows than there are classes to join.
So classes are the connected components of the links of all pairs that share a
bucket, whatever the order or layout of the rows.  All is decided by the weighted
Jaccard similarity of the whole sets, of which a shingle is a 32-bit number (two
shingles of a pair of texts that share one by chance count as the same).

Defined results: null and empty texts are classes of their own; texts without
words, or equal texts under different ids, are one class by exact equality; a text
of one to four words has one shingle, all its words; repeated rows get the same
class; a class is named by its least document id, and told from others by its
least digest.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from . import graph, storage, textscan
from .ranking import ranked

SHINGLE = 5
THRESHOLD = 0.8
#: A pair of similarity s shares a bucket with probability 1 - (1 - s**ROWS)**BANDS: 0.9996 at 0.8.
BANDS, ROWS = 20, 5
#: Rows in a slice: a row's number takes 11 bits of a 64-bit sort key, a shingle's hash 53.
_ROW_BITS = 11
_HASH_BITS = 64 - _ROW_BITS
#: Nodes, and bytes of sets, of a block of a bucket; a pair of blocks is compared in one task.
BLOCK_NODES, BLOCK_BYTES = 2048, 1 << 24
#: Nodes compared by one product, and the numbers of a matrix for it.
_SIDE, _CELLS = 512, 1 << 22
#: Unit cells whose darts are thrown at a time, whatever the number and length of texts.
CELLS = 1 << 17
#: Bytes of text in a slice.
SLICE_BYTES = 1 << 19
#: Cumulative probabilities of a Poisson distribution of mean 1.
_POISSON_1 = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(20)])


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    for a, b in textscan.slices(at, SLICE_BYTES):
        for c in range(a, b, 1 << _ROW_BITS):
            yield c, min(b, c + (1 << _ROW_BITS))


def shingles(raw: np.ndarray, at: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a slice of texts: (row, shingle, occurrences), ascending by row and shingle."""
    data = textscan.LOWER[raw[at[0] : at[-1]]]
    starts, ends, counts = textscan.words(data, at, textscan.ALNUM)
    hashes = textscan.hash_spans(data, starts, ends)
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    grams = textscan.rolling(hashes, size)
    owner = doc[: len(grams)]
    whole = owner == doc[size - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], owner[whole]
    first = np.cumsum(counts) - counts
    short = [(i, textscan.rolling(hashes[first[i] : first[i] + counts[i]], int(counts[i]))) for i in np.flatnonzero((counts > 0) & (counts < size))]
    if short:
        grams = np.concatenate([grams, *(g for _, g in short)])
        owner = np.concatenate([owner, np.array([i for i, _ in short], np.uint64)])
    keys = np.sort((owner << np.uint64(_HASH_BITS)) | (grams >> np.uint64(_ROW_BITS)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    begin = np.flatnonzero(fresh)
    unique = keys[begin]
    return (unique >> np.uint64(_HASH_BITS)).astype(np.int64), unique & np.uint64((1 << _HASH_BITS) - 1), np.diff(np.append(begin, len(keys)))


def weights_of(occurrences: np.ndarray) -> np.ndarray:
    """Sublinear term weights."""
    return 1.0 + np.log(occurrences)


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int, seed: int = 1) -> np.ndarray:
    """DartMinHash of ``n`` weighted sets: the 64-bit number of the winning dart in each of ``k`` coordinates.

    Rows without elements get zeros.
    """
    out = np.zeros((n, k), np.uint64)
    total = np.bincount(row, weight, n)
    pending = total > 0
    darts = k * (math.log(k) + 6)
    while pending.any():
        top = np.zeros(n)
        top[pending] = darts / total[pending]
        held = np.flatnonzero(pending[row])
        least, flat = np.full(n * k, np.inf), np.zeros(n * k, np.uint64)
        # Unit cells of each element: levels of weight times levels of rank.
        reach = np.cumsum(np.ceil(weight[held]) * np.ceil(top[row[held]]))
        begin = 0
        while begin < len(held):
            end = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + CELLS, "right")))
            part = held[begin:end]
            _throw(row[part], element[part], weight[part], top, k, seed, least, flat)
            begin = end
        filled = np.isfinite(least).reshape(n, k).all(axis=1)
        done = pending & filled
        out[done] = flat.reshape(n, k)[done]
        pending &= ~filled
        darts *= 2
    return out


def _throw(r: np.ndarray, e: np.ndarray, w: np.ndarray, top: np.ndarray, k: int, seed: int, least: np.ndarray, flat: np.ndarray) -> None:
    """Throw the darts of some elements: lower ``least`` ranks, and put the names of their darts into ``flat``."""
    high, deep = np.ceil(w).astype(np.int64), np.ceil(top[r]).astype(np.int64)
    cells = high * deep
    own = np.repeat(np.arange(len(r)), cells)
    cell = np.arange(len(own)) - np.repeat(np.cumsum(cells) - cells, cells)
    level, depth = cell // deep[own], cell % deep[own]
    with np.errstate(over="ignore"):
        seeds = textscan.seeded(e[own] + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95) + depth.astype(np.uint64) * np.uint64(0xAF251AF3B0F025B5), seed)
        count = np.searchsorted(_POISSON_1, textscan.unit(seeds))
        dart = np.repeat(np.arange(len(own)), count)
        each = np.arange(len(dart)) - np.repeat(np.cumsum(count) - count, count)
        name = textscan.mix(seeds[dart] + (each.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    rank = depth[dart] + textscan.unit(name)
    own = own[dart]
    keep = rank <= top[r[own]]
    own, rank, name, level = own[keep], rank[keep], name[keep], level[dart][keep]
    other = textscan.mix(name ^ np.uint64(0x94D049BB133111EB))
    below = level + (other & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 <= w[own]
    own, rank, name, other = own[below], rank[below], name[below], other[below]
    at = r[own] * k + ((other >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(least, at, rank)
    won = rank == least[at]
    flat[at[won]] = name[won]


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit bucket number for each band."""
    n = len(signature)
    out = np.empty((n, bands), np.uint64)
    for b in range(bands):
        held = np.full(n, b + 1, np.uint64)
        for i in range(b * rows, (b + 1) * rows):
            with np.errstate(over="ignore"):
                held = textscan.mix(held * np.uint64(0x5851F42D4C957F2D) + signature[:, i])
        out[:, b] = held
    return out.view(np.int64)


def _digests(column: pa.Array) -> list[bytes | None]:
    return [hashlib.md5(x.as_buffer()).digest() if x.is_valid and len(x.as_buffer()) else None for x in column]


def sketch(docs: DataFrame, doc_id: str, text: str, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, node, bands): node is a digest of the whole text, null for empty texts; no bands without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            raw, at = textscan.string_buffers(column)
            for a, b in slices(at):
                row, element, times = shingles(raw, at[a : b + 1], shingle)
                some = np.bincount(row, minlength=b - a) > 0
                found = bands_of(signatures(row, element, weights_of(times), b - a, bands * rows), bands, rows)[some]
                ends = np.concatenate([[0], np.cumsum(some)]) * bands
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(_digests(column.slice(a, b - a)), pa.binary()), lists], names=["doc_id", "node", "bands"])

    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, node binary, bands array<long>")


def _packed(raw: np.ndarray, at: np.ndarray, shingle: int) -> list[bytes]:
    """Each text's weighted set: its size, its shingles as ascending 32-bit numbers, and occurrences above one."""
    row, element, times = shingles(raw, at, shingle)
    first = np.searchsorted(row, np.arange(len(at)))
    small = (element >> np.uint64(_HASH_BITS - 32)).astype("<u4")
    out = []
    for i in range(len(at) - 1):
        t = times[first[i] : first[i + 1]]
        more = np.flatnonzero(t > 1)
        out.append(b"".join((np.uint32(len(t)).tobytes(), small[first[i] : first[i + 1]].tobytes(), more.astype("<u4").tobytes(), t[more].astype("<u4").tobytes())))
    return out


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    rest = np.frombuffer(data, "<u4", offset=4)
    times = np.ones(n)
    more = rest[n:].reshape(2, -1)
    times[more[0]] = more[1]
    return rest[:n], weights_of(times)


def similarity(x: bytes, y: bytes) -> float:
    """Weighted Jaccard similarity of two packed sets."""
    a, u = _unpacked(x)
    b, v = _unpacked(y)
    if not len(a) or not len(b):
        return 0.0
    both, i, j = np.intersect1d(a, b, assume_unique=False, return_indices=True)
    shared = float(np.minimum(u[i], v[j]).sum()) if len(both) else 0.0
    return shared / (float(u.sum()) + float(v.sum()) - shared)


def sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(node, held): the packed weighted sets of the wanted nodes."""
    wanted = nodes.select("node", "doc_id").join(wanted, "node", "left_semi")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    texts = texts.where(F.length("text") > 0).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))
    # The digest decides; of the copies under several ids, those of the node's own id are read.
    w = wanted.select(F.col("node").alias("__node"), F.col("doc_id").alias("__id"))
    texts = texts.join(w, (F.col("node") == F.col("__node")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("node", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            raw, at = textscan.string_buffers(column)
            for a, b in slices(at):
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(a, b - a), pa.array(_packed(raw, at[a : b + 1], shingle), pa.binary())], names=["node", "held"])

    packed = texts.mapInArrow(pack, "node binary, held binary")
    return storage.materialise(packed.dropDuplicates(["node"]), docs.sparkSession, "sets")


def verified(pairs: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose exact similarity reaches the threshold."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("held_a").to_pylist(), batch.column("held_b").to_pylist()
            keep = [similarity(p, q) >= threshold for p, q in zip(x, y, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(packed.select(F.col("node").alias("a"), F.col("held").alias("held_a")), "a").join(packed.select(F.col("node").alias("b"), F.col("held").alias("held_b")), "b")
    return storage.materialise(joined.select("a", "b", "held_a", "held_b").mapInArrow(compare, "a binary, b binary"), pairs.sparkSession, "verified")


def _levels(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A packed set as features whose weights add up: an element of n occurrences has n of them, and two sets share the least number."""
    n = int(np.frombuffer(data, "<u4", 1)[0])
    rest = np.frombuffer(data, "<u4", offset=4)
    keys = [rest[:n].astype(np.uint64) << np.uint64(32)]
    more = rest[n:].reshape(2, -1).astype(np.int64)
    level = np.arange((more[1] - 1).sum()) - np.repeat(np.cumsum(more[1] - 1) - more[1] + 1, more[1] - 1) + 2
    keys.append((np.repeat(rest[more[0]].astype(np.uint64), more[1] - 1) << np.uint64(32)) | level.astype(np.uint64))
    return np.concatenate(keys), np.concatenate([np.ones(n), np.log(level / (level - 1))])


def nearness(x: list[tuple[np.ndarray, np.ndarray]], y: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of all sets of two lists, to about six digits."""
    sizes = [np.array([len(k) for k, _ in z]) for z in (x, y)]
    keys, places = np.unique(np.concatenate([k for z in (x, y) for k, _ in z]), return_inverse=True)
    cut = sizes[0].sum()
    both = np.zeros(len(keys), np.int64)
    both[places[:cut]] = 1
    both[places[cut:]] |= 2
    number = np.cumsum(both == 3) - 1
    sides = []
    for z, size, place in ((x, sizes[0], places[:cut]), (y, sizes[1], places[cut:])):
        kept = both[place] == 3
        sides.append((np.repeat(np.arange(len(z)), size)[kept], number[place[kept]], np.sqrt(np.concatenate([w for _, w in z])[kept]).astype(np.float32)))
    shared, width = np.zeros((len(x), len(y)), np.float32), max(1, _CELLS // max(len(x), len(y)))
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        m = []
        for z, (row, column, value) in zip((x, y), sides, strict=True):
            here = (column >= a) & (column < a + width)
            m.append(np.zeros((len(z), width), np.float32))
            m[-1][row[here], column[here] - a] = value[here]
        shared += m[0] @ m[1].T
    whole = [np.array([w.sum() for _, w in z]) for z in (x, y)]
    return shared / np.maximum(whole[0][:, None] + whole[1][None, :] - shared, 1e-9)


def joined(bucket: int, left: np.ndarray, right: np.ndarray, labels: np.ndarray, bands: np.ndarray, held: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """Links that join the classes of two blocks of a bucket: of all pairs of ``left`` and ``right`` whose first common bucket this is."""
    band = int((bands[0] == bucket).argmax())
    parent = np.arange(labels.max() + 1)
    known: dict[int, tuple] = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def levels(rows: np.ndarray) -> list:
        return [known.setdefault(i, _levels(held[i])) if i not in known else known[i] for i in rows.tolist()]

    out = []
    for x in (left[a : a + _SIDE] for a in range(0, len(left), _SIDE)):
        for y in (right[a : a + _SIDE] for a in range(0, len(right), _SIDE)):
            pairs = (labels[x][:, None] != labels[y][None, :]) & (x[:, None] < y[None, :])
            for k in range(band):
                pairs &= bands[x, k][:, None] != bands[y, k][None, :]
            p, q = np.nonzero(pairs)
            if len(p) > 32:
                rows, columns = np.unique(p), np.unique(q)
                close = nearness(levels(x[rows]), levels(y[columns])) >= threshold - 1e-3
                keep = close[np.searchsorted(rows, p), np.searchsorted(columns, q)]
                p, q = p[keep], q[keep]
            for i, j in zip(x[p].tolist(), y[q].tolist(), strict=True):
                u, v = root(labels[i]), root(labels[j])
                if u != v and similarity(held[i], held[j]) >= threshold:
                    parent[u] = v
                    out.append((i, j))
    return out


def across(met: DataFrame, labels: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between classes that share a bucket, enough to join all that any pair of their nodes links."""
    spark = met.sparkSession
    spread = met.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), F.explode("bands").alias("bucket"))
    several = spread.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") != F.col("high")).select("bucket")
    mixed = spread.join(several, "bucket").join(packed.select("node", F.octet_length("held").alias("bytes")), "node")
    mixed = storage.materialise(ranked(mixed, ["bucket"], ["label", "node"], "mixed"), spark, "mixed")
    widest = mixed.groupBy("bucket").agg(F.max("bytes").alias("widest"))
    size = F.least(F.lit(BLOCK_NODES), F.greatest(F.lit(16), F.lit(BLOCK_BYTES) / F.greatest("widest", F.lit(1))).cast("int"))
    placed = mixed.join(widest, "bucket").select("bucket", "node", "label", F.floor(F.col("pos") / size).alias("block"))
    # Blocks follow the labels, so pairs of blocks of one and the same class fall out.
    blocks = placed.groupBy("bucket", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    other = blocks.select("bucket", F.col("block").alias("j"), F.col("low").alias("low_j"), F.col("high").alias("high_j"))
    met_blocks = blocks.join(other, "bucket").where((F.col("block") <= F.col("j")) & ((F.col("low") != F.col("high_j")) | (F.col("low_j") != F.col("high"))))
    sides = met_blocks.select("bucket", F.col("block").alias("i"), "j", F.explode(F.array_distinct(F.array("block", "j"))).alias("block"))
    rows = placed.join(sides, ["bucket", "block"]).join(met.select("node", "bands"), "node").join(packed.select("node", "held"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []

        def links() -> pa.RecordBatch:
            block, node, label, bands, held = (list(x) for x in zip(*group, strict=True))
            numbers = np.unique(np.array(label, object), return_inverse=True)[1]
            block = np.array(block)
            found = joined(key[0], np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2]), numbers, np.array(bands), held, threshold)
            return pa.RecordBatch.from_arrays([pa.array([node[pair[side]] for pair in found], pa.binary()) for side in (0, 1)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("bucket", "i", "j", "block", "node", "label", "bands", "held")]
            for row in zip(*columns, strict=True):
                if row[:3] != key:
                    if group:
                        yield links()
                    key, group = row[:3], []
                group.append(row[3:])
        if group:
            yield links()

    keys = ["bucket", "i", "j"]
    # By block within a pair of blocks, so that a node of the first stands before one of the second.
    grouped = session.over_all_cores(rows, *keys).sortWithinPartitions(*keys, "block", "node")
    return storage.materialise(grouped.select(*keys, "block", "node", "label", "bands", "held").mapInArrow(compare, "a binary, b binary"), spark, "across")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: (doc_id, node, label, class_id, n_links).

    ``label`` is the least digest of the class, null for empty texts, and tells
    classes apart; ``class_id`` is the class's least document id, which several
    classes share where different texts have one id or none.  ``n_links`` are the
    links found of a document's text to other texts.
    """
    spark = docs.sparkSession
    sketched = storage.materialise(sketch(docs, doc_id, text, bands, rows, shingle), spark, "sketch")
    nodes = sketched.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    nodes = storage.materialise(nodes, spark, "nodes")
    buckets = nodes.select("node", "doc_id", "bands", F.explode("bands").alias("bucket"))
    least = buckets.groupBy("bucket").agg(F.min_by("node", F.struct("doc_id", "node")).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    pairs = buckets.select("bucket", F.col("node").alias("b")).join(least, "bucket").where(F.col("a") != F.col("b"))
    tried = storage.materialise(_ordered(pairs).distinct(), spark, "pairs")
    # Every node that shares a bucket is in one of these pairs; the others need no further look.
    wanted = storage.materialise(tried.select(F.col("a").alias("node")).union(tried.select("b")).distinct(), spark, "wanted")
    packed = sets(wanted, nodes, docs, doc_id, text, shingle)
    met = storage.materialise(nodes.join(wanted, "node", "left_semi").select("node", "bands"), spark, "met")
    links = verified(tried, packed, threshold)
    labels = graph.components(links)

    more = across(met, labels, packed, threshold)
    if not more.isEmpty():
        labels = graph.components(links.union(more))
    # A class's representative is its least digest, which is its label.
    stars = verified(labels.where(F.col("node") != F.col("label")).select(F.col("label").alias("a"), F.col("node").alias("b")), packed, threshold)
    degree = stars.select(F.col("a").alias("node")).union(stars.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.join(labels, "node", "left").join(degree, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    named = storage.materialise(named, spark, "named")
    names = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = named.join(names, "label").select("node", "label", "class_id", "n_links")
    known = sketched.select("doc_id", "node").where(F.col("node").isNotNull()).join(named, "node").select("doc_id", "node", "label", "class_id", "n_links")
    alone = sketched.where(F.col("node").isNull()).select("doc_id", "node", F.col("node").alias("label"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return known.unionByName(alone)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with all their columns, one of each class: the row of the class's least document id.

    Of several texts of a class under that id, or of a class without ids, the least
    digest stays.  Documents of null or empty text all stay.  Where that row itself
    is repeated, one copy stays.
    """
    found = storage.materialise(classes(docs, doc_id, text, **options), docs.sparkSession, "classes")
    rows = found.where(F.col("node").isNotNull()).groupBy("label", "doc_id", "node").agg(F.count(F.lit(1)).alias("n"))
    # A missing id comes last.
    chosen = rows.groupBy("label").agg(F.min_by(F.struct("doc_id", "node", "n"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("r"))
    chosen = chosen.select(F.col("r.doc_id").alias("__id"), F.col("r.node").alias("__node"), F.col("r.n").alias("__n"))
    digest = F.unhex(F.md5(F.col(text).cast("binary")))
    empty = F.coalesce(F.length(F.col(text)), F.lit(0)) == 0
    keyed = docs.withColumn("__digest", digest).where(~empty)
    match = F.col(doc_id).cast("long").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__node"))
    once = keyed.join(chosen.where("__n = 1"), match, "left_semi").drop("__digest")
    kept = once.unionByName(docs.where(empty))
    if chosen.where("__n > 1").isEmpty():
        return kept
    again = keyed.join(chosen.where("__n > 1"), match, "left_semi").dropDuplicates([doc_id, "__digest"]).drop("__digest")
    return kept.unionByName(again)
