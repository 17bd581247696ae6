"""Exact top-k search by inner product of integer vectors, eliminating by a table of distances to pivots.

The index holds each distinct vector with its distances to the same pivots, sorted
by its nearest pivot and the distance to it.  For a query q and a vector x the
largest difference of their distances to a pivot is a lower bound b of their own
distance, so their product is at most (|q|^2 + |x|^2 - b^2) / 2.

Every task searches one part of the index with all blocks of queries.  Rows lie in
runs of neighbours; a run's bound is that of the ranges of its distances.  A query
takes runs in the order of their bounds, and of a run the rows whose own bounds
reach the query's k-th best so far; it stops where the next run's bound is below
that.  The k-th best starts from a bounded sample of rows, so parts that cannot
hold a result are left at once.  Nothing but rows proved to be too far is left out:
results are exact, whatever the pivots.  Parts' results meet in a window.

Equal vectors are one index row with their ``k + 1`` smallest ids, which is all that
a result can hold, so no group of copies grows a part or a result.

Defined results: a component x is floor(scale * x), x in double precision; vectors
that are null or hold null or non-finite components take no part, nor do those whose
squared length is 2**62 or more, as products might not fit a long; missing
components of the shorter of two vectors count as zero, so an empty vector's
products are 0; null ids take no part; a repeated row is one row; one id with
several vectors is a candidate, and a query, with each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

#: Distances that are kept of every vector.
PIVOTS = 32
#: Rows that pivots and first thresholds are taken from, and components of all of them.
SAMPLE, SAMPLE_CELLS = 4096, 1 << 20
#: Rows that share a bound.
RUN = 512
QUERY_BLOCK = 2048
PART_ROWS = 65_536
#: Components in one padded matrix.
CELLS = 1 << 23
#: What rounding may add to a bound, as a part of the lengths involved.
SLACK = 1e-6


def matrix(column: pa.Array | pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Integer vectors as rows, padded with zeros to the longest or to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(size.max(initial=0)))
    if len(flat) == width * len(size):
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows: in floating point where every sum is an exact integer there."""
    d = min(x.shape[1], y.shape[1])
    x, y = x[:, :d], y[:, :d]
    if d * int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) < 1 << 53:
        return (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    return x @ y.T


def lengths(x: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    return np.einsum("ij,ij->i", x.astype(np.float64), x.astype(np.float64))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots."""
    d = min(x.shape[1], pivots.shape[1])
    square = lengths(x)[:, None] + lengths(pivots)[None, :] - 2 * (x[:, :d].astype(np.float64) @ pivots[:, :d].astype(np.float64).T)
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows far from one another: each is the farthest from those before."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax(lengths(sample)))]
    near = distances(sample, sample[chosen])[:, 0]
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def at_most(length_q: np.ndarray, length_x: np.ndarray, lower: np.ndarray, reach: float) -> np.ndarray:
    """Upper bounds of products from squared lengths and lower bounds of distances, rounding included."""
    total = length_q + length_x
    slack = SLACK * (np.sqrt(length_q) + np.sqrt(length_x) + reach)
    return (total - np.square(np.maximum(lower - slack, 0))) / 2 + SLACK * total + 1


class Best:
    """Each query's best rows so far."""

    def __init__(self, floor: np.ndarray, least: np.ndarray, k: int):
        self.floor, self.least, self.k = floor.copy(), least, k
        none = np.zeros(0, np.int64)
        self.query, self.row, self.score = none, none, none

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        q, r, s = np.concatenate([self.query, query]), np.concatenate([self.row, row]), np.concatenate([self.score, score])
        order = np.lexsort((self.least[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last].astype(np.float64))
        keep = place < self.k
        self.query, self.row, self.score = q[keep], r[keep], s[keep]


def search(rows: np.ndarray, far: np.ndarray, least: np.ndarray, queries: np.ndarray, query_far: np.ndarray, floor: np.ndarray, reach: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of each query's ``k`` best rows that reach its floor, ties to the smaller ``least``; and the products worked out."""
    best, met = Best(floor, least, k), 0
    starts = np.arange(0, len(rows), RUN)
    length_x, length_q = lengths(rows), lengths(queries)
    low, high, longest = np.minimum.reduceat(far, starts), np.maximum.reduceat(far, starts), np.maximum.reduceat(length_x, starts)
    lower = np.zeros((len(queries), len(starts)), np.float32)
    for p in range(far.shape[1]):
        np.maximum(lower, query_far[:, p, None] - high[None, :, p], out=lower)
        np.maximum(lower, low[None, :, p] - query_far[:, p, None], out=lower)
    bound = at_most(length_q[:, None], longest[None, :], lower, reach)
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(len(queries))
    for step in range(len(starts)):
        run = order[active, step]
        more = bound[active, run] >= best.floor[active]
        active, run = active[more], run[more]
        if not len(active):
            break
        hits = []
        for r in np.unique(run):
            a, b, own = starts[r], min(starts[r] + RUN, len(rows)), active[run == r]
            lower = np.zeros((len(own), b - a), np.float32)
            for p in range(far.shape[1]):
                np.maximum(lower, np.abs(query_far[own, p, None] - far[None, a:b, p]), out=lower)
            wanted = at_most(length_q[own, None], length_x[None, a:b], lower, reach) >= best.floor[own, None]
            # Rows that some query of the group wants; the product of a few more pairs costs less than picking pairs.
            some = np.flatnonzero(wanted.any(axis=0))
            score = products(queries[own], rows[a:b][some])
            met += score.size
            i, j = np.nonzero(wanted[:, some] & (score >= best.floor[own, None]))
            hits.append((own[i], a + some[j], score[i, j]))
        best.add(*(np.concatenate(x) for x in zip(*hits, strict=True)))
    return best.query, best.row, best.score, met


def usable(vectors: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """Distinct (vec_id, v) of the vectors that take part, v in integers."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    short = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.abs(x * scale) + 1, F.lit(2.0))) < float(1 << 62)
    return rows.where(short).select("vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v")).distinct()


def build_index(rows: DataFrame, k: int, pivots: np.ndarray) -> DataFrame:
    """(v, ids, far) of every distinct vector in the shared folder, neighbours together."""
    spark = rows.sparkSession
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    groups = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts(batch.column("v")):
                part = batch.slice(a, b - a)
                far = distances(matrix(part.column("v")), pivots)
                near = far.argmin(axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32)), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(far)), near])], names=["v", "ids", "far", "near", "off"])

    found = storage.materialise(groups.mapInArrow(run, "v array<long>, ids array<long>, far array<float>, near int, off float"), spark, "pivot-table")
    size = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("cells")).first()
    n = size["n"]
    parts = max(-(-n // PART_ROWS), -(-(size["cells"] or 0) // CELLS), min(-(-n // 2048), 2 * spark.sparkContext.defaultParallelism), 1)
    by = ["near", "off", "v"]
    return storage.materialise(found.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("near", "off"), spark, "index")


def cuts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int]]:
    """Spans of a list column of at most ``CELLS`` components when padded, or one row."""
    size = np.asarray(pa.chunked_array([column] if isinstance(column, pa.Array) else column.chunks).combine_chunks().value_lengths().to_numpy(zero_copy_only=False), np.int64)
    begin, widest = 0, 0
    for i, s in enumerate(size.tolist()):
        widest = max(widest, s)
        if i > begin and widest * (i + 1 - begin) > CELLS:
            yield begin, i
            begin, widest = i, s
    if begin < len(size):
        yield begin, len(size)


def query_blocks(asked: DataFrame, pivots: np.ndarray, sample: np.ndarray, k: int) -> list[str]:
    """Files of the distinct query vectors: (v, least, hash, far, floor), the floor from the sample."""
    spark = asked.sparkSession
    keyed = asked.groupBy("v").agg(F.min("vec_id").alias("least")).select("v", "least", F.xxhash64("v").alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in cuts(batch.column("v")):
                part = batch.slice(a, b - a)
                x = matrix(part.column("v"))
                far = distances(x, pivots)
                # One of the sampled rows may be the query's own.
                floor = np.full(len(x), -np.inf)
                if len(sample) > k:
                    floor = np.partition(products(x, sample), len(sample) - k - 1, axis=1)[:, len(sample) - k - 1].astype(np.float64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, far.size + 1, far.shape[1], dtype=np.int32)), pa.array(far.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(floor)], names=["v", "least", "hash", "far", "floor"])

    made = storage.materialise(keyed.mapInArrow(run, "v array<long>, least long, hash long, far array<float>, floor double"), spark, "queries")
    path = storage.new_dir(spark, "query-blocks") + "/blocks"
    size = made.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("v")).alias("cells")).first()
    blocks = max(1, -(-size["n"] // QUERY_BLOCK), -(-(size["cells"] or 0) // CELLS))
    made.repartitionByRange(blocks, F.element_at("far", 1), "hash", "least").write.parquet(path)
    return storage.data_files(spark, path)


def nearest(vectors: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, scale: int = 64, pivots: int = PIVOTS) -> DataFrame:
    """Each query's ``k`` best: (query_id, rank, vec_id, score).  Queries are the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = storage.materialise(usable(vectors, vec_id, embedding, scale), spark, "usable")
    widest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    count = max(min(SAMPLE, SAMPLE_CELLS // max(widest, 1)), 2 * pivots)
    # Distinct vectors in the order of their hashes.
    drawn = rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(count).toArrow().column("v")
    sample = matrix(drawn, widest)
    chosen = spread_pivots(sample, pivots)
    reach = float(np.sqrt(lengths(chosen).max(initial=0)))
    index = build_index(rows, k, chosen)
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = query_blocks(asked, chosen, sample, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        for a, b in cuts(table.column("v")):
            part = table.slice(a, b - a)
            x, ids = matrix(part.column("v")), part.column("ids").combine_chunks()
            least = ids.flatten().to_numpy()[np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())[:-1]])]
            far = np.stack(part.column("far").to_numpy())
            for block in blocks:
                files, inner_path = storage.filesystem(block)
                queries = pq.read_table(inner_path, filesystem=files, partitioning=None)
                if queries.num_rows:
                    q, i, s, _ = search(x, far, least, matrix(queries.column("v")), np.stack(queries.column("far").to_numpy()), queries.column("floor").to_numpy(), reach, k + 1)
                    yield pa.RecordBatch.from_arrays([queries.column(c).combine_chunks().take(pa.array(q)) for c in ("hash", "least")] + [pa.array(s), pa.array(least[i]), ids.take(pa.array(i))], names=["hash", "least", "score", "first", "ids"])

    found = index.mapInArrow(run, "hash long, least long, score long, first long, ids array<long>")
    best = F.row_number().over(Window.partitionBy("hash", "least").orderBy(F.desc("score"), "first"))
    found = found.withColumn("place", best).where(F.col("place") <= k + 1)
    found = found.groupBy("hash", "least").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids")).alias("found"))
    # At most k + 1 vectors of at most k + 1 ids each: sort them, drop the query's own row, keep k.
    flat = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["far"].alias("far"), i.alias("vec_id")))))
    ranked = found.select("hash", "least", F.slice(F.array_sort(flat), 1, 2 * k + 2).alias("ranked"))
    # A query vector's number: its hash, and its least id in case two hashes agree.
    keyed = asked.groupBy("v").agg(F.min("vec_id").alias("least")).select("v", F.xxhash64("v").alias("hash"), "least")
    own = asked.select(F.col("vec_id").alias("query_id"), "v").join(keyed, "v").join(ranked, ["hash", "least"])
    kept = F.slice(F.filter("ranked", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(kept).alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
