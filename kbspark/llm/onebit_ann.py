"""Nearest neighbours by inner product over randomly rotated one-bit codes.

A vector is taken relative to the centroid, normalised, rotated by a fixed random
orthogonal matrix, and kept as the signs of its components in packed bits, with
three scalars: its distance from the centroid, the inner product of the code with
the vector it stands for, and its inner product with the centroid.  They give an
unbiased estimate of any inner product and a bound on its error.

Every task searches one partition of the index with all blocks of queries: rows
whose upper bound reaches the query's k-th best so far are reranked with the
original vectors in double precision.  Each partition's best meet in a window.

Equal vectors are one index row with their ``k + 1`` smallest ids, which is all that
a result can hold, so no group of copies grows a partition or a result.

Defined results: vectors that are null, zero, or have null or non-finite components
take no part, nor do vectors whose length is not the most frequent one (the larger
of equally frequent ones); null ids take no part; a repeated row is one row; one id
with several vectors is a candidate, and a query, with each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import storage

SEED = 20240131
#: Standard deviations that the error bound covers.
EPSILON = 1.9
QUERY_BLOCK = 2048
PARTITION_ROWS = 65_536
_CHUNK = 1024
_PAIRS = 1 << 16


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for the same arguments."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, distances from the centre, <code, vector>, <vector, centre>)."""
    off = vectors - centre
    length = np.linalg.norm(off, axis=1)
    turned = off @ turn / np.where(length > 0, length, 1)[:, None]
    dot = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return np.packbits(turned >= 0, axis=1), length, np.where(length > 0, dot, 1.0), vectors @ centre


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    """The codes as vectors of length one."""
    return (np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(dim))


def estimates(codes: np.ndarray, length: np.ndarray, dot: np.ndarray, centred: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(estimated inner products, error bounds) of all rows with all queries."""
    dim = queries.shape[1]
    off = queries - centre
    size = np.linalg.norm(off, axis=1)
    turned = (off @ turn).astype(np.float32)
    cosine = signs(codes, dim) @ turned.T / dot[:, None].astype(np.float32)
    estimate = cosine * length[:, None].astype(np.float32) + (centred[:, None] + (queries @ centre)[None, :] - centre @ centre).astype(np.float32)
    spread = length * np.sqrt(np.maximum(0, 1 - dot**2)) / dot * epsilon / np.sqrt(max(dim - 1, 1))
    return estimate, (spread[:, None] * size[None, :]).astype(np.float32) + np.float32(1e-5) * (1 + np.abs(estimate))


def inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows give equal numbers."""
    return np.einsum("ij,ij->i", x, y)


def search(vectors: np.ndarray, least: np.ndarray, code: tuple, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of each query's ``k`` best rows, ties to the smaller ``least``."""
    none = np.zeros(0, np.int64)
    top = (none, none, np.zeros(0))
    floor = np.full(len(queries), -np.inf)

    def merge(top, q, i, s):
        q, i, s = np.concatenate([top[0], q]), np.concatenate([top[1], i]), np.concatenate([top[2], s])
        order = np.lexsort((least[i], -s, q))
        q, i, s = q[order], i[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        last = place == k - 1
        floor[q[last]] = s[last]
        return q[keep], i[keep], s[keep]

    # The first rows are compared as they are, to have a k-th best to compare bounds with.
    start = min(len(vectors), max(4 * k, 128))
    for a in range(0, len(queries), 256):
        exact = vectors[:start] @ queries[a : a + 256].T
        best = np.argpartition(-exact, min(k, start) - 1, axis=0)[:k]
        floor[a : a + 256] = np.take_along_axis(exact, best, 0).min(axis=0) if start >= k else -np.inf
    floor -= 1e-9 * (1 + np.abs(np.where(np.isfinite(floor), floor, 0)))
    codes, length, dot, centred = code
    for a in range(0, len(vectors), _CHUNK):
        b = min(a + _CHUNK, len(vectors))
        estimate, bound = estimates(codes[a:b], length[a:b], dot[a:b], centred[a:b], queries, centre, turn, epsilon)
        if a < start:
            bound[: start - a] = np.inf
        q, i = np.nonzero((estimate + bound >= floor[None, :].astype(np.float32)).T)
        for c in range(0, len(q), _PAIRS):
            qq, ii = q[c : c + _PAIRS], i[c : c + _PAIRS] + a
            s = inner(vectors[ii], queries[qq])
            good = s >= floor[qq]
            top = merge(top, qq[good], ii[good], s[good])
    return top


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """Distinct (vec_id, v) of the vectors that take part, v in double precision."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull()).where(F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))
    # Minus zero is zero: equal vectors must be equal keys.
    rows = rows.withColumn("v", F.transform(v, lambda x: x + F.lit(0.0)))
    # One row per length: the most frequent is taken.
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).select("dim").collect()
    return rows.where(F.size("v") == (sizes[0]["dim"] if sizes else 0)).distinct()


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def build_index(rows: DataFrame, k: int, partition_rows: int = PARTITION_ROWS, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """(v, ids, code, length, dot, centred) of every distinct vector, in the shared folder, and the centroid."""
    spark = rows.sparkSession
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    groups = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    groups = storage.materialise(groups, spark, "vectors")
    dim = (groups.select(F.size("v")).first() or [0])[0]
    n = groups.count()
    centre = np.array(groups.agg(*[F.avg(F.col("v")[i]) for i in range(dim)]).first()) if n else np.zeros(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim, seed)
        for batch in batches:
            if batch.num_rows:
                codes, length, dot, centred = encode(_matrix(batch.column("v")), centre, turn)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(dot), pa.array(centred)], names=[*batch.schema.names, "code", "length", "dot", "centred"])

    parts = max(-(-n // partition_rows), min(-(-n // 4096), 2 * spark.sparkContext.defaultParallelism), 1)
    index = groups.repartition(parts).mapInArrow(run, "v array<double>, ids array<long>, code binary, length double, dot double, centred double")
    return storage.materialise(index, spark, "index"), centre


def nearest(vectors: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """Each query's ``k`` nearest: (query_id, rank, vec_id, score).  Queries are the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = storage.materialise(usable(vectors, vec_id, embedding), spark, "usable")
    index, centre = build_index(rows, k, seed=seed)
    asked = rows.where(F.col("vec_id") % every == 0)
    # A query vector's number: its hash, and its least id in case two hashes agree.
    keyed = asked.groupBy("v").agg(F.min("vec_id").alias("least")).select("v", "least", F.xxhash64("v").alias("hash"))
    keyed = storage.materialise(keyed, spark, "queries")
    path = storage.new_dir(spark, "query-blocks") + "/blocks"
    keyed.repartition(max(1, -(-keyed.count() // QUERY_BLOCK))).write.parquet(path)
    blocks = storage.data_files(spark, path)
    dim = len(centre)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([])])
        if not held.num_rows:
            return
        turn, matrix, ids = rotation(dim, seed), _matrix(held.column("v")), held.column("ids").combine_chunks()
        least = np.array([x[0] for x in ids.to_pylist()], np.int64)
        code = (np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(matrix), -1), *(held.column(c).to_numpy() for c in ("length", "dot", "centred")))
        for block in blocks:
            files, inner_path = storage.filesystem(block)
            asked = pq.read_table(inner_path, filesystem=files, partitioning=None)
            if asked.num_rows:
                q, i, s = search(matrix, least, code, _matrix(asked.column("v")), centre, turn, k + 1, epsilon)
                yield pa.RecordBatch.from_arrays([asked.column(c).combine_chunks().take(pa.array(q)) for c in ("hash", "least")] + [pa.array(s), pa.array(least[i]), ids.take(pa.array(i))], names=["hash", "least", "score", "first", "ids"])

    found = index.mapInArrow(run, "hash long, least long, score double, first long, ids array<long>")
    best = F.row_number().over(Window.partitionBy("hash", "least").orderBy(F.desc("score"), "first"))
    found = found.withColumn("place", best).where(F.col("place") <= k + 1)
    found = found.groupBy("hash", "least").agg(F.collect_list(F.struct((-F.col("score")).alias("far"), "ids")).alias("found"))
    # At most k + 1 vectors of at most k + 1 ids each: sort them, drop the query's own row, keep k.
    flat = F.flatten(F.transform("found", lambda x: F.transform(x["ids"], lambda i: F.struct(x["far"].alias("far"), i.alias("vec_id")))))
    ranked = found.join(keyed, ["hash", "least"]).select("v", F.slice(F.array_sort(flat), 1, 2 * k + 2).alias("ranked"))
    own = asked.select("vec_id", "v").withColumnRenamed("vec_id", "query_id").join(ranked, "v")
    kept = F.slice(F.filter("ranked", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(kept).alias("place", "hit")).select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.far")).alias("score"))
