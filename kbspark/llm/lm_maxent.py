"""Language-model scoring with a hashed, class-factored maximum-entropy model.

All training tokens are counted.  In the order of falling counts (equal ones by
hash) the whole vocabulary is one line of probability mass, cut into ``BRANCH``
classes of equal mass, each of these again, and so on for as many levels as leave
a class ``LEAF_TOKENS`` training tokens on average, ``LEVELS`` at most.  A token is
a path of classes:

    P(token | history) = P(class | history) * P(class in it | class, history) * ...

Every factor is a softmax over the classes inside a class: the logarithm of their
mass plus sums of weight rows.  The rows belong to hashed pairs of the class and a
feature of the history: the token before and the skip to the second before, and on
the first ``WIDE`` levels the two before together and the skip to the third before,
both by class.  A path ends where a token is alone; the tokens of
a class of the last level share it by their counts.  Before any training the model
is the smoothed unigram one exactly.

Training is one pass over all training documents in ``ROUNDS`` parts.  A document's
hash gives it to one of the part's learners, whose number depends on the number of
training tokens alone; a learner takes minibatch gradient steps from the common
weights over its documents, in the order of their hashes, and hands on the rows
that it changed.  A row's change is the mean of the learners' changes, weighted by
use, added up in a fixed order in two levels of bounded groups.  So the model does
not depend on how the table is stored or cut into tasks.

Counts of the ``TABLE_TOKENS`` most frequent tokens reach the tasks as a table in
the shared folder, which a worker keeps; rarer tokens lie at the end of the line in
the order of their hashes, so their path is known without their count, and their
counts come by a join of their occurrences.

Defined results: a null text is an empty one, which has only the end token; without
training documents, or in them, an unseen token has the base probability
0.5 / (N + 0.5 (V + 1)); repeated rows are scored, and learnt, each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage, textscan

#: Classes in a class, as bits and as a number.
_DIGIT = 3
BRANCH = 1 << _DIGIT
#: Levels at most (2,097,152 classes on the last) and the training tokens of a class on the last level, on average.
LEVELS, LEAF_TOKENS = 7, 256
#: Weight rows: one for so many distinct tokens, within these bounds (16 MB at most).
ROW_TOKENS, LEAST_ROWS, MOST_ROWS = 4, 1 << 14, 1 << 19
#: Levels that have all features.
WIDE = 2
ROUNDS = 2
RATE = 0.3
BATCH = 1 << 14
TABLE_TOKENS = 4_000_000
#: Training tokens of a learner and round, learners of a round at most, and those whose changes are added up first.
LEARNER_TOKENS, LEARNERS, TOGETHER = 2_500_000, 16_384, 128
#: Distinct tokens that a counting task holds before it hands them on.
_HELD = 4 << 20
_BLOCK = 1024
_END = np.uint64(0x5BD1E9955BD1E995)
_ONES = np.ones(BRANCH, np.float32)
#: Counts below this have a bin each, greater ones 1,024 for each power of two.
_EXACT_BITS, _MANTISSA = 12, 10


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of texts: (a, b, tokens of all texts with their ends, number of each)."""
    for a, b, hashes, counts in textscan.word_hashes(column, textscan.NOT_SPACE):
        out = np.full(len(hashes) + len(counts), _END, np.uint64)
        mask = np.ones(len(out), bool)
        mask[np.cumsum(counts + 1) - 1] = False
        out[mask] = hashes
        yield a, b, out, counts + 1


def count_tokens(docs: DataFrame, text: str) -> DataFrame:
    """(token, n) over all rows; counted within each task first."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[first], np.add.reduceat(n, first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, found, _ in tokens(batch.column("text")):
                held.append(np.unique(found, return_counts=True))
                size += len(held[-1][0])
                if size > _HELD:
                    held = [merged(held)]
                    size = len(held[0][0])
                    if size > _HELD // 2:
                        yield from out(*held[0])
                        held, size = [], 0
        if held:
            yield from out(*merged(held))

    def out(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)].view(np.int64)), pa.array(n[i : i + (1 << 16)].astype(np.int64))], names=["token", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "token long, n long")
    return counted.groupBy("token").agg(F.sum("n").alias("n"))


def bin_of(n: np.ndarray) -> np.ndarray:
    """Ascending bins of token counts; there are under 60,000."""
    n = np.asarray(n, np.int64)
    power = np.maximum(np.frexp(n.astype(np.float64))[1] - 1, _EXACT_BITS)
    return np.where(n < 1 << _EXACT_BITS, n, (1 << _EXACT_BITS) + (power - _EXACT_BITS - 1) * (1 << _MANTISSA) + (n >> (power - _MANTISSA)))


_BIN_SQL = f"CASE WHEN n < {1 << _EXACT_BITS} THEN n ELSE {1 << _EXACT_BITS} + (length(bin(n)) - {_EXACT_BITS + 2}) * {1 << _MANTISSA} + shiftright(n, length(bin(n)) - {_MANTISSA + 1}) END"


class Line:
    """The vocabulary as a line of probability mass: where a token lies, by its count and hash."""

    def __init__(self, bins: np.ndarray, tokens: np.ndarray, mass: np.ndarray, table_tokens: int):
        """``bins`` ascend; ``tokens`` and ``mass`` are the distinct tokens and the sum of count + 0.5 of each."""
        self.total, self.distinct = int(round(mass.sum() - 0.5 * tokens.sum())), int(tokens.sum())
        above = np.cumsum(tokens[::-1])[::-1]
        #: Tokens of this bin and lower ones, and unseen ones, are rare.
        self.rare = int(bins[above > table_tokens].max(initial=0))
        self.n_table = int(tokens[bins > self.rare].sum())
        held = bins > self.rare
        self.bins, self.mass = bins[held], mass[held]
        self.starts = np.cumsum(self.mass[::-1])[::-1] - self.mass
        self.rare_start = float(self.mass.sum())
        self.all = self.rare_start + float(mass[~held].sum()) + 0.5
        leaves = max(self.total // LEAF_TOKENS, 1)
        self.levels = min(LEVELS, max(3, (leaves.bit_length() - 1) // _DIGIT))
        self.n_leaves = BRANCH**self.levels
        self.first_rare = self.n_leaves - 1 if self.rare == 0 else min(int(self.rare_start / self.all * self.n_leaves), self.n_leaves - 1)

    def log_base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def leaf(self, found: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Classes of the last level of tokens that are not rare."""
        at = np.searchsorted(self.bins, bin_of(n))
        return self._cut(self.starts[at] + self.mass[at] * textscan.unit(found))

    def rare_leaf(self, found: np.ndarray) -> np.ndarray:
        if self.rare == 0:
            return np.full(len(found), self.n_leaves - 1, np.int32)
        return np.maximum(self._cut(self.rare_start + (self.all - self.rare_start) * textscan.unit(found)), np.int32(self.first_rare))

    def _cut(self, place: np.ndarray) -> np.ndarray:
        return np.minimum(place / self.all * self.n_leaves, self.n_leaves - 1).astype(np.int32)


class Classes:
    """The tree over the line: the classes' masses as biases of softmaxes, and where paths end."""

    def __init__(self, line: Line, leaf: np.ndarray, tokens: np.ndarray, mass: np.ndarray):
        self.line = line
        self.mass, n = np.zeros(line.n_leaves), np.zeros(line.n_leaves, np.int64)
        self.mass[leaf], n[leaf] = mass, tokens
        # An unseen token belongs to each class that rare tokens may have.
        self.mass[line.first_rare :] += 0.5
        n[line.first_rare :] += 1
        levels = line.levels
        self.offsets = np.cumsum([0, *(BRANCH**i for i in range(levels - 1))])
        biases, self.depth = [], np.full(line.n_leaves, levels, np.int8)
        with np.errstate(divide="ignore", invalid="ignore"):
            for level in range(levels):
                inside = self.mass.reshape(BRANCH**level, BRANCH, -1).sum(axis=2)
                biases.append(np.log(inside / inside.sum(axis=1, keepdims=True)))
            self.log_mass = np.log10(self.mass)
        # A class without tokens has a probability below 1e-30.
        self.bias = np.nan_to_num(np.concatenate(biases), nan=0.0, posinf=0.0, neginf=-80.0).astype(np.float32)
        for level in range(levels - 1, -1, -1):
            alone = n.reshape(BRANCH**level, -1).sum(axis=1) == 1
            self.depth[np.repeat(alone, BRANCH ** (levels - level))] = level

    def decisions(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(index of the token, class, class in it) for every step of the tokens' paths, level by level; steps on wide levels."""
        items, nodes, digits = [], [], []
        depth = self.depth[leaf]
        for level in range(self.line.levels):
            at = np.flatnonzero(depth > level)
            own = leaf[at] >> (_DIGIT * (self.line.levels - level - 1))
            items.append(at)
            nodes.append((own >> _DIGIT) + self.offsets[level])
            digits.append(own & (BRANCH - 1))
        return np.concatenate(items), np.concatenate(nodes), np.concatenate(digits), sum(map(len, items[:WIDE]))

    def names(self, leaf: np.ndarray) -> np.ndarray:
        """What a history knows of a token: the token itself if it is alone in a class, else its class two levels up; and its class of the second level."""
        levels = self.line.levels
        fine = np.where(self.depth[leaf] < levels, leaf + self.line.n_leaves, leaf >> (2 * _DIGIT)) + 1
        return np.stack([fine, (leaf >> (_DIGIT * (levels - 2))) + 1]).astype(np.int32)


def histories(names: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each token's history as names: one before, two before, both together by class, three before by class; 0 before a text's beginning."""
    n = names.shape[1]
    at = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)

    def before(row: np.ndarray, j: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        out[j:] = row[:-j]
        out[at < j] = 0
        return out

    fine, coarse = names
    return np.stack([before(fine, 1), before(fine, 2), before(coarse, 1) * (BRANCH**2 + 1) + before(coarse, 2), before(coarse, 3)])


def features(back: np.ndarray) -> np.ndarray:
    """A 64-bit number for each of the features of each history."""
    return np.stack([textscan.seeded(x.astype(np.uint64), i) for i, x in enumerate(back)])


class Weights:
    """Rows of ``BRANCH`` weights, found by hashes of a feature and a class."""

    def __init__(self, bits: int):
        self.bits = bits
        self.rows = np.zeros((1 << bits, BRANCH), np.float32)

    def places(self, h: np.ndarray, items: np.ndarray, nodes: np.ndarray, wide: int) -> list[np.ndarray]:
        """The rows of each feature, for its steps: all, or the first ``wide``."""
        out = []
        with np.errstate(over="ignore"):
            own = (nodes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            for x, n in zip(h, (len(items), len(items), wide, wide), strict=True):
                out.append(((x[items[:n]] ^ own[:n]) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64))
        return out

    def sums(self, places: list[np.ndarray], bias: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """The softmaxes' arguments: biases of the classes and sums of rows."""
        z = np.take(bias, nodes, axis=0, mode="clip")
        held = np.empty_like(z)
        for p in places:
            z[: len(p)] += np.take(self.rows, p, axis=0, out=held[: len(p)], mode="clip")
        # Far beyond any that training gives; no exponential overflows.
        return np.minimum(z, 60, out=z)


class Learner:
    """Minibatch gradient steps with a rate for each row; remembers which rows it changed, and how often."""

    def __init__(self, weights: Weights, classes: Classes):
        self.c, self.start = classes, weights.rows
        self.w = Weights(weights.bits)
        self.w.rows[:] = weights.rows
        self.squares = np.ones(len(weights.rows), np.float32)
        self.last = np.zeros(len(weights.rows), np.int32)
        self.used = np.zeros(len(weights.rows), np.float32)

    def learn(self, leaf: np.ndarray, back: np.ndarray) -> None:
        """One minibatch: the tokens' classes and histories."""
        items, nodes, digits, wide = self.c.decisions(leaf)
        if not len(items):
            return
        places = self.w.places(features(back), items, nodes, wide)
        g = self.w.sums(places, self.c.bias, nodes)
        np.exp(g, out=g)
        g *= (-1 / (g @ _ONES))[:, None]
        g[np.arange(len(g)), digits] += 1
        # Each row once: the last of its uses stands for it.
        flat = np.concatenate(places)
        place = np.arange(len(flat), dtype=np.int32)
        self.last[flat] = place
        last = self.last[flat]
        own = last == place
        at, index = flat[own], (np.cumsum(own) - 1)[last]
        parts = np.split(index, np.cumsum([len(p) for p in places[:-1]]))
        total = np.zeros((BRANCH, len(at)))
        for j, column in enumerate(np.ascontiguousarray(g.T).astype(np.float64)):
            for i in parts:
                total[j] += np.bincount(i, column[: len(i)], len(at))
        total = np.ascontiguousarray(total.T).astype(np.float32)
        held = self.squares[at] + np.einsum("ij,ij->i", total, total)
        self.squares[at] = held
        total *= (RATE / np.sqrt(held))[:, None]
        total += np.take(self.w.rows, at, axis=0, mode="clip")
        self.w.rows[at] = total
        self.used[at] += np.bincount(index, minlength=len(at))

    def changes(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, uses of its rows, their changes), for the blocks that changed."""
        for a in range(0, len(self.used), _BLOCK):
            n = self.used[a : a + _BLOCK]
            if n.any():
                change = self.w.rows[a : a + _BLOCK] - self.start[a : a + _BLOCK]
                # Half precision keeps a change to a thousandth; its range is far beyond any weight.
                yield a, n.tobytes(), np.clip(change, -60000, 60000).astype(np.float16).tobytes()


class Table:
    """Sorted tokens with their counts and classes, found by the leading bits of a token and a short walk."""

    BITS = 20

    def __init__(self, uris: list[str], size: int):
        self.keys, self.n, self.leaf = np.zeros(size, np.uint64), np.zeros(size, np.int64), np.zeros(size, np.int32)
        at = 0
        for uri in uris:
            files, inner = storage.filesystem(uri)
            part = pq.read_table(inner, filesystem=files, partitioning=None)
            self.keys[at : at + len(part)] = part.column("token").to_numpy().view(np.uint64)
            self.n[at : at + len(part)] = part.column("n").to_numpy()
            self.leaf[at : at + len(part)] = part.column("leaf").to_numpy()
            at += len(part)
        order = np.argsort(self.keys)
        for name in ("keys", "n", "leaf"):
            setattr(self, name, getattr(self, name)[order])
        self.first = np.searchsorted(self.keys >> np.uint64(64 - self.BITS), np.arange(1 << self.BITS, dtype=np.uint64)).astype(np.int32)

    def lookup(self, found: np.ndarray) -> np.ndarray:
        """Each token's place in the table, or -1."""
        out = np.full(len(found), -1, np.int64)
        if not len(self.keys):
            return out
        at = self.first[(found >> np.uint64(64 - self.BITS)).astype(np.int64)].astype(np.int64)
        left = np.arange(len(found))
        while len(left):
            inside = at < len(self.keys)
            left, at = left[inside], at[inside]
            here = self.keys[at]
            want = found[left]
            same = here == want
            out[left[same]] = at[same]
            on = here < want
            left, at = left[on], at[on] + 1
        return out


_tables: dict[tuple[str, ...], Table] = {}


def _table(uris: tuple[str, ...], size: int) -> Table:
    """This worker's table; one at a time, of ``TABLE_TOKENS`` rows of 20 bytes at most."""
    if uris not in _tables:
        _tables.clear()
        _tables[uris] = Table(list(uris), size)
    return _tables[uris]


class Model:
    def __init__(self, line: Line, classes: Classes, weights: Weights, files: tuple[str, ...]):
        self.line, self.classes, self.weights, self.files = line, classes, weights, files

    def known(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, class of the last level) of each token; the count is -1 for those outside the table."""
        table = _table(self.files, self.line.n_table)
        at = table.lookup(found)
        if not len(table.keys):
            return at, self.line.rare_leaf(found)
        inside = at >= 0
        return np.where(inside, table.n[at], -1), np.where(inside, table.leaf[at], self.line.rare_leaf(found))

    def log_paths(self, leaf: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each token's class of the last level, or of the token where it is alone earlier."""
        back = histories(self.classes.names(leaf), counts)
        out = np.empty(len(leaf))
        for a in range(0, len(leaf), BATCH):
            own = leaf[a : a + BATCH]
            items, nodes, digits, wide = self.classes.decisions(own)
            z = self.weights.sums(self.weights.places(features(back[:, a : a + BATCH]), items, nodes, wide), self.classes.bias, nodes)
            right = z[np.arange(len(z)), digits].astype(np.float64)
            np.exp(z, out=z)
            out[a : a + BATCH] = np.bincount(items, right - np.log(z @ _ONES), len(own))
        return out / np.log(10)


def train_round(docs: DataFrame, text: str, model: Model, learners: int) -> None:
    """One round over ``docs(key, text)``: each learner's steps, and the mean of their changes put into the model's weights."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = "block int, part int, learner int, used binary, change binary"

    def rows_of(learner: Learner, number: int) -> pa.RecordBatch:
        rows = list(learner.changes())
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([number // TOGETHER] * len(rows), pa.int32()), pa.array([number] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "part", "learner", "used", "change"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        learner, number = None, -1
        leaf, back = np.zeros(0, np.int32), np.zeros((4, 0), np.int32)
        for batch in batches:
            owner = batch.column("learner").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
            for i, j in zip(edges, edges[1:], strict=False):
                if i == j:
                    continue
                if learner is None or owner[i] != number:
                    if learner is not None:
                        learner.learn(leaf, back)
                        yield rows_of(learner, number)
                    learner, number = Learner(m.weights, m.classes), int(owner[i])
                    leaf, back = leaf[:0], back[:, :0]
                for _, _, found, counts in tokens(batch.column("text").slice(i, j - i)):
                    # Minibatches do not end with a batch of rows, so these do not matter.
                    own = m.known(found)[1]
                    leaf = np.concatenate([leaf, own])
                    back = np.concatenate([back, histories(m.classes.names(own), counts)], axis=1)
                    whole = len(leaf) // BATCH * BATCH
                    for a in range(0, whole, BATCH):
                        learner.learn(leaf[a : a + BATCH], back[:, a : a + BATCH])
                    leaf, back = leaf[whole:], back[:, whole:]
        if learner is not None:
            learner.learn(leaf, back)
            yield rows_of(learner, number)

    def added(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """Uses, and uses times changes, summed over the rows of one block in the order of the learners."""
        block, part = (k.as_py() for k in key)
        table = table.sort_by("learner")
        used, change = np.float32(0), np.float32(0)
        for u, c in zip(table.column("used").to_pylist(), table.column("change").to_pylist(), strict=True):
            u = np.frombuffer(u, np.float32)
            if len(c) == 2 * len(u) * BRANCH:
                c = np.frombuffer(c, np.float16).astype(np.float32).reshape(-1, BRANCH) * u[:, None]
            else:
                c = np.frombuffer(c, np.float32).reshape(-1, BRANCH)
            used, change = used + u, change + c
        return pa.table({"block": pa.array([block], pa.int32()), "part": pa.array([part], pa.int32()), "learner": pa.array([part], pa.int32()), "used": pa.array([used.tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})

    placed = docs.select(F.pmod(F.shiftright("key", 8), F.lit(learners)).cast("int").alias("learner"), "key", "text")
    ordered = placed.repartitionById(learners, "learner").sortWithinPartitions("learner", "key", "text").select("learner", "text")
    changes = ordered.mapInArrow(run, schema).groupBy("block", "part").applyInArrow(added, schema)
    changes = changes.withColumn("part", F.lit(0)).groupBy("block", "part").applyInArrow(added, schema)
    # The weights' size is bounded: MOST_ROWS x BRANCH numbers.
    for row in changes.collect():
        used = np.maximum(np.frombuffer(row["used"], np.float32), 1)
        x = np.frombuffer(row["change"], np.float32).reshape(-1, BRANCH) / used[:, None]
        model.weights.rows[row["block"] : row["block"] + len(x)] += x
    shared.unpersist()


def _segment_sums(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, np.cumsum(counts) - counts) if len(counts) else np.zeros(0)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, table_tokens: int = TABLE_TOKENS, learner_tokens: int = LEARNER_TOKENS) -> tuple[Model, DataFrame]:
    """The model learnt from all rows, and the table (token, n) of all their tokens."""
    spark = docs.sparkSession
    counts = storage.materialise(count_tokens(docs, text), spark, "counts")
    # Under 60,000 bins.
    bins = counts.groupBy(F.expr(_BIN_SQL).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("n") + 0.5).alias("mass")).toArrow().sort_by("bin")
    line = Line(*(bins.column(c).to_numpy() for c in ("bin", "tokens", "mass")), table_tokens)
    shared = spark.sparkContext.broadcast(line)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, n = batch.column("token").to_numpy().view(np.uint64), batch.column("n").to_numpy()
            held = bin_of(n) > shared.value.rare
            leaf = shared.value.rare_leaf(found)
            leaf[held] = shared.value.leaf(found[held], n[held])
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(leaf), pa.array(held)], names=["token", "n", "leaf", "held"])

    path = storage.new_dir(spark, "coded")
    counts.mapInArrow(coded, "token long, n long, leaf int, held boolean").write.partitionBy("held").parquet(f"{path}/table")
    whole = spark.read.schema("token long, n long, leaf int").parquet(f"{path}/table")
    files = tuple(storage.data_files(spark, f"{path}/table/held=true")) if line.n_table else ()
    # BRANCH ** LEVELS classes at most.
    leaves = whole.groupBy("leaf").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.col("n") + 0.5).alias("mass")).toArrow()
    classes = Classes(line, *(leaves.column(c).to_numpy() for c in ("leaf", "tokens", "mass")))
    bits = int(np.clip(line.distinct // ROW_TOKENS, LEAST_ROWS, MOST_ROWS) - 1).bit_length()
    model = Model(line, classes, Weights(bits), files)
    keyed = docs.select(F.xxhash64(F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("key"), F.col(text).cast("string").alias("text"))
    learners = int(np.clip(-(-line.total // (rounds * learner_tokens)), 1, LEARNERS))
    for r in range(rounds):
        train_round(keyed.where(F.pmod("key", F.lit(rounds)) == r), text, model, learners)
    return model, counts


SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, counts: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ``SCORES``) of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    line = model.line
    every = line.rare == 0

    def parts(column: pa.Array):
        """For each slice of texts: (a, b, tokens, number of each, which are outside the table, sums over those inside)."""
        m = shared.value
        for a, b, found, n in tokens(column):
            c, leaf = m.known(found)
            outside = c < 0
            # Where the table holds every training token, those outside are unseen.
            seen = np.where(outside, 0, c)
            base, share = m.line.log_base(seen), np.log10(seen + 0.5)
            if not every:
                base[outside] = share[outside] = 0.0
            whole = m.log_paths(leaf, n) - m.classes.log_mass[leaf] + share
            yield a, b, found, n, outside, (n, _segment_sums((c > 0).astype(np.int64), n), np.full(b - a, m.line.total), _segment_sums(base, n), _segment_sums(whole, n))

    if every:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a, b, _, _, _, sums in parts(batch.column("text")):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        return rows.mapInArrow(run, f"doc_id {kind}, {SCORES}")

    # A row's own number, fixed by writing it, with its sums so far and its tokens outside the table.
    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, done = uuid.uuid4().hex, 0
        for batch in batches:
            for a, b, found, n, outside, sums in parts(batch.column("text")):
                owner = np.repeat(np.arange(b - a), n)[outside]
                ends = np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found[outside].view(np.int64)))
                names = pa.array([f"{mark}-{done + i}" for i in range(b - a)])
                done += b - a
                yield pa.RecordBatch.from_arrays([names, batch.column("doc_id").slice(a, b - a), *map(pa.array, sums), lists], names=["row", "doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "tokens"])

    held = storage.materialise(rows.mapInArrow(bags, f"row string, doc_id {kind}, {SCORES}, tokens array<long>"), spark, "bags")
    spread = held.select("row", F.explode("tokens").alias("token")).groupBy("row", "token").agg(F.count(F.lit(1)).alias("times"))
    # Tokens of the table are not among them, so no token here is frequent in the training texts.
    met = spread.join(counts, "token", "left")
    n = F.coalesce("n", F.lit(0))
    base = F.col("times") * F.log10((n + 0.5) / F.lit(line.total + 0.5 * (line.distinct + 1)))
    sums = met.groupBy("row").agg(F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(base).alias("more_base"), F.sum(F.col("times") * F.log10(n + 0.5)).alias("more"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return held.join(sums, "row", "left").select("doc_id", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), "train_tokens", (F.col("base_score") + zero("more_base")).alias("base_score"), (F.col("score") + zero("more")).alias("score"))
