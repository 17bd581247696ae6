"""Merkle manifest of a table: a tree of digests for each key, one tree over their roots, and a proof for every row.

Leaves of a key ascend by id; every 8 consecutive nodes become the SHA-256 of their
hexadecimal digests until one is left, the subroot; subroots by key become the root
in the same way.

Positions come from a range sort, so a key's leaves lie over many tasks.  A
superblock is what 512 consecutive nodes become in three levels.  Going up, each
superblock is reduced to its node (``tower``), and superblocks' nodes are the next
stage's leaves: as many rounds as the logarithm of the largest key to base 512.
Going down (``descended``), nodes and the outer nodes that their superblock needs are
cogrouped by superblock: one call finishes the local reduction, joins the siblings
to the superblock's own path to the root, and at the leaves folds them.  A call
holds 512 nodes and one path, whatever the table's size.

Defined results: a null or missing field is ``-``; a null key is a tree of its own
and the first; a null id is the first leaf; rows of one id ascend by their leaf;
repeated rows are leaves each; an empty table has no rows; other columns are left
alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .ranking import ranked

ARITY = 8
#: Levels of a superblock.
LEVELS = 3


def field(value: Column) -> Column:
    """A value as it enters a leaf: ``-`` if null, else its UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    """The binary digest of a row's fields."""
    return F.unhex(F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256))


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above ``n`` nodes."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def reduced(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level from the given one on."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([sha(*below[a : a + ARITY]) for a in range(0, len(below), ARITY)])
    return out


def siblings(stack: list[list[str]], i: int) -> tuple[list[str], list[str]]:
    """Of the i-th node of the lowest level: what stands left and right of its path in each run, level by level."""
    left, right = [], []
    for level in stack[:-1]:
        a = i - i % ARITY
        left.append("".join(level[a:i]))
        right.append("".join(level[i + 1 : a + ARITY]))
        i //= ARITY
    return left, right


def folded(leaf: str, left: Sequence[str], right: Sequence[str]) -> str:
    """The root that a leaf and its siblings give."""
    for a, b in zip(left, right, strict=True):
        leaf = sha(a, leaf, b)
    return leaf


def leaves(docs: DataFrame, fields: Sequence[str], key: str, order: str, seen: Column | None = None) -> DataFrame:
    """(tree, id, leaf, seen, pos, n) of every row; ``seen`` is the digest of the row as it is found later, null if unchanged."""
    # A null key sorts before all others.
    tree = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))
    seen = F.lit(None).cast("binary") if seen is None else seen
    rows = docs.select(tree.alias("tree"), F.col(order).alias("id"), leaf_of([F.col(c) for c in fields]).alias("leaf"), seen.alias("seen"))
    # Written first: a range sort reads its input twice, and texts are read and hashed once.
    rows = storage.materialise(rows, docs.sparkSession, "hashed")
    return storage.materialise(ranked(rows, ["tree"], ["id", "leaf"], "leaves"), docs.sparkSession, "leaves")


def _ordered(block: pd.DataFrame, levels: int) -> tuple[pd.DataFrame, list[str], int]:
    """A superblock's rows in order, their digests, and the levels to reduce it by."""
    block = block.sort_values("pos")
    return block, [x.hex() for x in block["leaf"]], min(levels, depth(int(block["n"].iat[0])))


def tower(nodes: DataFrame, name: str, levels: int = LEVELS) -> list[DataFrame]:
    """Stages (tree, leaf, pos, n) from the given nodes up to one node a tree."""
    stages = [nodes.select("tree", "leaf", "pos", "n")]
    size = ARITY**levels
    most = stages[0].agg(F.max("n")).first()[0] or 0

    def reduce(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block, digests, own = _ordered(block, levels)
        top = reduced(digests, own)[-1]
        return pd.DataFrame({"tree": [key[0]], "leaf": [bytes.fromhex(top[0])], "pos": [key[1]], "n": [-(-int(block["n"].iat[0]) // size)]})

    while most > 1:
        blocks = stages[-1].groupBy("tree", F.expr(f"pos div {size}").alias("block"))
        stages.append(storage.materialise(blocks.applyInPandas(reduce, "tree string, leaf binary, pos long, n long"), nodes.sparkSession, name))
        most = -(-most // size)
    return stages


#: What a node knows of its way up.
PATH = "tree string, pos long, left array<string>, right array<string>, subroot string, root string"
LEAF = "id string, leaf string, subroot string, root string"


def descended(nodes: DataFrame, outer: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The paths of a stage's nodes, from those of their superblocks."""

    def spread(key: tuple, block: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({c.split()[0]: [] for c in PATH.split(", ")})
        block, digests, own = _ordered(block, levels)
        stack, up = reduced(digests, own), path.iloc[0]
        found = [siblings(stack, i) for i in range(len(digests))]
        return pd.DataFrame({
            "tree": key[0],
            "pos": block["pos"].to_numpy(),
            "left": [[*a, *up["left"]] for a, _ in found],
            "right": [[*b, *up["right"]] for _, b in found],
            "subroot": up["subroot"],
            "root": up["root"],
        })

    return _met(nodes, outer, levels).applyInPandas(spread, PATH)


def _met(nodes: DataFrame, outer: DataFrame, levels: int):
    """A stage's nodes cogrouped by superblock with the superblocks' paths."""
    if "id" in nodes.columns:
        # As text: pandas would turn a column of numbers with a null into floating point.
        nodes = nodes.withColumn("id", F.col("id").cast("string"))
    blocks = nodes.withColumn("block", F.expr(f"pos div {ARITY**levels}")).groupBy("tree", "block")
    return blocks.cogroup(outer.withColumn("block", F.col("pos")).groupBy("tree", "block"))


def outer_paths(found: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The path of every superblock of leaves: up its own tree and on through the tree of subroots."""
    spark = found.sparkSession
    stages = tower(found, "merkle", levels)
    subroots = stages[-1].select(F.col("tree").alias("key"), "leaf")
    top = ranked(subroots.withColumn("tree", F.lit("")), ["tree"], ["key"], "subroots")
    top = storage.materialise(top, spark, "subroots")
    above = tower(top, "merkle-top", levels)
    root = F.lower(F.hex("leaf"))
    nothing = F.array().cast("array<string>")
    paths = above[-1].select("tree", "pos", nothing.alias("left"), nothing.alias("right"), F.lit("").alias("subroot"), root.alias("root"))
    for stage in reversed(above[:-1]):
        paths = storage.materialise(descended(stage, paths, levels), spark, "merkle-paths")
    paths = paths.drop("tree", "subroot").join(top.select("pos", F.col("key").alias("tree"), root.alias("subroot")), "pos")
    paths = paths.select("tree", F.lit(0).cast("long").alias("pos"), "left", "right", "subroot", "root")
    # The leaves' own stage is left to the caller; a single leaf has no other.
    for stage in reversed(stages[1:-1]):
        paths = storage.materialise(descended(stage, paths, levels), spark, "merkle-paths")
    return paths


def proofs(found: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, left, right, subroot, root): every leaf's siblings on either side, level by level up to the root."""

    def prove(key: tuple, block: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        return _finished(block, path, levels, lambda leaf, seen, left, right: (left, right), ["left", "right"])

    out = _met(found, outer_paths(found, levels), levels).applyInPandas(prove, f"{LEAF}, left array<string>, right array<string>")
    return out.withColumn("id", F.col("id").cast(found.schema["id"].dataType))


def audited(found: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): each row's proof, folded from the row as it was seen."""

    def audit(key: tuple, block: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        def fold(leaf, seen, left, right):
            return sha(*(x for level in zip(left, right, strict=True) for x in level)), folded(leaf if seen is None else seen.hex(), left, right)

        out = _finished(block, path, levels, fold, ["proof_sha256", "folded_root"])
        out["verified"] = out["folded_root"] == out["root"]
        return out

    out = _met(found, outer_paths(found, levels), levels).applyInPandas(audit, f"{LEAF}, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumn("id", F.col("id").cast(found.schema["id"].dataType))


def _finished(block: pd.DataFrame, path: pd.DataFrame, levels: int, result, names: list[str]) -> pd.DataFrame:
    """A superblock of leaves with what ``result`` makes of each one's siblings up to the root."""
    if not len(block):
        return pd.DataFrame({c: [] for c in ["id", "leaf", "subroot", "root", *names]})
    block, digests, own = _ordered(block, levels)
    stack, up = reduced(digests, own), path.iloc[0]
    out = []
    for i, (leaf, seen) in enumerate(zip(digests, block["seen"], strict=True)):
        left, right = siblings(stack, i)
        out.append(result(leaf, seen, [*left, *up["left"]], [*right, *up["right"]]))
    return pd.DataFrame({"id": block["id"].to_numpy(), "leaf": digests, "subroot": up["subroot"], "root": up["root"]} | dict(zip(names, zip(*out, strict=True), strict=True)))
