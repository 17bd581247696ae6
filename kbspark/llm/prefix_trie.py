"""The trie of conversations' prefixes: who shares them, and what is told below each.

A node is a distinct sequence of first turns.  Its key is its depth and a sum, over
its turns, of 112-bit hashes of place and turn, so that the keys of a conversation
are running sums and no conversation need be in one task.

Values roll up by bands of a fixed number of levels (``rolled``).  A node is exploded
to its ancestors in its own band only.  The nodes that begin a band are the nodes of
a smaller trie, whose levels are bands; that one is rolled up in the same way, and
each completed total of a band's first node goes to the ancestors in the band above.
Any value is so exploded to at most two bands of nodes at each of as many rounds as
the logarithm of the greatest depth to the base of the band's height.

Defined results: turns ascend by number, null first, turns of one number by a digest
of role and text; null roles and texts are empty; rows without a conversation's id
take no part; a repeated row is a turn each time; other columns are left alone; an
empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import storage
from .ranking import ranked

#: Levels of a band.
BAND = 32
#: Bits of each of a key's two sums: a band's hashes add up within a long.
_MASK = (1 << 56) - 1
KEY = ["depth", "k1", "k2"]


def ordered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, n, said, n_bytes) of every turn: its place from 0, the conversation's turns, its digest and its text's length."""
    role_text, said = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role_text).cast("string"), F.lit(":"), role_text, said).cast("binary")))
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("said"), F.octet_length(said).cast("long").alias("n_bytes"))
    # Written first: a range sort reads its input twice, and texts are read once.
    rows = storage.materialise(rows.where(F.col("conv_id").isNotNull()), conversations.sparkSession, "said")
    placed = ranked(rows, ["conv_id"], ["turn", "said"], "turns")
    return storage.materialise(placed.drop("turn"), conversations.sparkSession, "turns")


def grafted(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first ``head`` turns (at most ``most``) of conversation ``base``, then their own behind as many.

    (conv_id, pos, said, n_bytes) of all turns, and (conv_id) of all conversations, turnless ones too.
    """
    spark = turns.sparkSession
    convs = turns.groupBy("conv_id").agg(F.max("n").alias("n")).select("conv_id", "n", base.alias("base"), head.cast("long").alias("head"))
    convs = storage.materialise(convs, spark, "convs")
    others = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    lead = F.least("head", F.coalesce("n_base", F.lit(0)))
    own = convs.join(others, "base", "left").select("conv_id", "head", lead.alias("lead"))
    rest = turns.join(own, "conv_id").where(F.col("pos") >= F.col("head")).select("conv_id", (F.col("lead") + F.col("pos") - F.col("head")).alias("pos"), "said", "n_bytes")
    first = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "head"), "base").where(F.col("pos") < F.col("head"))
    return rest.unionByName(first.select("conv_id", "pos", "said", "n_bytes")), convs.select("conv_id")


def paths(turns: DataFrame, band: int = BAND) -> DataFrame:
    """(conv_id, band, o1, o2, path, n_bytes): of each conversation and band, the keys of its prefixes, and the key before them."""
    spark = turns.sparkSession
    g = [F.xxhash64(F.lit(i), "pos", "said").bitwiseAND(F.lit(_MASK)) for i in (1, 2)]
    rows = turns.select("conv_id", (F.expr(f"pos div {band}")).alias("band"), "pos", "n_bytes", g[0].alias("g1"), g[1].alias("g2"))
    running = Window.partitionBy("conv_id", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("conv_id", "band", "pos", "n_bytes", F.sum("g1").over(running).alias("s1"), F.sum("g2").over(running).alias("s2"))
    pieces = rows.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list(F.struct("pos", "s1", "s2", "n_bytes"))).alias("t"))
    pieces = storage.materialise(pieces, spark, "bands")
    last = F.element_at("t", -1)
    # Only conversations longer than a band have sums to carry on, one for each band.
    sums = pieces.select("conv_id", "band", last["s1"].cast("decimal(38,0)").alias("t1"), last["s2"].cast("decimal(38,0)").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = [(F.sum(f"t{i}").over(before) % F.lit(_MASK + 1)).cast("long").alias(f"o{i}") for i in (1, 2)]
    carried = sums.select("conv_id", "band", *carried).where("band > 0")
    held = pieces.join(carried, ["conv_id", "band"], "left").withColumns({f"o{i}": F.coalesce(f"o{i}", F.lit(0)) for i in (1, 2)})
    path = F.transform("t", lambda x: F.struct(*((F.col(f"o{i}") + x[f"s{i}"]).bitwiseAND(F.lit(_MASK)).alias(f"k{i}") for i in (1, 2))))
    return storage.materialise(held.select("conv_id", "band", "o1", "o2", path.alias("path"), F.col("t.n_bytes").alias("n_bytes")), spark, "paths")


def _exploded(rows: DataFrame, first: Column, path: Column, *rest: str) -> DataFrame:
    """Keys of a stretch of a path that begins at depth ``first``, with other columns."""
    at = rows.select(*rest, first.alias("__first"), F.posexplode(path).alias("__i", "__k"))
    return at.select((F.col("__first") + F.col("__i")).cast("long").alias("depth"), F.col("__k.k1").alias("k1"), F.col("__k.k2").alias("k2"), *rest)


def rolled(values: DataFrame, pieces: DataFrame, names: list[str], band: int = BAND) -> DataFrame:
    """Sums over subtrees, (depth, k1, k2, names), of ``values(conv_id, depth, k1, k2, names)``.

    ``pieces(conv_id, band, path)`` hold the paths that lead to the values' nodes.
    """
    spark = values.sparkSession
    sums = [F.sum(n).alias(n) for n in names]
    place = (F.col("depth") - 1) % band
    at = values.withColumn("band", F.expr(f"(depth - 1) div {band}")).join(pieces.select("conv_id", "band", "path"), ["conv_id", "band"])
    inner = _exploded(at, F.col("band") * band + 1, F.slice("path", F.lit(1), (place + 1).cast("int")), *names).groupBy(*KEY).agg(*sums)
    inner = storage.materialise(inner, spark, "in-band")
    tops = inner.where((place == 0) & (F.col("depth") > 1)).join(values.select(*KEY, "conv_id"), KEY)
    tops = storage.materialise(tops.withColumn("depth", F.expr(f"(depth - 1) div {band} + 1")), spark, "band-tops")
    if tops.isEmpty():
        return inner
    # The trie of bands: its levels are this one's bands.
    deep = pieces.join(tops.select("conv_id").distinct(), "conv_id", "left_semi")
    above = deep.groupBy("conv_id", F.expr(f"band div {band}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("band", F.col("path")[0].alias("k")))).alias("t"))
    above = storage.materialise(above.select("conv_id", F.col("up").alias("band"), F.col("t.k").alias("path")), spark, "paths")
    done = rolled(tops, above, names, band).join(tops.select(*KEY, "conv_id"), KEY)
    # A band's completed total goes to the band above: all of the path there leads to it.
    over = done.withColumn("band", F.col("depth") - 2).join(pieces.select("conv_id", "band", "path"), ["conv_id", "band"])
    outer = _exploded(over, F.col("band") * band + 1, F.col("path"), *names)
    return storage.materialise(inner.unionByName(outer).groupBy(*KEY).agg(*sums), spark, "rolled")


def list_digests(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, sha256): SHA-256 of the decimal values of each key, ascending, comma-joined.

    A key's values pass through as stretches of one text each, range-sorted over all
    tasks; only the stretches, one for some thousand values, meet in a key's task,
    which hashes them one after the other.
    """
    spark = rows.sparkSession
    schema = rows.select(*keys, F.col(value).alias("first")).schema

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            ids = batch.column(value).to_pylist()
            begin, own, out = 0, list(zip(*columns, strict=True)), []
            for i in range(1, len(ids) + 1):
                if i == len(ids) or own[i] != own[begin]:
                    out.append((*own[begin], ids[begin], ",".join(map(str, ids[begin:i]))))
                    begin = i
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*(batch.schema.field(k).type for k in keys), pa.int64(), pa.string()], strict=True)], names=[*keys, "first", "stretch"])

    by = [*keys, value]
    stretches = rows.select(*by).repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(join, schema.add("stretch", "string"))
    stretches = storage.materialise(stretches, spark, "stretches")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, None
        types = None
        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            out = []
            for own, text in zip(zip(*(batch.column(k).to_pylist() for k in keys), strict=True), batch.column("stretch").to_pylist(), strict=True):
                if own != now:
                    if held:
                        out.append((*now, held.hexdigest()))
                    now, held = own, hashlib.sha256(text.encode())
                else:
                    held.update(b"," + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [*types, pa.string()], strict=True)], names=[*keys, "sha256"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*now, held.hexdigest()), [*types, pa.string()], strict=True)], names=[*keys, "sha256"])

    sorted_stretches = stretches.repartition(*keys).sortWithinPartitions(*keys, "first")
    return sorted_stretches.mapInArrow(digest, rows.select(*keys).schema.add("sha256", "string"))


def trie(turns: DataFrame, convs: DataFrame, band: int = BAND) -> DataFrame:
    """Every node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns(conv_id, pos, said, n_bytes)`` are the turns of ``convs(conv_id)``.
    """
    spark = turns.sparkSession
    pieces = paths(turns, band)
    whole = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    whole = whole.select(*(F.lit(0).cast("long").alias(k) for k in KEY), "conv_id", "n_convs", F.lit(0).cast("long").alias("n_bytes"), F.lit(-1).cast("long").alias("p1"), F.lit(-1).cast("long").alias("p2"))
    parents = F.concat(F.array(F.struct(F.col("o1").alias("k1"), F.col("o2").alias("k2"))), F.slice("path", F.lit(1), F.size("path") - 1))
    members = pieces.select("conv_id", (F.col("band") * band + 1).alias("first"), F.posexplode(F.arrays_zip("path", parents.alias("up"), "n_bytes")).alias("i", "x"))
    members = members.select((F.col("first") + F.col("i")).cast("long").alias("depth"), F.col("x.path.k1").alias("k1"), F.col("x.path.k2").alias("k2"), F.col("x.up.k1").alias("p1"), F.col("x.up.k2").alias("p2"), F.col("x.n_bytes").alias("n_bytes"), "conv_id")
    nodes = members.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = storage.materialise(nodes.unionByName(whole), spark, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
    nodes = storage.materialise(nodes, spark, "trie-nodes")
    values = nodes.where("depth > 0").select("conv_id", *KEY, "n_leaves", "saved_tokens")
    totals = rolled(values, pieces, ["n_leaves", "saved_tokens"], band)
    top = nodes.select(*(F.lit(0).cast("long").alias(k) for k in KEY), "n_leaves", "saved_tokens").groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    totals = totals.unionByName(top)

    last = pieces.select("conv_id", "band", F.struct((F.col("band") * band + F.size("path")).cast("long").alias("depth"), F.element_at("path", -1)["k1"].alias("k1"), F.element_at("path", -1)["k2"].alias("k2")).alias("end"))
    last = last.groupBy("conv_id").agg(F.max_by("end", "band").alias("end"))
    ends = convs.join(last, "conv_id", "left").select(*(F.coalesce(F.col("end")[k], F.lit(0)).cast("long").alias(k) for k in KEY), "conv_id")
    ends = list_digests(ends, KEY, "conv_id")

    # All nodes of the first level have the root for parent.
    root = nodes.where("depth = 0").select("conv_id").first()
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("up_id")).where("depth > 1")
    found = nodes.drop("n_leaves", "saved_tokens").join(totals, KEY).join(ends, KEY, "left").join(up, ["depth", "p1", "p2"], "left")
    parent = F.when(F.col("depth") == 1, F.lit(root[0] if root else None)).otherwise(F.col("up_id"))
    return found.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
