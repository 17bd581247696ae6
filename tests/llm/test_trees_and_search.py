"""Merkle manifests, exact top-k search and conversation tries against brute force."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark.llm import merkle_exchange as merkle
from kbspark.llm import pivot_topk, prefix_trie
from kbspark.llm import queries as q
from kbspark.llm.ranking import ranked

DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, leaf string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def docs_of(spark, rows):
    """Some columns clash with names that operators use."""
    return spark.createDataFrame([(*r, "x", 7, "y") for r in rows], DOCS)


def put(docs, path):
    docs.write.parquet(str(path))
    return str(path.parent)


def manifest(rows):
    """doc_id and all results, leaf by leaf in plain Python."""

    def up(nodes):
        stack = [nodes]
        while len(stack[-1]) > 1:
            stack.append([sha("".join(stack[-1][a : a + 8])) for a in range(0, len(stack[-1]), 8)])
        return stack

    def near(stack, i):
        for level in stack[:-1]:
            a = i - i % 8
            yield level[a:i], level[i + 1 : a + 8]
            i //= 8

    def leaf(r, low=False):
        text = r[1] if r[1] is None or not low else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    low = {}
    for k in keys:
        groups[k].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        low[k] = up([leaf(r) for r in groups[k]])
    top = up([low[k][-1][0] for k in keys])
    out = []
    for j, k in enumerate(keys):
        for i, r in enumerate(groups[k]):
            path = [*near(low[k], i), *near(top, j)]
            x = leaf(r, zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0)
            for a, b in path:
                x = sha("".join([*a, x, *b]))
            out.append((r[0], leaf(r), low[k][-1][0], top[-1][0], sha("".join(y for a, b in path for y in a + b)), x, x == top[-1][0]))
    return out


def langs(n):
    return [(i, f"Text {i} É" if i % 7 else None, [None, "", "de", "é", "en", "en", "en"][i % 7], f"s{i % 3}", i if i % 5 else None) for i in range(n)]


BIG = 2**60


@pytest.mark.parametrize(
    "rows",
    [
        langs(40),
        [(i, f"T{i}", "en", None, 1) for i in range(700)],
        [(0, "A", None, None, None)],
        # Ties, repeats, a missing id beside ids that floating point cannot hold, empty and very long texts.
        [(None, "No id", "en", "s", 1), (None, None, "en", None, None), *[(BIG + 1, "Same", "en", "s", 4)] * 20, (BIG, "", "en", "s", 0), (3, "Ab " * 100_000, "en", "s", 1), (3, "other", "en", "s", 2), (-5, "x", "en", "s", 2)],
        [(i, "One key a row", f"k{i:03}", "s", i) for i in range(75)],
    ],
    ids=["keys", "two-stages", "single", "ties", "many-keys"],
)
def test_op11_against_plain_python(spark, tmp_path, rows):
    sf = put(docs_of(spark, rows), tmp_path / "documents.parquet")
    got = q.op11_merkle_exchange(spark, sf)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, manifest(rows)))


def test_op11_an_empty_table_has_no_rows(spark, tmp_path):
    assert q.op11_merkle_exchange(spark, put(docs_of(spark, []), tmp_path / "documents.parquet")).count() == 0


def test_op11_proofs_fold_to_the_root_and_find_any_change(spark):
    """Superblocks of one level: several rounds up and down; text ids; the siblings themselves."""
    docs = spark.range(700).select(F.concat(F.lit("id-"), F.lpad("id", 4, "0")).alias("name"), (F.col("id") % 2).alias("part"), F.md5(F.col("id").cast("string")).alias("body"))
    changed = F.when(F.col("name") == "id-0123", merkle.leaf_of([F.col("name"), F.lit("changed")]))
    found = merkle.leaves(docs, ["name", "body"], key="part", order="name", seen=changed)
    proofs = merkle.proofs(found, levels=1).collect()
    assert len(proofs) == 700 and len({(p.subroot, p.root) for p in proofs}) == 2 and len({p.root for p in proofs}) == 1
    assert all(merkle.folded(p.leaf, p.left, p.right) == p.root for p in proofs)
    assert {len(p.left) for p in proofs} == {merkle.depth(350) + 1}
    assert [r.id for r in merkle.audited(found, levels=1).where("not verified").collect()] == ["id-0123"]


def test_positions_lie_over_tasks(spark):
    """One key of nearly all rows, all equal: places are a permutation and tasks share them."""
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, "hot").when(F.col("id") < 19_990, F.col("id").cast("string")).alias("k"), F.lit(1).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = ranked(rows.repartition(16), ["k"], ["v"], "places")
        counts = got.groupBy("k").agg(F.count("*").alias("c"), F.max("n").alias("n"), F.countDistinct("pos").alias("d"), F.max("pos").alias("m"), F.min("pos").alias("l"))
        assert counts.where("c <> n OR d <> n OR m <> n - 1 OR l <> 0").isEmpty()
        assert got.where("k = 'hot'").withColumn("t", F.spark_partition_id()).select("t").distinct().count() > 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def exact(rows, k, every=20, scale=64):
    held = {(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in held:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in held if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, score long, far double")


def test_op12_is_exact(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, list(map(float, rng.standard_normal(12)))) for i in range(400)]
    # A hot vector, ties, repeated rows, vectors that take no part, several vectors of one id, other lengths, zero.
    rows += [(1000 + i, [0.5] * 12) for i in range(200)] + [rows[20], rows[20], rows[3]]
    rows += [(40, [9.0] * 12), (None, [1.0] * 12), (2000, None), (2020, [1.0, None] * 6), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12)]
    rows += [(2080, [0.0] * 12), (2100, []), (2120, [1.0, 2.0]), (2140, [0.25] * 20), (2160, [-0.001] * 12)]
    got = q.op12_pivot_topk(spark, put(vectors_of(spark, rows), tmp_path / "embeddings.parquet"))
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == exact(rows, 20)


def test_op12_few_rows_none_and_large_components(spark):
    few = [(0, [1.0, 2.0]), (20, [3.0, -1.0]), (7, [1e7, 1e7]), (40, [-3e7, 1e7 + 0.25]), (60, [1e300, 1.0])]
    got = pivot_topk.nearest(vectors_of(spark, few), k=20)
    # The last one's products do not fit a long.
    assert sorted(map(tuple, got.collect())) == exact(few[:4], 20)
    assert pivot_topk.nearest(vectors_of(spark, [])).count() == 0
    assert pivot_topk.nearest(vectors_of(spark, [(1, [1.0])])).count() == 0


def test_op12_eliminates_where_vectors_cluster():
    """Bounds hold for all pairs, and clustered vectors are left out by them."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16)) * 200
    centres *= 800 / np.linalg.norm(centres, axis=1)[:, None]
    x = np.floor(centres[rng.integers(0, 40, 20_000)] + rng.standard_normal((20_000, 16)) * 8).astype(np.int64)
    pivots = pivot_topk.spread_pivots(x[:2000], 32)
    far = pivot_topk.distances(x, pivots)
    order = np.lexsort((far.min(axis=1), far.argmin(axis=1)))
    x, far = x[order], far[order]
    queries = x[::400]
    near = pivot_topk.distances(queries, pivots)
    reach = float(np.sqrt(pivot_topk.lengths(pivots).max()))
    bound = pivot_topk.at_most(pivot_topk.lengths(queries)[:, None], pivot_topk.lengths(x)[None], np.abs(near[:, None, :] - far[None]).max(axis=2), reach)
    assert (bound >= queries @ x.T).all()
    floor = np.partition(queries @ x[:2000].T, -21, axis=1)[:, -21].astype(float)
    found, row, score, met = pivot_topk.search(x, far, np.arange(len(x)), queries, near, floor, reach, 21)
    want = np.sort(queries @ x.T, axis=1)[:, ::-1][:, :21]
    assert (score.reshape(len(queries), 21) == want).all() and (found == np.repeat(np.arange(len(queries)), 21)).all()
    assert met < 0.25 * len(x) * len(queries), met


def test_op12_products_are_exact_beyond_floating_point():
    x = np.array([[2**30, 3], [2**30 + 1, -5]], np.int64)
    assert pivot_topk.products(x, x).tolist() == [[2**60 + 9, 2**60 + 2**30 - 15], [2**60 + 2**30 - 15, 2**60 + 2**31 + 1 + 25]]
    assert pivot_topk.matrix(pa.array([[1, 2, 3], [], [4]])).tolist() == [[1, 2, 3], [0, 0, 0], [4, 0, 0]]


def told(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in convs.items()}


def rebuilt(rows):
    own = told(rows)
    head = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - int(math.fmod(c, 5)), [])[: head[c]] + own[c][head[c] :] for c in own}


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, who in members.items():
        below = [(n, w) for n, w in members.items() if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[:-1] == n for m in members)
        ends = ",".join(map(str, sorted(c for c in who if len(convs[c]) == len(node))))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(n) == len(node) + 1 for n, _ in below), sum(leaf(n) for n, _ in below),
            sum((len(w) - 1) * (len(n[-1][1].encode()) if n else 0) for n, w in below), sha(ends),
        ))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, pos long, depth string, k1 string"


def turns_of(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", "y") for r in rows], TURNS)


def some_turns(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(c, t, ["user", "model"][t % 2], f"é{rng.integers(0, 2 if t < 3 else 3)}") for c in range(60) for t in range(rng.integers(1, 14))]
    # One conversation under many ids, a missing base, missing numbers, roles and texts, ties, a repeated row, an empty and a long text.
    rows += [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(4)] + [(207, t, "user", "orphan") for t in range(3)]
    rows += [(300, None, "user", "first"), (300, 1, None, None), (300, 1, "user", "tie"), (300, 1, "user", "tie"), (301, None, None, None), (None, 1, "user", "nobody's")]
    return rows + [(302, 1, "user", ""), (302, 2, "", ""), (303, 1, "user", "long " * 50_000)]


def test_op13_against_plain_python(spark, tmp_path):
    rows = some_turns()
    got = q.op13_prefix_trie(spark, put(turns_of(spark, rows), tmp_path / "conversations.parquet"))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert any(not t for t in rebuilt(rows).values())
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(rebuilt(rows))


@pytest.mark.parametrize("band", [2, 3, 7])
def test_op13_bands_roll_up_over_several_rounds(spark, band):
    rows = [(c, t, "user", f"{t}" if t < 40 - 6 * c else f"{c}/{t}") for c in range(6) for t in range(41 - c)]
    turns = prefix_trie.ordered(turns_of(spark, rows))
    got = prefix_trie.trie(turns, turns.select("conv_id").distinct(), band)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_trie(told(rows))


def test_op13_an_empty_table_has_no_nodes(spark, tmp_path):
    assert q.op13_prefix_trie(spark, put(turns_of(spark, []), tmp_path / "conversations.parquet")).count() == 0
    assert q.op13_prefix_trie(spark, put(turns_of(spark, [(None, 1, "user", "x")]), tmp_path / "more" / "conversations.parquet")).count() == 0


@pytest.mark.parametrize("name", ["op11_merkle_exchange", "op12_pivot_topk", "op13_prefix_trie"])
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    from compare import rows

    got, want = q.queries()[name](spark, sf_dir), duck.sql(q.oracles()[name])
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
