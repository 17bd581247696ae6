"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and other columns."""

import base64
import collections
import hashlib
import math
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kbspark.llm import bitpack, dartminhash, graph, langid_kernel, license_digest, lm_maxent, onebit_ann, poisson_mix, textscan, url_digest, warc_shards, winnow
from kbspark.llm import queries as q

WORDS = "the cat sat on a mat and saw der hund la casa una vez il était where nothing ever happens to anyone at all".split()


def texts(n=60, seed=0):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(1, 60))) for _ in range(n)]


ODD = [None, "", " ", "\n\t", "...!?", "é", "日本語 のテキスト", "a", "x " * 3000, "A B　c  d\r\n\r\ne", "the CAT sat"]


def docs_of(spark, rows):
    """(doc_id, text, lang, source, n_chars, node, held): some columns clash with names that operators use."""
    full = [(i, t, ["en", "de", None][i % 3] if i is not None else None, f"s{(i or 0) % 4}", len(t or ""), "x", i) for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, node string, held long")


@pytest.fixture(scope="module")
def docs(spark):
    base = texts()
    rows = list(enumerate(base + ODD + base[:5]))
    return docs_of(spark, rows + [rows[3], rows[3], (None, "no id"), (None, None)])


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


def low(text, pattern):
    return re.findall(pattern, bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()))


ALNUM, SPACED = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", rb"[^\x20\x09-\x0D]+"


def test_word_hashes_tell_words_apart():
    import pyarrow as pa

    column = pa.array(texts() + ODD)
    seen, back = {}, {}
    for a, b, hashes, counts in textscan.word_hashes(column, textscan.ALNUM, size=500):
        at = np.concatenate([[0], np.cumsum(counts)])
        for i in range(b - a):
            want = low(column[a + i].as_py(), ALNUM)
            got = hashes[at[i] : at[i + 1]].tolist()
            assert len(got) == len(want)
            for w, h in zip(want, got, strict=True):
                assert seen.setdefault(w, h) == h and back.setdefault(h, w) == w


def op1_rows(found):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found.collect()), key=lambda r: r[:3])


def test_op1_counts_and_scores(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i, _ in rows}
    count = collections.Counter(w for i, t in rows if fold[i] != 1 for w in [*low(t, SPACED), None])
    total, distinct = sum(count.values()), len(count)
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, len(low(r[1], SPACED))))
    for most in (10**9, 7, 0):
        model, counts = lm_maxent.train(docs.where(q.fold_of() != 1), table_tokens=most)
        assert model.line.n_table <= most and (model.line.rare > 0) == (most < distinct)
        for (_, t), x in zip(want, op1_rows(lm_maxent.score(docs, model, counts)), strict=True):
            words = [*low(t, SPACED), None]
            base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
            assert x[2:5] == (len(words), sum(count[w] > 0 for w in words), total) and abs(x[5] - base) < 1e-6 and x[6] < 0
    empty, counts = lm_maxent.train(none)
    assert lm_maxent.score(none, empty, counts).count() == 0
    assert all(r[5] == 0 == round(r[6], 6) and r[3] == r[4] == 0 for r in op1_rows(lm_maxent.score(docs, empty, counts)))


def test_op1_does_not_depend_on_partitions(docs):
    """The same bits for any layout of the training table, with several learners."""
    want = None
    for n in (1, 4, 16):
        model, counts = lm_maxent.train(docs.repartition(n, F.rand(n)), learner_tokens=600)
        got = op1_rows(lm_maxent.score(docs.repartition(n), model, counts))
        want = want or got
        assert got == want and np.abs(model.weights.rows).sum() > 0


def brute_paths(model, found, counts):
    """log10 probability of every token's path, step by step: a softmax over all classes inside a class."""
    c, w = model.classes, model.weights
    leaf = model.known(found)[1]
    h = lm_maxent.features(lm_maxent.histories(c.names(leaf), counts))
    out = []
    for i, own in enumerate(leaf.tolist()):
        p = 1.0
        for level in range(model.line.levels):
            width = lm_maxent.BRANCH ** (model.line.levels - level)
            inside = c.mass[own // width * width : (own // width + 1) * width].reshape(lm_maxent.BRANCH, -1).sum(axis=1)
            if level >= c.depth[own]:
                break
            node = own // width + sum(lm_maxent.BRANCH**j for j in range(level))
            z = [math.log(x / inside.sum()) if x else -80.0 for x in inside]
            for j in range(4 if level < lm_maxent.WIDE else 2):
                row = ((int(h[j, i]) ^ ((node + 1) * 0x9E3779B97F4A7C15) % 2**64) * 0xD6E8FEB86659FD93) % 2**64 >> (64 - w.bits)
                z = [x + float(y) for x, y in zip(z, w.rows[row], strict=True)]
            e = [math.exp(x) for x in z]
            p *= e[own // (width // lm_maxent.BRANCH) % lm_maxent.BRANCH] / sum(e)
        out.append(math.log10(p))
    return out


def test_op1_scores_are_softmaxes(docs):
    import pyarrow as pa

    model, counts = lm_maxent.train(docs, learner_tokens=600)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = []
    for i, t in rows:
        (_, _, found, n), = lm_maxent.tokens(pa.array([t], pa.string()))
        count, leaf = model.known(found)
        assert (count > 0).all()
        paths = np.array(brute_paths(model, found, n))
        assert np.abs(model.log_paths(leaf, n) - paths).max() < 1e-4
        want.append((i is None, i or 0, len(found), float((paths + np.log10((count + 0.5) / model.classes.mass[leaf])).sum())))
    got = op1_rows(lm_maxent.score(docs, model, counts))
    for x, y in zip(sorted(want), got, strict=True):
        assert x[:3] == y[:3] and abs(x[3] - y[6]) < 1e-3 * max(1, x[2])


@pytest.mark.parametrize("most", [10**9, 7])
def test_op1_is_a_distribution(docs, most):
    """All tokens of the whole vocabulary, and unseen ones, together have probability one after any history."""
    model, counts = lm_maxent.train(docs, table_tokens=most)
    c = model.classes
    have = counts.toPandas()
    found, n = have["token"].to_numpy().view(np.uint64), have["n"].to_numpy()
    history = found[np.argsort(-n)][:2]
    leaf = np.array([model.known(np.array([t]))[1][0] for t in found])
    # An unseen token for every class that one may have.
    free = np.arange(model.line.first_rare, model.line.n_leaves)
    total = 0.0
    for own, k in [*zip(leaf.tolist(), n.tolist(), strict=True), *((x, 0) for x in free.tolist())]:
        path = c.names(np.array([*model.known(history)[1], own], np.int32))
        assert path.shape == (2, 3)
        s = model.log_paths(np.array([*model.known(history)[1], own], np.int32), np.array([3]))[-1]
        total += 10 ** (s - c.log_mass[own] + math.log10(k + 0.5))
    assert abs(total - 1) < 1e-3


def test_op1_beats_the_base_on_held_out_text(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = WORDS[:8] if i % 2 else WORDS[8:16]
        rows.append((i, " ".join(rng.choice(words, 80))))
    docs = docs_of(spark, rows)
    model, counts = lm_maxent.train(docs.where("doc_id < 300"))
    s = lm_maxent.score(docs.where("doc_id >= 300"), model, counts).agg(F.sum("base_score"), F.sum("score")).first()
    assert s[1] > s[0] * 0.9


def test_op2_round_trip(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(q.tokenizer_path())
    tokenizer.encode_special_tokens = True
    manifest = bitpack.write_token_ids(docs, q.tokenizer_path(), shard_bytes=2000)
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "") for r in docs.collect()))
    want = [(r[1] if r[0] else None, [*tokenizer.encode(r[3], add_special_tokens=False).ids, 0]) for r in rows]
    got = sorted(bitpack.token_digests(manifest).collect(), key=lambda r: r.start)
    start = 0
    for (i, ids), r in zip(want, got, strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    back = collections.Counter((r.doc_id, tuple(r.ids)) for r in bitpack.read_token_ids(manifest).collect())
    assert back == collections.Counter((i, tuple(ids)) for i, ids in want)
    assert bitpack.token_digests(bitpack.write_token_ids(none, q.tokenizer_path())).count() == 0
    path = manifest.first()["path"]
    file = bitpack.Reader(path)
    assert file.width == 16 and file.document(0).tolist() in [ids for _, ids in want]


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_op2_packing(width, tmp_path):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1000).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(ids, width), width, 1000) == ids).all()
    assert len(bitpack.pack(ids, width)) == -(-1000 * width // 8)
    out = bitpack.Writer(f"file://{tmp_path}/x.ids", width, 64)
    out.add(np.arange(4), np.ones(4, bool), ids, np.array([0, 500, 1, 499]))
    out.close()
    file = bitpack.Reader(f"file://{tmp_path}/x.ids")
    assert [len(file.document(i)) for i in range(4)] == [0, 500, 1, 499] and (file.ids(100, 700) == ids[100:700]).all()
    with pytest.raises(ValueError):
        bitpack.pack(np.array([1 << width], np.uint64), width) if width < 32 else bitpack.pack(np.array([1 << 33], np.uint64), 32)


def brute_contamination(rows, items):
    windows = collections.defaultdict(set)
    for i, t in items:
        w = low(t, ALNUM)
        m = min(13, len(w))
        for s in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[s : s + m])].add("" if i is None else str(i))
    out = []
    for i, t in rows:
        w, hit, found = low(t, ALNUM), set(), set()
        for m in {len(k) for k in windows}:
            for s in range(len(w) - m + 1):
                if tuple(w[s : s + m]) in windows:
                    hit |= set(range(s, s + m))
                    found |= windows[tuple(w[s : s + m])]
        out.append((i, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def test_op3_is_exact(spark, docs, none):
    base = texts()
    items = [(1, " ".join(base[0].split()[:20])), (2, base[1].upper()), (10, "cat sat"), (3, None), (4, ""), (None, " ".join(base[5].split()[-15:])), (2, base[1]), (7, "x " * 50), (8, "é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(brute_contamination(rows, items), key=repr)
    for size in (1 << 20, 20):
        blocks = winnow.BLOCK_BYTES
        winnow.BLOCK_BYTES = size
        try:
            found = winnow.contamination(docs, bench)
        finally:
            winnow.BLOCK_BYTES = blocks
        assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found.collect()), key=repr) == want
        for r in found.collect():
            assert sum(s.end - s.start for s in r.spans) == r.n_hit
    kept = winnow.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not x[4] for x in want)
    assert winnow.contamination(none, bench).count() == 0
    assert winnow.contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_op3_many_blocks_are_each_indexed_once(spark, docs, monkeypatch, tmp_path):
    base = texts()
    items = [(i, " ".join(t.split()[:40])) for i, t in enumerate(base)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    paths = winnow.write_blocks(bench, spark, block_bytes=200)
    assert len(paths) > 3 and len(set(paths)) == len(paths)
    # What a worker keeps is bounded: with no room it reads each block once for a batch.
    reads = []
    whole = winnow.storage.filesystem
    monkeypatch.setattr(winnow.storage, "filesystem", lambda uri: reads.append(uri) or whole(uri))
    batch = pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows], pa.string())})
    for held, again in ((winnow.HELD_BYTES, 0), (0, len(paths))):
        monkeypatch.setattr(winnow, "HELD_BYTES", held)
        winnow._held.clear()
        first = winnow.judge(batch, "text", paths)
        reads.clear()
        second = winnow.judge(batch, "text", paths)
        assert len(reads) <= again and second[2] == first[2] and (second[1] == first[1]).all()
    monkeypatch.undo()
    found = winnow.contamination(docs, bench, block_bytes=200).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found), key=repr) == sorted(brute_contamination(rows, items), key=repr)


def test_op3_fingerprints_keep_the_guarantee():
    rng = np.random.default_rng(2)
    for _ in range(50):
        g = rng.integers(0, 5, rng.integers(1, 40)).astype(np.uint64)
        mark = winnow.fingerprints(g, 7)
        assert all(mark[i : i + 7].any() for i in range(max(1, len(g) - 6)))


def test_op4_recall_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:160] = x[100]
    x[0] = x[20] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[7], (1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0] * 5), (None, x[1].tolist()), (1080, [None] * 16), (1100, [float("inf")] * 16)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    found = collections.defaultdict(list)
    for r in onebit_ann.nearest(df).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 600, 20))
    hits = 0
    for i, got in found.items():
        s = x.astype(np.float64) @ x[i].astype(np.float64)
        order = [int(j) for j in np.lexsort((np.arange(600), -np.round(s, 9))) if j != i][:20]
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21)) and all(abs(s[g[1]] - g[2]) < 1e-9 for g in got)
        hits += len(set(order) & {g[1] for g in got})
    assert hits / (20 * len(found)) >= 0.9
    assert [g[1] for g in found[0]][:3] == [20, 100, 101]
    assert onebit_ann.nearest(df.limit(0)).count() == 0
    assert onebit_ann.nearest(df.where("vec_id in (20, 21)")).count() == 1


def test_op4_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(500, 64)), rng.normal(size=(40, 64))
    turn, centre = onebit_ann.rotation(64), x.mean(axis=0)
    estimate, bound = onebit_ann.estimates(*onebit_ann.encode(x, centre, turn), y, centre, turn)
    assert (np.abs(estimate - x @ y.T) <= bound).mean() > 0.93 and abs((estimate - x @ y.T).mean()) < 0.2


def test_op5_accuracy_and_edges(spark, docs, none):
    rng = np.random.default_rng(9)
    own = {"en": "th he in er an re nd on", "de": "en er ch de ei ie un ge", "fr": "es le de en re ai ou qu"}
    rows = [(i, "".join(rng.choice(own[lang].split()) + (" " if rng.random() < 0.3 else "") for _ in range(60)), lang) for i, lang in enumerate(list(own) * 60)]
    rows += [(1000, None, "en"), (1001, "123 !!", "de"), (1002, "", None), (1003, "ñ", None)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    model = langid_kernel.train(df, learn=q.fold_of() != 0)
    found = {r.doc_id: r for r in langid_kernel.identify(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[0] < 1000]
    assert sum(found[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.95
    assert found[1000].lang_pred == found[1001].lang_pred == found[1002].lang_pred == "und" and found[1003].lang_pred in own
    assert all(0 <= r.score <= 1 for r in found.values())
    kept = langid_kernel.accepted(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0
    assert langid_kernel.train(none) is None
    assert langid_kernel.identify(docs, None).where("lang_pred <> 'und'").count() == 0 and langid_kernel.identify(none, model).count() == 0


def test_op5_presence_is_the_kernel():
    import pyarrow as pa

    raw, at = textscan.string_buffers(pa.array(["abab", "", "AB"]))
    x = langid_kernel.presence(raw, at)
    assert x.sum(axis=1).tolist() == [2 + 2 + 2, 0, 2 + 1]
    k = langid_kernel.normalised(x) @ langid_kernel.normalised(x).T
    assert abs(k[0, 2] - 3 / math.sqrt(18)) < 1e-6 and k[1].sum() == 0


URLS = [None, "", "no scheme", "http://Blog.Example.COM/en/71?x", "https://example.com/en/8#y", "http://a.net/de/1", "http://example.net/de/81", "http://example.net/de/7", "http://notorg/es/1", "http://x.org/es/", "http://org", "http://a.com:80/en/1", "ftp://com/en/", "http://com?/en/", "http://x.com/EN/1"]


def test_op5_is_kernel_ridge_regression_where_all_rows_are_landmarks():
    rng = np.random.default_rng(6)
    y = np.repeat(np.arange(3), 20)
    x = rng.random((60, langid_kernel.DIM)) < 0.002
    x[np.arange(60), y] = True
    bits = [r.tobytes() for r in np.packbits(x, axis=1)]
    model = langid_kernel.fit(bits, ["abc"[i] for i in y], landmarks=20)
    norm = langid_kernel.normalised(x)
    kernel = (norm @ norm.T).astype(float)
    dense = np.linalg.solve(kernel + langid_kernel.RIDGE * 60 * np.eye(60), np.eye(3)[y])
    got = (norm @ model.landmarks) @ model.coefficients
    assert np.abs(got - kernel @ dense).max() < 0.02


def test_op5_many_languages_stay_within_bounds(monkeypatch):
    monkeypatch.setattr(langid_kernel, "ALL_LANDMARKS", 10)
    rng = np.random.default_rng(7)
    for n in (3, 25):
        y = np.arange(100) % n
        x = np.zeros((100, langid_kernel.DIM), bool)
        for j in range(3):
            x[np.arange(100), 3 * y + j] = True
        x |= rng.random(x.shape) < 0.0002
        model = langid_kernel.fit([r.tobytes() for r in np.packbits(x, axis=1)], [f"l{i:02d}" for i in y])
        assert model.landmarks.shape[1] <= 10 and len(model.languages) == n


def test_op6_files_and_stores_that_cannot_be_mapped(spark, monkeypatch):
    rules = [(f"h{i % 40}.example", f"/p{i}", "block" if i % 3 else "allow") for i in range(300)] + [("h1.example", "", "block")]
    manifest = url_digest.write_rules(url_digest.rules_table(spark, rules), shard_rules=50)
    held = sorted(manifest.collect(), key=lambda r: r["first"])
    assert len(held) > 3 and sum(r["n_rules"] for r in held) == 301
    files, firsts = [r["path"] for r in held], np.array([int(r["first"]) for r in held], np.uint64)
    lengths = sorted({n for r in held for n in r["lengths"]})
    urls = [f"http://www.{h}{p}/x" for h, p, _ in rules]
    mapped = url_digest.judge(urls, files, firsts, lengths)
    assert mapped[2][:300] == [max((h + p for h, p, _ in rules if u[11:].startswith(h + p)), key=len) for u in urls[:300]]
    # The same bytes by another way of naming the store.
    whole = url_digest.storage.filesystem
    monkeypatch.setattr(url_digest, "HELD_BYTES", 0)
    monkeypatch.setattr(url_digest.storage, "filesystem", lambda uri: whole(uri.replace("other:", "file:")))
    url_digest._mapped.clear()
    assert url_digest.judge(urls, [f.replace("file:", "other:") for f in files], firsts, lengths) == mapped
    url_digest._mapped.clear()


def test_op6_against_rules_one_by_one(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "x"), (None, URLS[4], "y")], "page_id long, url string, rule string")
    rules = [*q.URL_RULES, ("com", "/en/", "block"), ("", "/x", "block")]
    found = url_digest.filtered(pages, url_digest.write_rules(url_digest.rules_table(spark, rules), shard_rules=2)).collect()
    assert len(found) == len(URLS) + 2
    for r in found:
        url = URLS[r.page_id] if r.page_id is not None else URLS[4]
        host, path = url_digest.split_url(url)
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in q.URL_RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want = max(fit) if fit else (0, 0, None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, want[2], want[3])
    assert url_digest.filtered(pages.limit(0), url_digest.write_rules(url_digest.rules_table(spark, rules))).count() == 0
    assert url_digest.filtered(pages, url_digest.write_rules(url_digest.rules_table(spark, []))).where("verdict <> 'allow' or rule is not null").count() == 0


def test_op6_collisions_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(url_digest.xxhash, "xxh64_intdigest", lambda data: 5)
    rows = np.array([5, 5], "<u8")
    rules = url_digest.Rules.__new__(url_digest.Rules)
    rules.n, rules.keys = 2, rows
    texts = [b"a.b\n/x", b"c.d\n/y"]
    rules.at, rules.verdicts, rules.texts = np.array([0, 6, 12]), np.array([1, 0], np.uint8), np.frombuffer(b"".join(texts), np.uint8)
    monkeypatch.setattr(url_digest, "_rules", lambda path: rules)
    assert url_digest.judge(["http://c.d/yes", "http://e.f/yes"], ["f"], np.array([0], np.uint64), [2])[2:] == (["c.d/y", None], ["allow", "allow"])


def test_op7_rates_copies_and_order(spark, docs, none):
    rows = [(i, "t", "en", "big" if i % 3 else "small", 1, "x", i) for i in range(3000)]
    df = spark.createDataFrame(rows, docs.schema)
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0)], "source string, weight double")
    got = poisson_mix.replicated(df, weights=weights).cache()
    n = {r.source: r.n for r in got.groupBy("doc.source").agg(F.count("*").alias("n")).collect()}
    assert abs(n["small"] / (n["small"] + n["big"]) - 0.75) < 0.04 and abs(sum(n.values()) - 3000) < 250
    again = {(r.doc.doc_id, r.copy) for r in poisson_mix.replicated(df.repartition(5), weights=weights).collect()}
    assert again == {(r.doc.doc_id, r.copy) for r in got.collect()}
    counts = collections.Counter(r.doc.doc_id for r in got.where("doc.source = 'small'").collect())
    rate = got.where("doc.source = 'small'").first()["rate"]
    for k in range(5):
        share = sum(counts.get(i, 0) == k for i in range(0, 3000, 3)) / 1000
        assert abs(share - poisson_mix.poisson_probability(rate, k)) < 0.06
    large = poisson_mix.replicated(df.where("source = 'small'"), total=40_000.0)
    assert abs(large.count() - 40_000) < 1500
    mixed = poisson_mix.mixture(docs)
    assert mixed.columns == docs.columns and poisson_mix.mixture(none).count() == 0
    keys = [r.shuffle_key for r in poisson_mix.shuffled(got).collect()]
    assert keys == sorted(keys)


def test_op8_spellings_lines_and_whole_texts(spark):
    mit = license_digest.LICENSES[10][1]
    rows = [mit, mit.replace("<year> <holders>", "2020 A. Person").upper().replace(" ", "\n"), "Copyright 2021 me\n" + mit.split("\n", 3)[3], "prose\n  RELEASED under the MIT Licence!!  \nmore", "released under the mit license of no kind", "", None, "---", "Permission is hereby granted"]
    df = spark.createDataFrame(list(enumerate(rows)) + [(3, rows[3])], "doc_id long, text string").withColumn("digest", F.lit(1))
    found = sorted(license_digest.scan(df, license_digest.known_licenses(spark)).collect(), key=lambda r: r.doc_id)
    assert len(found) == 10
    by = {r.doc_id: r for r in found}
    assert by[0].license_id == "MIT" and by[0].notices == ["MIT"]
    assert by[3].license_id is None and by[3].notices == ["MIT"]
    assert by[4].notices == [] and by[4].license_id is None and by[6].digest is None and by[5].digest is None and by[7].digest is None
    assert license_digest.scan(df, license_digest.known_licenses(spark), broadcast_licenses=0).where("license_id = 'MIT'").count() == 1
    assert license_digest.scan(df.limit(0), license_digest.known_licenses(spark)).count() == 0


def test_op8_knows_long_licenses_whole(spark):
    folder = "/usr/share/common-licenses"
    names = [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("BSD", "BSD-3-Clause")]
    held = [(name, open(f"{folder}/{file}", encoding="utf-8").read()) for file, name in names if os.path.exists(f"{folder}/{file}")]
    if not held:
        pytest.skip("no license texts on this machine")
    # Upper case, other blanks and another copyright line are the same license; a word less is not.
    rows = [(f"{name}/{i}", t) for name, text in held for i, t in enumerate([text, "Copyright 2020 A. Person\n" + text.upper(), text.replace(" ", "  "), text.rstrip().rsplit(None, 1)[0]])]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    for bound in (license_digest.BROADCAST_LICENSES, 0):
        found = license_digest.scan(df, license_digest.known_licenses(spark), digests=license_digest.whole_texts(spark), broadcast_licenses=bound)
        assert [(r.doc_id, r.license_id) for r in found.collect() if r.license_id != (None if r.doc_id.endswith("/3") else r.doc_id.split("/")[0])] == []
    bare = [(name, text.split("\n\n", 1)[1]) for name, text in license_digest.LICENSES if text.startswith(f"{name} License\n\n")]
    found = license_digest.scan(spark.createDataFrame(bare, "doc_id string, text string"), license_digest.known_licenses(spark), digests=license_digest.whole_texts(spark))
    assert sorted((r.doc_id, r.license_id) for r in found.collect()) == [("ISC", "ISC"), ("MIT", "MIT")]


def test_op5_without_labels_texts_with_letters_stay(spark, docs):
    kept = langid_kernel.accepted(docs, langid_kernel.train(docs.withColumn("lang", F.lit(None).cast("string"))))
    want = [r.text for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == sorted(want) and want


def brute_classes(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = low(t, ALNUM)
        m = min(5, len(w))
        sets[i] = {k: 1 + math.log(v) for k, v in collections.Counter(tuple(w[s : s + m]) for s in range(len(w) - m + 1 if w else 0)).items()}
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, t in rows:
        for j, u in rows:
            if j < i and t:
                a, b = sets[i], sets[j]
                s = sum(min(a[k], b[k]) for k in a if k in b)
                if t == u or (a and b and s / (sum(a.values()) + sum(b.values()) - s) >= 0.8):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def test_op9_classes_are_those_of_all_pairs(spark, docs, none):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for _ in range(6):
            copy = list(words)
            for at in rng.integers(0, 200, rng.integers(0, 8)):
                copy[at] = f"v{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, t) for i, t in enumerate(ODD + ODD[5:])]
    df = docs_of(spark, rows)
    got = {r.doc_id: r.class_id for r in dartminhash.classes(df).collect()}
    want = brute_classes(rows)
    for i in got:
        if not rows[i][1]:
            want[i] = i
    assert sum(got[i] != want[i] for i in got) == 0
    kept = dartminhash.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))
    assert dartminhash.classes(none).count() == 0 and dartminhash.deduplicated(none).count() == 0
    # Repeated rows and missing ids: one row of each class stays, texts without content all stay.
    left = collections.Counter((r.doc_id, r.text) for r in dartminhash.deduplicated(docs).collect())
    have = sorted({(r.doc_id is None, r.doc_id or 0, r.text) for r in docs.where("text <> ''").collect()})
    of = brute_classes(list(enumerate(t for *_, t in have)))
    stay = collections.Counter((None if have[i][0] else have[i][1], have[i][2]) for i in set(of.values()))
    assert left == stay + collections.Counter((r.doc_id, r.text) for r in docs.where("text is null or text = ''").collect())


def test_op9_variants_of_a_hub_are_one_class(spark):
    """Each variant is near the hub alone, which has the highest id."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = list(base)
        for at in 10 + 45 * np.arange(4) + rng.integers(0, 40, 4):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    rows.append((len(rows), " ".join(base)))
    near = [dartminhash._packed(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0] for _, t in rows]
    assert all(dartminhash.similarity(x, near[-1]) >= 0.8 for x in near) and dartminhash.similarity(near[0], near[1]) < 0.8
    assert {r.class_id for r in dartminhash.classes(docs_of(spark, rows)).collect()} == {0}


def variants(groups, size, least, most, seed):
    """Groups of texts of 200 words with some words changed."""
    rng = np.random.default_rng(seed)
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(200)]
        for i in range(size):
            words = list(base)
            for at in rng.choice(200, rng.integers(least, most + 1), replace=False):
                words[at] = f"v{i}x{at}"
            yield " ".join(words)


@pytest.mark.parametrize("groups, size, least, most", [(3, 100, 1, 4), (3, 100, 2, 5), (1, 500, 2, 5)])
def test_op9_dense_groups(spark, groups, size, least, most):
    """Groups of variants, of which many are near to few others: the classes of all pairs, in any layout."""
    rows = list(enumerate(variants(groups, size, least, most, 10 * least + most)))
    df = docs_of(spark, rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one, other = (sorted(map(tuple, dartminhash.classes(df.repartition(n)).collect())) for n in (4, 24))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert one == other
    got, want = {r[0]: r[3] for r in one}, brute_classes(rows)
    assert got == want
    # Links to the representative of each class.
    packed = {i: dartminhash._packed(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0] for i, t in rows}
    head = {r[2]: r[0] for r in one if r[1] == r[2]}
    near = {r[0]: dartminhash.similarity(packed[r[0]], packed[head[r[2]]]) >= 0.8 for r in one if r[1] != r[2]}
    assert all(r[4] == near[r[0]] for r in one if r[1] != r[2])
    assert all(r[4] == sum(near[x[0]] for x in one if x[2] == r[2] and x[1] != r[2]) for r in one if r[1] == r[2])


def test_op9_blocks_join_what_all_pairs_join(monkeypatch):
    """Nodes in one bucket, alone or as pairs of blocks, with repeated shingles: the components of all pairs."""
    monkeypatch.setattr(dartminhash, "_SIDE", 20)
    monkeypatch.setattr(dartminhash, "_CELLS", 500)
    rng = np.random.default_rng(4)
    texts = [t + " again and again" * int(rng.integers(0, 30)) for t in variants(2, 40, 1, 6, 7)]
    held = [dartminhash._packed(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]), 5)[0] for t in texts]
    exact = np.array([[dartminhash.similarity(a, b) for b in held] for a in held])
    levels = [dartminhash._levels(x) for x in held]
    assert np.abs(dartminhash.nearness(levels, levels) - exact).max() < 1e-4
    bands = np.stack([rng.integers(0, 2, len(held)), np.full(len(held), 77)], axis=1)

    def parts(links):
        group = list(range(len(held)))
        for a, b in links:
            group = [group[b] if x == group[a] else x for x in group]
        return {frozenset(i for i, x in enumerate(group) if x == g) for g in group}

    want = parts([(i, j) for i in range(len(held)) for j in range(i) if exact[i, j] >= 0.8])
    labels, everyone = np.arange(len(held)), np.arange(len(held))
    later = dartminhash.joined(77, everyone, everyone, labels, np.stack([everyone, bands[:, 1]], axis=1), held, 0.8)
    assert parts(later) == want and len(later) == len(held) - len(want)
    halves = everyone[:37], everyone[37:]
    apart = [link for x, y in ((halves[0], halves[0]), (halves[0], halves[1]), (halves[1], halves[1])) for link in dartminhash.joined(77, x, y, labels, np.stack([everyone, bands[:, 1]], axis=1), held, 0.8)]
    assert parts(apart) == want
    # Pairs that share an earlier bucket are left to it.
    assert all(bands[i, 0] != bands[j, 0] for i, j in dartminhash.joined(77, everyone, everyone, labels, bands, held, 0.8))


def test_op9_missing_and_shared_ids_keep_unrelated_texts(spark):
    x = " ".join(f"x{i}" for i in range(100))
    near = x.replace("x50 ", "y ")
    other, third = (" ".join(f"{c}{i}" for i in range(100)) for c in "pq")
    # Unrelated texts without id; two texts under 5; near texts without ids; one of them repeated; a near pair with one id.
    rows = [(None, other), (None, third), (None, x), (None, near), (None, near), (5, "one two three"), (5, "four five six"), (5, "four five six"), (7, other + " z"), (None, None), (None, "")]
    df = docs_of(spark, rows)
    kept = sorted((str(r.doc_id), r.text or "") for r in dartminhash.deduplicated(df).collect())
    least = min((x, near), key=lambda t: hashlib.md5(t.encode()).digest())
    assert kept == sorted([("7", other + " z"), ("None", third), ("None", least), ("5", "one two three"), ("5", "four five six"), ("None", ""), ("None", "")])
    labels = {r.node: r.label for r in dartminhash.classes(df).where("node is not null").collect()}
    assert len(set(labels.values())) == 5


def test_op9_signature_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    a = {int(x): float(w) for x, w in zip(rng.integers(1, 2**50, 200), 1 + 3 * rng.random(200), strict=True)}
    b = dict(list(a.items())[:150])
    b |= {k: v * 0.6 for k, v in list(b.items())[:50]}
    s = sum(min(a.get(k, 0), b.get(k, 0)) for k in a) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a)
    row = np.concatenate([np.zeros(len(a), int), np.ones(len(b), int)])
    sig = dartminhash.signatures(row, np.array([*a, *b], np.uint64), np.array([*a.values(), *b.values()]), 3, 3000)
    assert abs((sig[0] == sig[1]).mean() - s) < 0.03 and not sig[2].any()


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (12, 11), (7, 7), (20, 19), (19, 18), (18, 1)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([1, 2, 3, 4, 5, 18, 19, 20], 1), **dict.fromkeys([10, 11, 12], 10)}


def test_op10_archives(spark):
    rows = [(i, f"http://x/{i}", ["same", "other é", None, ""][i % 4]) for i in range(20)] + [(100, "http://y\r\nz", "x" * 200_000), (3, "http://x/3", ""), (None, "u", "same"), (None, None, "alone")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    manifest = warc_shards.write_archives(pages, file_bytes=500, range_bytes=100_000)
    found = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc_shards.read_archives(manifest, payload=False).collect())
    last = {}
    for i, _, h in rows:
        last[h or ""] = max((x for x in (last.get(h or ""), i) if x is not None), default=None)
    want = collections.Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        to = last[h or ""]
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to == i else "revisit", None if to == i else to)] += 1
    assert found == want
    whole = {r.payload.decode() for r in warc_shards.read_archives(manifest).collect() if r.payload is not None}
    assert whole == {h or "" for *_, h in rows}
    again = warc_shards.write_archives(pages.repartition(7), file_bytes=500, range_bytes=100_000)
    assert [r.sha256 for r in manifest.orderBy("shard", "file").collect()] == [r.sha256 for r in again.orderBy("shard", "file").collect()]
    assert warc_shards.read_archives(warc_shards.write_archives(pages.limit(0))).count() == 0
    small = warc_shards.read_archives(warc_shards.write_archives(pages, min_revisit_bytes=5)).where("record_type = 'revisit' and payload_bytes < 5").count()
    assert small == 0


@pytest.mark.parametrize("name", sorted(q.oracles()))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    from compare import rows

    got = q.queries()[name](spark, sf_dir)
    want = duck.sql(q.oracles()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_pipeline_stage_by_stage(spark, sf_dir, none):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in p.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == columns, name
        if name == "language_id":
            letters = {r.doc_id for r in before.collect() if any(c.isalpha() for c in r.text or "")}
            assert {r.doc_id for r in after.collect()} == letters
        if name == "near_dedup":
            want = brute_classes([(r.doc_id, r.text) for r in before.collect()])
            assert {r.doc_id for r in after.collect()} == set(want.values())
        if name == "decontaminate":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            judged = brute_contamination([(r.doc_id, r.text) for r in before.collect()], items)
            assert {r.doc_id for r in after.collect()} == {x[0] for x in judged if not x[4]}
        before = after
    tokens = p.STAGES[-1][1](spark, before, sf_dir)
    assert tokens.count() == before.count() > 0
    empty = none.select(columns)
    for _, stage in p.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_pipeline_leaves_out_texts_whose_language_cannot_be_told(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    unsure = [(10**9, "zqx"), (10**9 + 1, "ZZQX JJKQ!! " * 50), (10**9 + 2, "の漢字"), (10**9 + 3, "1234 ... 5678")]
    more = docs.unionByName(spark.createDataFrame([(i, t, None, "src1", len(t)) for i, t in unsure], "doc_id long, text string, lang string, source string, n_chars long").select([F.col(c).cast(k) for c, k in docs.dtypes]))
    kept = p.language_id(spark, more, sf_dir)
    assert kept.where(F.col("doc_id") >= 10**9).count() == 0
    clear = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert {r.doc_id for r in kept.collect()} == clear


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_regular_words_do_not_collide():
    import pyarrow as pa

    word = thue_morse(12)
    other = word.translate(str.maketrans("ab", "ba"))
    long = "q" * (textscan._SEGMENT * 2 + 5)
    column = pa.array([f"{word} {long}", other, "x", long[:-1] + "r", long])
    hashes = np.concatenate([h for _, _, h, _ in textscan.word_hashes(column, textscan.ALNUM)])
    assert len(set(hashes.tolist())) == 5 and hashes[1] == hashes[5]


def test_op2_encodes_regular_and_long_pieces_as_the_library_does():
    from tokenizers import Tokenizer

    path = q.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = np.random.default_rng(3)
    word = thue_morse(10)
    rows = [word, word.translate(str.maketrans("ab", "ba")), "", f"x {word} {word}y\n{word}", "a" * 17 + " " + "a" * 16 + " " + "a" * 15 + "b", " ".join("".join(rng.choice(list("abcé日 \n\t.0<|>"), rng.integers(1, 30))) for _ in range(3000))]
    data = [t.encode() for t in rows]
    at = np.cumsum([0, *map(len, data)])
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in rows]
    code = bitpack.Encoder(path)
    for whole in (True, False, False):
        code.cut = not whole
        ids, n = code.encode(np.frombuffer(b"".join(data), np.uint8), at)
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    code.release()


@pytest.fixture(scope="module")
def very_long(spark):
    """Texts of over 4 MB: words, and one word without a break."""
    rng = np.random.default_rng(12)
    words = " ".join(f"w{x}" for x in rng.integers(0, 3000, 800_000))
    return [words, "z" * 2_500_000, "short one", words + " end"]


def test_very_long_texts(spark, very_long):
    assert len(very_long[0]) > 2 * textscan.SLICE_BYTES
    df = docs_of(spark, list(enumerate(very_long)))
    counts = [len(t.split()) for t in very_long]
    model, table = lm_maxent.train(df)
    assert [r.n_tokens for r in lm_maxent.score(df, model, table).orderBy("doc_id").collect()] == [n + 1 for n in counts]
    bench = spark.createDataFrame([(1, " ".join(very_long[0].split()[-20:]))], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in winnow.contamination(df, bench).orderBy("doc_id").collect()] == [(counts[0], 20), (1, 0), (2, 0), (counts[3], 20)]
    assert [r.class_id for r in dartminhash.classes(df).orderBy("doc_id").collect()] == [0, 1, 2, 0]
    digests = bitpack.token_digests(bitpack.write_token_ids(df, q.tokenizer_path())).orderBy("doc_id").collect()
    assert [r.doc_id for r in digests] == [0, 1, 2, 3] and digests[3].start == sum(r.n_tokens for r in digests[:3])
    found = license_digest.scan(df, license_digest.known_licenses(spark)).orderBy("doc_id").collect()
    assert [r.doc_id for r in found] == [0, 1, 2, 3] and len({r.digest for r in found}) == 4


def test_op9_signatures_do_not_depend_on_the_cells_at_a_time(monkeypatch):
    rng = np.random.default_rng(7)
    row = np.sort(rng.integers(0, 40, 3000))
    element, weight = rng.integers(0, 2**50, 3000).astype(np.uint64), 1 + 2 * rng.random(3000)
    want = dartminhash.signatures(row, element, weight, 41, 100)
    monkeypatch.setattr(dartminhash, "CELLS", 1000)
    assert (dartminhash.signatures(row, element, weight, 41, 100) == want).all()
