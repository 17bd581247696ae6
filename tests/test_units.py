"""Golden values and properties of operators and helpers."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kbspark.functions import text as T
from kbspark.functions.markdown import chunks, headings, sections
from kbspark.functions.places import numbered
from kbspark.functions.text import common_lines
from kbspark.functions import titles, words
from kbspark.functions.words import Grams, trigram_list, word_similarity
from kbspark.operators import corpus, curate, evidence, folders, links, review, search, usage, vectors
from kbspark.operators.curate import fingerprint
from kbspark.sources import bundle


def col(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()[0]


def test_query_terms(spark):
    assert col(spark, "Hello World hello", T.query_terms) == ["hello", "world"]
    assert col(spark, "知识库，检索 pg", T.query_terms) == ["知识", "识库", "检索", "pg"]
    assert col(spark, "数", T.query_terms) == ["数"]
    assert len(col(spark, " ".join(f"w{i}" for i in range(50)), T.query_terms)) == 24
    assert col(spark, "...", T.query_terms) == []


def test_query_parse(spark):
    raw = ['索引优化 tag:pg status:draft', "hashtag:x filetype:pdf 检索", "x status:archived", 'a category:"技术/部署" tag:a tag:b type:Note', "tag: y", "", 'tag:"two words"rest tag:"open (tag:in) x', None]
    found = {r.query_id: r for r in search.query_parse(spark.createDataFrame(list(enumerate(raw)), "query_id long, raw string")).collect()}
    assert (found[0].needle, found[0].tags, found[0].status) == ("索引优化", ["pg"], "draft")
    assert found[1].needle == "hashtag:x filetype:pdf 检索" and found[1].tags == []
    assert found[2].status is None and found[2].needle == "x"
    assert (found[3].category, found[3].tags, found[3].type) == ("技术/部署", ["a", "b"], "Note")
    assert found[4].tags == [] and found[5].needle == ""
    assert found[6].tags == ["two words", '"open', "in)"] and found[6].needle == "rest ( x" and found[7].needle == ""


def test_bm25f_weights_fields(spark):
    """With all fields of mean length, the term's weight is that of its field."""
    rows = [(1, "zz cat", "aa bbb", "x" * 8), (2, "zz dog", "aa cat", "x" * 8), (3, "zz dog", "aa bbb", "xxxx cat"), (4, "zz dog", "aa bbb", "y" * 8)]
    corpus = spark.createDataFrame([(*r, [], None, "stable", "Note") for r in rows], "id long, title string, description string, body string, tags array<string>, category string, status string, type string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    parsed = search.query_parse(spark.createDataFrame([(1, "cat")], "query_id long, raw string"))
    found = {r.id: r.score for r in search.bm25f_search(parsed, corpus).collect()}
    idf = math.log(1 + (4 - 3 + 0.5) / (3 + 0.5))
    assert found == {i: round(idf * w * 2.2 / (1.2 + w), 2) for i, w in ((1, 2.0), (2, 1.25), (3, 1.0))}


def best_stretch(needle, body):
    """Over all stretches of a text, of any length."""
    want, have = set(trigram_list(needle)), trigram_list(body)
    return max((len(want & set(have[i:j])) / len(want | set(have[i:j])) for i in range(len(have)) for j in range(i + 1, len(have) + 1)), default=0.0) if want else 0.0


def test_word_similarity_agrees_with_all_stretches(monkeypatch):
    rng = random.Random(1)
    for seed in range(120):
        monkeypatch.setattr(words, "_PLACES", 20 if seed % 2 else 1 << 20)
        letters, size = rng.choice([("abcd ", 40), ("ab ", 60), ("abcdefghijk    ", 90), ("a ", 50)])
        needles = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 8, 20]))) for _ in range(6)]
        body = "".join(rng.choice(letters) for _ in range(size)) + rng.choice(["", " ab" * 12, " zz" * 20 + " abc"])
        grams, exact = Grams(body), [best_stretch(x, body) for x in needles]
        always = np.array([True, False] * 3)
        rarity = {t: rng.randrange(9) for x in needles for t in trigram_list(x)}
        got = words.Needles(needles, 0.4, rarity).word_similarities(grams, always)
        assert np.allclose(got, [x if x >= 0.4 or a else 0.0 for x, a in zip(exact, always, strict=True)], atol=1e-12)
        assert np.allclose([word_similarity(x, grams) for x in needles], exact, atol=1e-12)
        assert np.allclose(words.Needles(needles).similarities(body), [len(set(trigram_list(x)) & set(trigram_list(body))) / max(1, len(set(trigram_list(x)) | set(trigram_list(body)))) for x in needles])
    assert word_similarity("word", Grams("two words")) > 0.6
    # What stands between may be long, as long as it is of few trigrams.
    far = "red " + "zz " * 20 + "fox"
    assert abs(word_similarity("red fox", Grams(far)) - best_stretch("red fox", far)) < 1e-12 and word_similarity("red fox", Grams(far)) > 0.72
    assert word_similarity("red fox", Grams("red " + "zz " * 200_000 + "fox")) > 0.72 and word_similarity("ab", Grams("")) == 0.0


def test_blocks_of_starts_are_left_out_only_where_no_stretch_reaches_the_level(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(words, "_MANY", 1)
    kept = []
    able = words.Needles._able

    def counted(self, text, needle, at, begin, *rest):
        out = able(self, text, needle, at, begin, *rest)
        kept.append((len(begin), len(out)))
        return out

    monkeypatch.setattr(words.Needles, "_able", counted)
    for seed in range(60):
        monkeypatch.setattr(words, "_BLOCK", rng.choice([1, 3, 16]))
        monkeypatch.setattr(words, "_TOGETHER", rng.choice([2, 256]))
        letters = rng.choice(["abcd ", "abcdefghijk    ", "ab "])
        needles = ["".join(rng.choice(letters) for _ in range(rng.choice([8, 20, 30]))) for _ in range(5)]
        body = "".join(rng.choice(letters) for _ in range(90)) + rng.choice(["", needles[0][:15], " zz" * 30 + " " + needles[1]])
        exact, always = [best_stretch(x, body) for x in needles], np.array([True, False, True, False, False])
        got = words.Needles(needles, 0.4).word_similarities(Grams(body), always)
        assert np.allclose(got, [x if x >= 0.4 or a else 0.0 for x, a in zip(exact, always, strict=True)], atol=1e-12)
    assert sum(b for _, b in kept) < 0.9 * sum(a for a, _ in kept)


def test_bounds_of_stretches_hold_and_exact_ones_lie_between(monkeypatch):
    rng = random.Random(3)
    for seed in range(60):
        monkeypatch.setattr(words, "_LANES", rng.choice([1, 64, 1 << 13]))
        monkeypatch.setattr(words, "_CELLS", rng.choice([30, 1 << 24]))
        letters, size = rng.choice([("abcd ", 40), ("ab ", 60), ("abcdefghijk    ", 90), ("a ", 50), ("abcdefghijk    ", 0)])
        needles = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 8, 20, 40]))) for _ in range(6)]
        body = "".join(rng.choice(letters) for _ in range(size)) + (rng.choice(["", " ab" * 12, " zz" * 20 + " abc"]) if size else "")
        grams, index = Grams(body), words.Needles(needles, 0.4)
        met = index.met(grams)
        both = np.bincount(met[1], minlength=6)
        some = np.flatnonzero(both > 0)
        low, high = index.bounds(grams, some, met, both)
        exact = np.array([best_stretch(x, body) for x in needles])
        assert (low[some] <= exact[some] + 1e-12).all() and (high[some] >= exact[some] - 1e-12).all()
        assert np.allclose(index.exact(grams, low, both)[some], exact[some], atol=1e-12)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n ", max_size=300), st.integers(1, 60), st.integers(0, 30))
def test_chunks_cover_and_advance(body, target, overlap):
    parts = chunks(body, target, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(body)
    for (a, b), (c, d) in zip(parts, parts[1:], strict=False):
        assert a < c <= b and b <= d


def test_headings():
    assert headings("# A\n```\n# no\n```\n## B ##\n####### x\n    # code\n~~~\n# no\n~~~\n#\n") == [(0, 1, "A"), (17, 2, "B"), (59, 1, "#")]
    assert headings("plain\n#no space") == []
    assert headings("   # A #b #\n    # code\n````\n```\n# no\n`````  \n# C#\n``` a`b\n## D \\#\n~~~\n# open") == [(0, 1, "A #b"), (45, 1, "C#"), (58, 2, "D \\#")]


def test_chunks_of_a_blank_end():
    assert chunks("a\n\n\n", 1, 0) == [(0, 3), (3, 4)] and chunks("", 5, 1) == [(0, 0)]
    assert chunks("x" * 1000, 500, 80) == [(0, 500), (420, 920), (840, 1000)]


def test_sections():
    found = sections("# A\n" + "a" * 200 + "\n## A1\n" + "b" * 200 + "\n# B\n" + "c" * 200)
    assert [p for p, _ in found] == ["A", "A > A1", "B"]
    assert [p for p, _ in sections("# A\nx\n# B\ny")] == ["A | B"]
    assert len(sections("# A\n" + "\n\n".join("p" * 1000 for _ in range(9)))) == 5


def test_links(spark):
    body = "see [[A]] and [[B|alias]] ![[C]] [[ | x]] [[a]b]] [[D| ]]"
    found = links.link_extract(spark.createDataFrame([(1, body)], "id long, body string")).orderBy("pos").collect()
    assert [(r.target, r.display, r.embed) for r in found] == [("A", "A", False), ("B", "alias", False), ("C", "C", True), ("D", "D", False)]


def test_mentions(spark):
    def found(title, body):
        df = spark.createDataFrame([(1, title, "zz"), (2, "other thing", body)], "id long, title string, body string").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
        return [r.at for r in links.unlinked_mentions(df).where("target_id = 1").collect()]

    assert found("AI", "AISLE") == [] and found("AI", "about AI today") == [7]
    assert found("AI", "[[ AI ]]") == [] and len(found("AI", "[[AI]] and AI")) == 1
    assert len(found("知识", "个人知识库")) == 1 and len(found("++", "c++ x")) == 1
    # Words that follow each other elsewhere, or in another way, are no mention; characters outside the first plane count once.
    assert found("red blue car", "red blue and blue car") == [] and found("red blue", "red  blue") == [] and found("red blue car", "😀 red blue car") == [3]
    assert found("f.x (a)", "call f.x (a) now") == [6] and found("zq-1 zq", None) == [] and found("é\tx", "an é\tx") == [4]


def test_a_bundle_of_many_files_is_read_by_few_tasks(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"f{i}.md").write_text(f"---\ntitle: t{i}\n---\nbody {i}\n")
    got = bundle.bundle_read(spark, f"file://{tmp_path}")
    assert got.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism
    assert {r.title for r in got.where("error IS NULL").collect()} == {f"t{i}" for i in range(3000)}


def test_titles_agree_with_a_search_for_each():
    """One index of all titles, whatever their number: every title's first place in every text."""
    rng, inside = random.Random(1), set("abcdefghijklmnopqrstuvwxyz0123456789")

    def place(title, text):
        alone = all(" " <= c <= "~" for c in title) and not inside.isdisjoint(title)
        at = text.find(title)
        while at >= 0 and alone and (text[at - 1 : at] in inside or text[at + len(title) : at + len(title) + 1] in inside):
            at = text.find(title, at + 1)
        return at + 1

    for _ in range(60):
        word = lambda a, b: "".join(rng.choice("ab -é\U0001F600") for _ in range(rng.randint(a, b)))
        names, texts = sorted({word(1, 9) for _ in range(40)}), [word(0, 60) if rng.random() > 0.1 else None for _ in range(12)]
        got = {(int(i), int(j)): int(at) for i, j, at in zip(*titles.Titles(names).first(titles.Text(texts)), strict=True)}
        assert got == {(i, j): at for i, t in enumerate(names) for j, x in enumerate(texts) if x and (at := place(t, x))}


def test_mentions_in_blocks_and_slices(spark, monkeypatch):
    rows = [(i, f"name {i % 5}", f"x name {(i + 1) % 5} and name {i % 5}") for i in range(30)]
    df = spark.createDataFrame(rows, "id long, title string, body string").withColumn("updated_at", F.expr("timestamp_seconds(id)")).coalesce(1)
    monkeypatch.setattr(links, "TITLES_AT_ONCE", 2)
    monkeypatch.setattr(links, "_BYTES_TOGETHER", 50)
    assert {r.id: r.n for r in links.mention_counts(df).collect()} == {i: 11 for i in range(30)}
    got = {}
    for r in links.unlinked_mentions(df, limit=2).orderBy("target_id", "rank").collect():
        got.setdefault(r.target_id, []).append(r.source_id)
    assert got == {i: [j for j in range(29, -1, -1) if j != i and i % 5 in (j % 5, (j + 1) % 5)][:2] for i in range(30)}


def test_mentions_are_the_newest_of_each_concept(spark):
    rows = [(i, "same words", "of same words" if i % 3 else "none") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, title string, body string").withColumn("updated_at", F.expr("timestamp_seconds(id DIV 2)"))
    found = {}
    for r in links.unlinked_mentions(df, limit=5).orderBy("target_id", "rank").collect():
        found.setdefault(r.target_id, []).append(r.source_id)
    order = sorted((i for i in range(60) if i % 3), key=lambda i: (-(i // 2), i))
    assert found == {i: [j for j in order if j != i][:5] for i in range(60)}


def test_a_task_keeps_no_more_than_a_page_of_each_needle():
    rng = random.Random(5)
    best = search._Best(pa.array(["a", "b", "c"]), 4)
    rows = [(rng.randrange(2), rng.randrange(20) / 7, rng.choice([5, 6, search._NEVER]), i) for i in range(900)]
    for k in range(0, 900, 100):
        best.add(*(np.array(x) for x in zip(*rows[k : k + 100], strict=True)))
        assert len(best.rows[0]) <= 8
    best.n += 7
    pages, totals = best.batches()
    got = [(r["query_id"], r["id"]) for r in pages.to_pylist()]
    assert got == [(name, r[3]) for q, name in enumerate("ab") for r in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[1], -r[2], r[3]))[:4]]
    assert totals.column("n").to_pylist() == [7, 7, 7] and totals.column("id").null_count == 3


def test_word_similarities_of_few_needles_alone():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcd") for _ in range(6))
    needles, body = [word() for _ in range(40)], Grams(" ".join(word() for _ in range(60)))
    index = words.Needles(needles, 0.4)
    every = index.word_similarities(body, np.ones(40, bool))
    low = every < 0.4
    few = low & (np.arange(40) % 3 == 0)
    assert few.any() and np.array_equal(index.word_similarities(body, few, True), np.where(few, every, 0.0))


def test_fuzzy_fallback_agrees_with_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "NEEDLES_AT_ONCE", 2)
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcd") for _ in range(5))
    docs = [(i, word(), None if i % 4 else word(), " ".join(word() for _ in range(rng.choice([0, 3, 40]))), "deprecated" if i % 5 == 0 else "stable") for i in range(30)]
    docs.append((30, None, None, None, None))
    needles = [(i, word() if i % 3 else "abcda") for i in range(9)] + [(9, "ab"), (10, None)]
    corpus = spark.createDataFrame(docs, "id long, title string, description string, body string, status string").withColumn("updated_at", F.expr("timestamp_seconds(id DIV 3)"))
    got = [tuple(r) for r in search.trgm_fallback(spark.createDataFrame(needles, "query_id long, needle string"), corpus, 4).orderBy("query_id", "rank").collect()]

    def jaccard(a, b):
        a, b = set(trigram_list(a)), set(trigram_list(b or ""))
        return len(a & b) / len(a | b) if a | b else 0.0

    want = []
    for q, needle in needles[:9]:
        hits = []
        for i, title, note, body, status in docs:
            sim, words = jaccard(needle, title), best_stretch(needle, body or "")
            if sim >= 0.1 or words >= 0.4 or jaccard(needle, body) >= 0.1:
                hits.append((round((sim * 50 + words * 20 + jaccard(needle, note) * 12) * (0.25 if status == "deprecated" else 1.0), 6), i // 3, i))
        hits.sort(key=lambda h: (-h[0], -h[1], h[2]))
        want += [(q, rank, h[2], h[0], len(hits)) for rank, h in enumerate(hits[:4], 1)]
    assert got == want


def test_collapse_and_fuse(spark):
    pool = spark.createDataFrame([(1, 10, 1, 0.4, 1), (1, 20, 2, 0.9, 2), (1, 30, 1, 0.7, 3), (1, 40, 3, 0.7, 4)], "query_id long, vec_id long, concept_id long, similarity double, place int")
    assert [(r.id, r.vec_id) for r in vectors.chunk_collapse(pool, 10).orderBy("rank").collect()] == [(2, 20), (1, 30), (3, 40)]
    lex = spark.createDataFrame([(1, 1, 7, 5.0), (1, 2, 8, 4.0)], "query_id long, rank int, id long, score double")
    sem = spark.createDataFrame([(1, 1, 8, 0.9), (1, 2, 9, 0.8)], "query_id long, rank int, id long, similarity double")
    assert [(r.id, r.score) for r in vectors.rrf_fuse(lex, sem, 10).orderBy("rank").collect()] == [(8, 4.0), (7, 5.0), (9, 2.0)]


def test_topk_within_a_scope(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ROWS_AT_ONCE", 3)
    rng = random.Random(4)
    rows = [(i, i, [rng.gauss(0, 1) for _ in range(4)], "abc"[i % 3] if i % 7 else None) for i in range(60)]
    chunks = spark.createDataFrame(rows, "vec_id long, concept_id long, embedding array<float>, owner_id string")
    asked = chunks.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "owner_id")
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v]
    for within in (None, "owner_id"):
        got = {}
        for r in vectors.vector_topk(asked, chunks, 25, within).orderBy("query_id", "place").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        want = {}
        for q, _, v, o in rows:
            near = [(-round(sum(x * y for x, y in zip(unit(v), unit(w), strict=True)), 4), i) for i, _, w, p in rows if not within or (o is not None and p == o)]
            if q % 9 == 0 and near:
                want[q] = [i for _, i in sorted(near)][:25]
        assert {q: set(x) for q, x in got.items()} == {q: set(x) for q, x in want.items()}


def test_search_route_fuses_both_lists(spark):
    rows = [(i, f"zz {'cat' if i < 3 else 'dog'} {i}", None, "body", [], None, "stable", "Note") for i in range(8)]
    corpus = spark.createDataFrame(rows, "id long, title string, description string, body string, tags array<string>, category string, status string, type string").withColumn("updated_at", F.expr("timestamp_seconds(id)"))
    parsed = search.query_parse(spark.createDataFrame([(1, "cat"), (2, "qqq"), (3, "cat")], "query_id long, raw string"))
    near = spark.createDataFrame([(1, 1, 1, 0.9), (1, 2, 5, 0.8), (2, 1, 6, 0.7)], "query_id long, rank int, id long, similarity double")
    found = {}
    for r in search.search_route(parsed, corpus, near, 10).orderBy("query_id", "rank").collect():
        found.setdefault((r.query_id, r.mode), []).append((r.id, r.score, r.total))
    lexical = [(x.id, x.score) for x in search.bm25f_search(parsed, corpus).where("query_id = 3").orderBy("rank").collect()]
    assert [x[:2] for x in found[3, "bm25"]] == lexical and [x[0] for x in found[3, "bm25"]] == [2, 1, 0]
    # 1 is second and first; 5 stands in the semantic list alone.
    assert [x[0] for x in found[1, "bm25"]] == [1, 2, 5, 0] and found[1, "bm25"][2] == (5, 2.0, 3)
    assert found[2, "semantic-only"] == [(6, 100.0, 1)]


def test_ann_recall(spark, sf_dir):
    from kbspark.plans import vectors as plans

    exact = plans._pool(spark, sf_dir, 10).where("place <= 10").select("query_id", "vec_id")
    near = plans.vector_topk_ann(spark, sf_dir).select("query_id", "vec_id")
    assert near.intersect(exact).count() / exact.count() >= 0.9


def test_ann_looks_into_few_cells_where_vectors_cluster(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((50, 24))
    x = (centres[rng.integers(0, 50, 6000)] + 0.25 * rng.standard_normal((6000, 24))).astype(np.float32)
    rows = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(x)], "vec_id long, concept_id long, embedding array<float>")
    asked = rows.where("vec_id % 40 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    exact = vectors.vector_topk(asked, rows, 10).select("query_id", "vec_id")
    near = vectors.vector_topk_ann(asked, rows, 10)
    assert near.select("query_id", "vec_id").intersect(exact).count() >= 0.9 * exact.count()
    assert near.where("place = 1 AND query_id <> vec_id").isEmpty() and near.groupBy("query_id").count().where("count <> 10").isEmpty()
    held, wanted = vectors.ann_cells(asked, rows, 10)
    pairs = held.groupBy("cell").count().join(wanted.groupBy("cell").agg(F.count("*").alias("n")), "cell").agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert pairs < 0.1 * 6000 * 150, pairs
    assert vectors.vector_topk_ann(asked.where("false"), rows, 10).count() == 0 and vectors.vector_topk_ann(asked, rows.where("false"), 10).count() == 0


def test_paths(spark):
    assert col(spark, " a / b ", folders.normal_path) == "a/b" and col(spark, " / ", folders.normal_path) is None
    assert col(spark, "a/b/c", folders.prefixes) == ["a", "a/b", "a/b/c"]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x [2] y [1][2] z [7]."), (2, " [9]")], "answer_id long, answer string")
    sources = spark.createDataFrame([(1, 1), (1, 2)], "answer_id long, marker int")
    found = {r.answer_id: r for r in evidence.citation_audit(answers, sources).collect()}
    assert found[1].citations == [1, 2] and found[1].answer == "x [2] y [1][2] z." and found[2].status == "empty"


def test_admission():
    kept = [(0.0, 100.0), (1.0, 100.0)]
    assert usage.admit_one(kept, 0, 5, 1, usage.TASK_LIMITS) == "active"
    assert usage.admit_one([(float(i), 0.0) for i in range(10)], 0, 20, 1, usage.TASK_LIMITS) == "minute"
    assert usage.admit_one([], 499_999, 0, 2, usage.CALL_LIMITS) == "tokens"
    assert usage.admit_one([], 0, 0, 1, usage.CALL_LIMITS) == "admitted"


def test_bundle_classify_is_the_sequential_fold(spark):
    rng = random.Random(3)
    docs = [(i, f"t{rng.randrange(12)}", f"h{rng.randrange(12)}") for i in range(40)]
    have = [(100, "T1", "h2"), (101, "x", "h5")]
    titles, hashes, want = {t.lower() for _, t, _ in have}, {h for *_, h in have}, {}
    for seq, t, h in docs:
        want[seq] = "duplicate" if h in hashes else "conflict" if t in titles else "create"
        if want[seq] == "create":
            titles.add(t)
            hashes.add(h)
    got = bundle.bundle_classify(spark.createDataFrame(docs, "seq long, title string, content_hash string"), spark.createDataFrame(have, "id long, title string, content_hash string"))
    assert {r.seq: r.verdict for r in got.collect()} == want


def test_bundle_errors():
    assert bundle.parse("no header")["error"] == "no header"
    assert bundle.parse("---\ntype: Note\n---\nx")["error"] == "no title"
    assert bundle.parse("---\ntitle: a\nstatus: odd\n---\nx")["error"] == "unknown status"
    assert bundle.parse("---\ntitle: a\n---\n \n")["error"] == "empty body"
    assert bundle.parse("---\ntitle: a\n---\n# a\n\nbody")["body"] == "body"


def test_plans_have_no_cartesian_product(spark, sf_dir):
    from kbspark import registry

    for name in ("bm25f_search", "term_postings", "backlinks", "link_dangling", "category_tree"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name


def test_admission_goes_on_over_midnight(spark):
    """15:59:50 UTC is the last minute of a day in Shanghai."""
    calls = [(1, "15:59:50", 130), (2, "15:59:55", 125), (3, "15:59:58", 100), (4, "16:00:01", 100), (5, "16:02:01", 60)]
    rows = [(i, 7, f"2024-01-01 {at}", life, 100, None) for i, at, life in calls]
    df = spark.createDataFrame(rows, "call_id long, actor long, at string, life int, reserved long, actual long").withColumn("ts", F.to_timestamp("at"))
    df = df.withColumn("expires_at", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, life)"))
    limits = {"active": 2, "minute": 100, "day_tokens": 200}
    got = {r.call_id: r.verdict for r in usage.admission_replay(df, limits).collect()}
    assert got == {1: "admitted", 2: "admitted", 3: "active", 4: "active", 5: "admitted"}


def test_crlf_is_a_line_end():
    assert sections("# A\r\n" + "a" * 200 + "\r\n## B\r\n" + "b" * 200) == sections("# A\n" + "a" * 200 + "\n## B\n" + "b" * 200)
    assert [p for p, _ in sections("# A\r\n" + "a" * 200 + "\r\n## B\r\n" + "b" * 200)] == ["A", "A > B"]


def test_bundle_headers_as_they_are_exported():
    text = "---\ntype: Note\ntitle: 'It''s: a title'\ntags:\n  - one\n  - \"two: three\"\n  -  \n- four\nstatus: draft\ndescription: |-\n  first\n  second\ncategory: a/b\nkb:\n  title_heading: body\n  tags:\n    - no\n---\n\n# It's: a title\n\nbody\n"
    for end in ("\n", "\r\n"):
        got = bundle.parse(text.replace("\n", end))
        assert got["tags"] == ["one", "two: three", "four"] and got["title"] == "It's: a title" and got["status"] == "draft"
        assert got["description"] == "first\nsecond" and got["category"] == "a/b" and "# It's" in got["body"]
    assert bundle.parse("---\ntitle: a\ntags: [x, 'y z']\ndescription: >-\n  folded\n  text\n\n  apart\n---\nb")["tags"] == ["x", "y z"]
    assert bundle.header("a: >-\n  folded\n  text\n\n  apart")["a"].startswith("folded text") and bundle.header("d: some text\n  goes on") == {"d": "some text goes on"}
    assert bundle.parse(bundle.render({"id": 1, "title": "t: \"x\"", "type": "Note", "description": None, "category": "c", "status": "stable", "tags": ["a, b", "c"], "body": "b"}))["tags"] == ["a, b", "c"]


def test_trash_requests_in_order(spark):
    rng = random.Random(5)
    asked = [(i, s, rng.choice(["trash", "restore", "purge"]), f"2024-02-{s + 1:02}") for i in range(40) for s in range(6)]
    start = {i: rng.choice([None, "2024-01-05"]) for i in range(35)}
    concepts = spark.createDataFrame(list(start.items()), "id long, d string").withColumn("deleted_at", F.to_timestamp("d"))
    requests = spark.createDataFrame(asked, "concept_id long, seq int, action string, on string").withColumn("on", F.col("on").cast("date"))
    got = {(r.concept_id, r.seq): (r.outcome, str(r.deleted_on) if r.deleted_on else None) for r in corpus.trash_apply(concepts, requests).collect()}
    state, want = dict(start), {}
    for i, s, action, on in asked:
        if i not in state or (action == "trash" and state[i]):
            outcome = "not-found"
        elif action == "trash":
            outcome, state[i] = "trashed", on
        elif not state[i]:
            outcome = "not-trashed"
        else:
            outcome = action + {"restore": "d", "purge": "d"}[action]
            state[i] = None
            if action == "purge":
                del state[i]
        want[i, s] = (outcome, state.get(i))
    assert got == want


def test_review_decisions_in_order(spark):
    rng = random.Random(6)
    texts = [(t, "o", f"t{t}", "stable", "body") for t in range(4)]
    live = spark.createDataFrame(texts, "id long, owner_id string, title string, status string, body string")
    prints = {r.id: r.f for r in live.select("id", fingerprint("title", "status", "body").alias("f")).collect()}
    items = [(i, "o", rng.choice(["quality_risk", "conflict"]), "pending", rng.choice([0, 1, 2, 3, 99]), "text") for i in range(40)]
    items = [(*x, prints.get(x[4]) if rng.random() < 0.8 else "other") for x in items]
    decisions = [(s, rng.randrange(40), "o", rng.choice(["keep_old", "adopt_new", "merge", "keep_both"])) for s in range(150)]
    got = {r.seq: r.outcome for r in review.review_resolve(spark.createDataFrame(decisions, "seq long, item_id long, actor string, action string"), spark.createDataFrame(items, "item_id long, owner_id string, kind string, status string, target_id long, body string, fingerprint string"), live).collect()}
    done, changed, want = set(), set(), {}
    for s, i, _, action in decisions:
        _, _, kind, _, target, _, seen = items[i]
        save = action in ("adopt_new", "merge")
        if i in done and not (kind == "quality_risk" and action == "keep_both") and not (save and (target not in prints or (kind == "quality_risk" and seen != prints[target]))):
            want[s] = "already-resolved"
        elif kind == "quality_risk" and action == "keep_both":
            want[s] = "unsupported"
        elif save and target not in prints:
            want[s] = "target-missing"
        elif save and kind == "quality_risk" and (seen != prints[target] or target in changed):
            want[s] = "target-changed"
        else:
            want[s] = "resolved"
            done.add(i)
            changed |= {target} if save else set()
    wrong = {s: (got[s], want[s]) for s in want if got[s] != want[s] and not (want[s] == "already-resolved" and got[s] == "target-changed")}
    assert not wrong and sum(o == "target-changed" for o in got.values()) > 3
    assert {s for s, o in got.items() if o == "resolved"} == {s for s, o in want.items() if o == "resolved"}


def test_instants_and_sections_take_what_stands_before(spark):
    versions = spark.createDataFrame([(1, 1, "a", "2024-01-02"), (1, 2, "b", "2024-01-02"), (1, 3, "c", "2024-01-05"), (2, 1, "x", "2024-01-09")], "concept_id long, version_number int, title string, d string").withColumn("created_on", F.col("d").cast("date")).drop("d")
    instants = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-02"), (1, "2024-01-04"), (1, "2024-01-05"), (1, "2024-01-05"), (2, "2024-01-08"), (3, "2024-01-08")], "concept_id long, d string").withColumn("as_of", F.col("d").cast("date")).drop("d")
    assert sorted((r.concept_id, str(r.as_of), r.version_number) for r in corpus.snapshot_asof(versions, instants).collect()) == [(1, "2024-01-02", 2), (1, "2024-01-04", 2), (1, "2024-01-05", 3)]
    heads = [(1, 5, 1, "A"), (1, 10, 3, "deep"), (1, 20, 2, "B"), (1, 30, 2, "C"), (1, 40, 1, "D"), (1, 50, 6, "six")]
    index = spark.createDataFrame(heads, "id long, offset int, level int, text string")
    anchors = spark.createDataFrame([(1, a) for a in (0, 5, 12, 20, 35, 45, 60)] + [(2, 3)], "id long, anchor int")
    assert {(r.id, r.anchor): r.section for r in links.section_label(anchors, index).collect()} == {(1, 0): None, (1, 5): "A", (1, 12): "A > deep", (1, 20): "A > B", (1, 35): "A > C", (1, 45): "D", (1, 60): "D > six", (2, 3): None}


def test_filters_admit_what_they_ask_for(spark):
    rng = random.Random(7)
    some = lambda values: rng.choice([*values, None])
    rows = [(i, rng.sample(["a", "b", "c"], rng.randrange(4)) if i % 9 else None, some(["x", "x/y", "x/y/z", "xy", "x//y", ""]), some(["stable", "draft"]), some(["Note", "note", "Other"])) for i in range(120)]
    asked = [(i, rng.sample(["a", "b", "q"], rng.choice([0, 0, 1, 2])), some(["x", "x/y", "x/", "nowhere"]), some(["draft"]), some(["NOTE"])) for i in range(60)]
    shape = "tags array<string>, category string, status string, type string"
    got = search.filter_apply(spark.createDataFrame(asked, f"query_id long, {shape}"), spark.createDataFrame(rows, f"id long, {shape}")).collect()
    fits = lambda q, r: set(q[1]) <= set(r[1] or ()) and (q[2] is None or (r[2] is not None and (r[2] == q[2] or r[2].startswith(q[2] + "/")))) and (q[3] is None or r[3] == q[3]) and (q[4] is None or (r[4] or "").lower() == q[4].lower())
    assert sorted(map(tuple, got)) == sorted((q[0], r[0]) for q in asked if q[1] or any(q[2:]) for r in rows if fits(q, r))


def test_folder_moves_in_order(spark):
    rng = random.Random(9)
    names = ["a", "a/b", "a/b/c", "b", "c", "c/d", "x", "x/y"]
    have = [(i, rng.choice("pq"), rng.choice([*names, None, " c / d "])) for i in range(40)]
    empty = [("p", "e/f"), ("q", "b")]
    asked = [(f"{o}{n}", n, o, rng.choice([*names, "e", ""]), rng.choice([*names, "n", "n/m", "f"])) for o in "pq" for n in range(12)]
    got, moved = folders.folder_move_ordered(spark.createDataFrame(have, "id long, owner_id string, category string"), spark.createDataFrame(empty, "owner_id string, path string"), spark.createDataFrame(asked, "move_id string, seq int, owner_id string, source string, target string"))
    norm = lambda c: "/".join(x.strip() for x in (c or "").split("/") if x.strip())
    now, spare, want = {i: norm(c) for i, _, c in have}, {k: list(v) for k, v in enumerate(empty)}, {}
    under = lambda path, top: path == top or path.startswith(top + "/")
    for m, _, o, source, target in asked:
        mine = [c for i, p, _ in have if p == o and (c := now[i])] + [c for p, c in spare.values() if p == o]
        if not source or not target:
            want[m] = "empty"
        elif under(target, source):
            want[m] = "into-itself"
        elif any(under(c, target) for c in mine):
            want[m] = "occupied"
        elif not any(under(c, source) for c in mine):
            want[m] = "absent"
        else:
            want[m] = "moved"
            for i, p, _ in have:
                if p == o and now[i] and under(now[i], source):
                    now[i] = target + now[i][len(source) :]
            for x in spare.values():
                if x[0] == o and under(x[1], source):
                    x[1] = target + x[1][len(source) :]
    assert {r.move_id: r.verdict for r in got.collect()} == want and sum(v == "moved" for v in want.values()) > 3
    assert {r.id: r.category for r in moved.collect()} == {i: now[i] for i, _, c in have if now[i] != norm(c)}


def test_a_plain_checkpoint_path_is_of_the_default_file_system(spark, tmp_path):
    from kbspark import session

    hadoop = spark._jsc.hadoopConfiguration()
    default = hadoop.get("fs.defaultFS")
    assert session.qualified(spark, str(tmp_path)) == f"file:{tmp_path}" and session.qualified(spark, "hdfs://x/y") == "hdfs://x/y"
    try:
        hadoop.set("fs.viewfs.mounttable.m.link./in", f"file://{tmp_path}")
        hadoop.set("fs.defaultFS", "viewfs://m/")
        assert session.qualified(spark, "/in/x") == "viewfs://m/in/x"
    finally:
        hadoop.set("fs.defaultFS", default)
    assert session.read_part(session.shared_parts(spark.range(3), "x", 1)[0]).num_rows == 3


def test_version_diff_is_the_longest_common_run(spark):
    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
            row = new
        return row[-1]

    rng = random.Random(3)
    texts = ["\n".join(rng.choice("abcde") for _ in range(rng.randrange(90))) for _ in range(60)] + ["", "x\ny\nz", "z\nx\ny", None]
    versions = [(i % 8, i, t) for i, t in enumerate(texts)]
    now = [(c, texts[c * 5]) for c in range(6)] + [(6, "x\ny\nz"), (7, None)]
    got = {(r.concept_id, r.version_number): (r.added, r.removed, r.kept, r.moved) for r in corpus.version_diff(spark.createDataFrame(versions, "concept_id long, version_number int, body string"), spark.createDataFrame(now, "concept_id long, body string")).collect()}
    split = lambda t: t.split("\n") if t else []
    want = {}
    for c, n, t in versions:
        a, b = split(t), split(dict(now)[c])
        kept = longest(a, b)
        shared = sum(min(a.count(x), b.count(x)) for x in set(a))
        want[c, n] = (len(b) - kept, len(a) - kept, kept, shared - kept)
    assert got == want
    assert any(moved for *_, moved in got.values())
    none = corpus.version_diff(spark.createDataFrame([], "concept_id long, version_number int, body string"), spark.createDataFrame(now, "concept_id long, body string"))
    assert none.count() == 0


def test_common_lines_of_long_texts():
    old = "\n".join(str(i) for i in range(20_000))
    new = "\n".join(str(i) for i in [*range(10_000, 20_000), *range(10_000)])
    assert common_lines(old, new) == (20_000, 20_000, 10_000, 20_000)


def test_purge_takes_and_unlinks(spark):
    frame = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    purged = frame([(1,), (1,), (2,)], "concept_id long")
    versions = frame([(1, 1), (3, 1)], "concept_id long, version_number int")
    sources = frame([(2, "h"), (3, "h")], "concept_id long, content_hash string")
    files = frame([(2, "k"), (None, "z")], "concept_id long, storage_key string")
    chunks = frame([(1, 10), (1, 11), (3, 12)], "concept_id long, chunk_id long")
    reviews = frame([(5, 1, None), (6, 3, 2), (7, 2, 2), (8, None, None)], "item_id long, target_id long, resolved_id long")
    got = sorted(tuple(r) for r in corpus.purge_cascade(purged, versions, sources, files, chunks, reviews).collect())
    assert got == [("attachment", "k", "delete"), ("chunk", "10", "delete"), ("chunk", "11", "delete"), ("review-resolved", "6", "unlink"), ("review-resolved", "7", "unlink"), ("review-target", "5", "unlink"), ("review-target", "7", "unlink"), ("source", "2:h", "unlink"), ("version", "1:1", "delete")]


def test_places_within_a_hot_key(spark):
    """Two thirds of all rows have one key; a null key is a key."""
    rows = [("hot" if i % 3 else None if i % 2 else f"k{i % 9}", (i * 7919) % 1000, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, at int, id int").repartition(5)
    got = {r.id: r.place for r in numbered(df, ["k"], ["at", "id"], "places").collect()}
    want = {}
    for k in {r[0] for r in rows}:
        for place, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1:])):
            want[i] = place
    assert got == want


def test_listing_pages(spark):
    rows = [(i, f"t{i % 40:02d}", "Note" if i % 4 else "Odd kind", "stable", "2024-01-01") for i in range(100)]
    df = spark.createDataFrame(rows, "id long, title string, type string, status string, at string").withColumn("updated_at", F.to_timestamp("at"))
    got = {(r.dir, r.page): (r.n, r.listing) for r in bundle.bundle_manifest(df, page_titles=20).collect()}
    notes = sorted((t, i) for i, t, kind, *_ in rows if kind == "Note")
    want = {("notes", p): (len(part), hashlib.md5("\n".join(f"- {t}" for t, _ in part).encode()).hexdigest()) for p in range(4) if (part := notes[p * 20 : p * 20 + 20])}
    assert {k: v for k, v in got.items() if k[0] == "notes"} == want
    assert {k: n for k, (n, _) in got.items() if k[0] == "odd"} == {("odd", 0): 20, ("odd", 1): 5}


def test_mention_counts_leave_out_the_own_body(spark):
    day = "2024-01-01"
    rows = [(1, "Red Fox", "the red fox, red fox", day), (2, "red fox", "no [[red fox]] here", day), (3, "x", "a red fox and red foxes", day), (4, "none", None, day), (5, None, "red fox", day)]
    df = spark.createDataFrame(rows, "id long, title string, body string, at string").withColumn("updated_at", F.to_timestamp("at"))
    assert {r.id: r.n for r in links.mention_counts(df).collect()} == {1: 2, 2: 3}


def test_findings_are_cut_by_section(spark):
    many = spark.createDataFrame([(i, f"d{i}") for i in range(200)], "id long, detail string")
    got = curate.curate_findings({"many": many.repartition(7), "few": many.where("id < 2"), "none": many.limit(0)}, limit=5).collect()
    assert sorted((r.section, r.place, r.id) for r in got) == [("few", 1, 0), ("few", 2, 1), *[("many", i + 1, i) for i in range(5)]]
    counts = {r.section: r.n for r in curate.curate_report({"many": many, "heavy": many.limit(2).withColumn("weight", F.lit(4)), "none": many.limit(0)}).collect()}
    assert counts == {"many": 200, "heavy": 8, None: 208}


def test_vector_sets_and_spaces(spark):
    v, w = [1.0, 0.0], [1.0]
    rows = [(1, 0, "s", "a", v), (1, 1, "s", "a", v), (2, 1, "s", "a", v), (3, 0, "s", "a", v), (3, 0, "s", "a", v), (4, 0, "s", "a", v), (4, 1, "t", "a", v), (5, 0, "s", None, v), (5, 1, "s", "a", v), (6, 0, "s", "b", v), (6, 1, "s", "b", w), (7, 0, "s", None, v), (8, None, "s", "a", v), (9, 0, "s", "a", None)]
    df = spark.createDataFrame(rows, "concept_id long, ordinal int, space string, model string, embedding array<double>")
    assert {r.concept_id: r.verdict for r in vectors.vector_sets(df).collect()} == {1: "whole", 2: "gap", 3: "gap", 4: "spaces", 5: "models", 6: "dimensions", 7: "whole", 8: "gap", 9: "dimensions"}
    spaces = {(r.space, r.model, r.dim): (r.n, r.verdict) for r in vectors.vector_spaces(df).collect()}
    assert spaces["s", "a", 2] == (8, "pinned") and spaces["t", "a", 2] == (1, "pinned")
    assert {k for k, (_, x) in spaces.items() if x == "foreign"} == {("s", None, 2), ("s", "b", 2), ("s", "b", 1), ("s", "a", -1)}
    guard = spark.createDataFrame([(1, v), (2, [0.0, 0.0]), (3, w), (4, [1.0, float("nan")]), (5, None), (6, [1.0, None])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.verdict for r in vectors.vector_guard(guard, 2).collect()} == {1: "accepted", 2: "zero", 3: "dimension", 4: "not-finite", 5: "dimension", 6: "not-finite"}
