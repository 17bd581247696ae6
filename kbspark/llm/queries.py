"""The ``opN_*`` queries over the synthetic tables: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitpack, dartminhash, langid_kernel, license_digest, lm_maxent, merkle_exchange, onebit_ann, pivot_topk, poisson_mix, prefix_trie, url_digest, warc_shards, winnow


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: str = "doc_id"):
    """The contract's fold of a document: CRC-32 of its id as text, modulo 5 (null: the CRC of an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


def op1_lm_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learnt from four fifths of them."""
    docs = _table(spark, sf_dir, "documents")
    model, counts = lm_maxent.train(docs.where(fold_of() != 1))
    found = lm_maxent.score(docs, model, counts)
    return found.select("doc_id", (fold_of() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token ids, written bit-packed and read back."""
    manifest = bitpack.write_token_ids(_table(spark, sf_dir, "documents"), tokenizer_path())
    return bitpack.token_digests(manifest)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by every benchmark item."""
    found = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op4_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector among all others."""
    return onebit_ann.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op5_langid_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from four fifths of the labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    model = langid_kernel.train(docs, learn=fold_of() != 0)
    found = langid_kernel.identify(docs, model)
    return found.select("doc_id", (fold_of() == 0).alias("held_out"), "lang_pred", "score")


#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op6_url_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    manifest = url_digest.write_rules(url_digest.rules_table(spark, URL_RULES))
    return url_digest.filtered(_table(spark, sf_dir, "pages"), manifest)


OP6_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'),
  ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS r FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS rn FROM rest),
fit AS (SELECT rn, max_by(r.host || r.path, (length(r.host) + length(r.path)) * 1000 + length(r.host)) AS rule,
  max_by(r.verdict, (length(r.host) + length(r.path)) * 1000 + length(r.host)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fit USING (rn)
"""


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents, sources weighted by the root of their size; every copy with its text."""
    copies = poisson_mix.shuffled(poisson_mix.replicated(_table(spark, sf_dir, "documents")))
    return copies.select("doc.*", F.round("rate", 9).alias("rate"), "n_copies", "copy", "shuffle_key")


OP7_SQL = r"""
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(pow(n::DOUBLE, 0.5)) AS w, sum(n)::DOUBLE AS wanted FROM sizes),
rates AS (SELECT source, pow(n::DOUBLE, 0.5) * wanted / w / n AS rate FROM sizes, sums),
steps AS (SELECT source, rate, greatest(ceil(rate / 16), 1)::INT AS steps FROM rates),
cdf AS (SELECT source, rate, steps, k, sum(exp(-rate / steps + k * ln(rate / steps) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM steps, generate_series(0, 96) AS s(k)),
uniform AS (SELECT d.doc_id, d.source, i,
  (('0x' || substr(md5('mix-1|n|' || i || '|' || coalesce(d.doc_id::VARCHAR, '\N')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
  FROM (SELECT DISTINCT doc_id, source FROM documents) d JOIN steps s ON s.source IS NOT DISTINCT FROM d.source, generate_series(1, s.steps) AS g(i)),
drawn AS (SELECT u.doc_id, u.source, count(c.k)::INT AS n_copies FROM uniform u LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM u.source AND c.c <= u.u GROUP BY u.doc_id, u.source)
SELECT d.*, round(s.rate, 9) AS rate, r.n_copies, copy::INT AS copy,
  (('0x' || substr(md5('mix-1|order|' || copy || '|' || coalesce(d.doc_id::VARCHAR, '\N')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS shuffle_key
FROM documents d JOIN drawn r ON r.doc_id IS NOT DISTINCT FROM d.doc_id AND r.source IS NOT DISTINCT FROM d.source
JOIN steps s ON s.source IS NOT DISTINCT FROM d.source, generate_series(1, r.n_copies) AS g(copy)
"""


def op8_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses of every whole document and of its whole lines."""
    found = license_digest.scan(_table(spark, sf_dir, "documents"), license_digest.known_licenses(spark), digests=license_digest.whole_texts(spark))
    return found.select("doc_id", "digest", "license_id", F.array_join("notices", ",").alias("notices"))


def _op8_sql() -> str:
    def canonical(x: str) -> str:
        out = f"regexp_replace(lower({x}), '{license_digest._COPYRIGHT_LINE}', '\\1', 'g')"
        out = f"regexp_replace({out}, '{license_digest._PUNCTUATION}', ' ', 'g')"
        for old, new in license_digest.SPELLINGS:
            out = f"replace({out}, '{old}', '{new}')"
        return f"trim({out})"

    texts = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in license_digest.LICENSES)
    digests = ", ".join(f"('{i}', '{d}')" for i, d in license_digest.DIGESTS)
    return f"""
WITH known AS (SELECT DISTINCT sha256({canonical("t")}) AS digest, license_id FROM (VALUES {texts}) AS v(license_id, t)),
docs AS (SELECT row_number() OVER () AS rn, doc_id, text FROM documents),
whole AS (SELECT rn, doc_id, {canonical("text")} AS c FROM docs),
lines AS (SELECT rn, {canonical("line")} AS c FROM (SELECT rn, unnest(string_split(text, chr(10))) AS line FROM docs)),
notices AS (SELECT rn, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM lines JOIN known ON known.digest = sha256(c) WHERE c <> '' GROUP BY rn),
least AS (SELECT digest, min(license_id) AS license_id FROM (SELECT digest, license_id FROM known UNION ALL SELECT d, i FROM (VALUES {digests}) AS w(i, d)) GROUP BY digest)
SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest, license_id, coalesce(notices, '') AS notices
FROM whole LEFT JOIN notices USING (rn) LEFT JOIN least ON least.digest = CASE WHEN c <> '' THEN sha256(c) END
"""


def op9_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return dartminhash.classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op10_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written as WARC archives and read back."""
    manifest = warc_shards.write_archives(_table(spark, sf_dir, "pages"))
    records = warc_shards.read_archives(manifest, payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What enters a leaf, in this order.
LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_merkle_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof in the manifest, and whether it holds once a third of the texts have been lower-cased."""
    docs = _table(spark, sf_dir, "documents")
    found_later = [F.translate("text", UPPER, LOWER) if c == "text" else F.col(c) for c in LEAF_FIELDS]
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    seen = F.when(tampered, merkle_exchange.leaf_of(found_later))
    found = merkle_exchange.leaves(docs, LEAF_FIELDS, key="lang", order="doc_id", seen=seen)
    return merkle_exchange.audited(found).withColumnRenamed("id", "doc_id")


def _crc32_sql(value: str, table: str = "crc.t") -> str:
    """Unsigned CRC-32 of an ASCII text, where ``crc`` (see CRC_SQL) is joined."""
    codes = f"list_transform(string_split({value}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: xor(c >> 8, {table}[((xor(c, b) & 255) + 1)::INT])), 4294967295::BIGINT)"


CRC_SQL = """crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) AS r(i)))"""


def _op11_sql() -> str:
    def leaf(text: str) -> str:
        values = [text if c == "text" else f"{c}::VARCHAR" for c in LEAF_FIELDS]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    def tree(name: str, start: str) -> str:
        """Nodes of all levels of trees, and what stands left and right of each in its run."""
        return f"""{name}(tree, level, i, h, n) AS ({start} UNION ALL
  SELECT tree, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), max((n + 7) // 8) FROM {name} WHERE n > 1 GROUP BY tree, level, i // 8),
{name}_near AS (SELECT a.tree, a.level, a.i, a.n, a.h, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name} a JOIN {name} b ON a.tree = b.tree AND a.level = b.level AND a.i // 8 = b.i // 8 GROUP BY ALL)"""

    return f"""
WITH RECURSIVE {CRC_SQL},
docs AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS leaf,
  CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS seen FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs),
{tree("low", "SELECT tree, 0, pos, leaf, n FROM placed")},
subroots AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{tree("high", "SELECT '', 0, pos, h, n FROM subroots")},
fold(tree, pos, stage, level, i, h, proof) AS (SELECT tree, pos, 0, 0, pos, coalesce(seen, leaf), '' FROM placed UNION ALL
  SELECT f.tree, f.pos, CASE WHEN s.n > 1 THEN f.stage ELSE f.stage + 1 END, CASE WHEN s.n > 1 THEN f.level + 1 ELSE 0 END,
    CASE WHEN s.n > 1 THEN f.i // 8 ELSE u.pos END, CASE WHEN s.n > 1 THEN sha256(s.l || f.h || s.r) ELSE f.h END, CASE WHEN s.n > 1 THEN f.proof || s.l || s.r ELSE f.proof END
  FROM fold f JOIN (SELECT 0 AS stage, * FROM low_near UNION ALL SELECT 1, * FROM high_near) s ON s.stage = f.stage AND s.level = f.level AND s.i = f.i AND s.tree = CASE WHEN f.stage = 0 THEN f.tree ELSE '' END
  JOIN subroots u ON u.tree = f.tree),
ends AS (SELECT * FROM fold WHERE stage = 2)
SELECT p.doc_id, p.leaf, u.h AS subroot, t.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = t.h AS verified
FROM placed p JOIN ends e ON e.tree = p.tree AND e.pos = p.pos JOIN subroots u ON u.tree = p.tree, (SELECT h FROM high WHERE n = 1) t
"""


def op12_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest integer products of every twentieth vector with all others."""
    return pivot_topk.nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


OP12_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, each rebuilt on the head of another."""
    turns = prefix_trie.ordered(_table(spark, sf_dir, "conversations"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return prefix_trie.trie(*prefix_trie.grafted(turns, base=F.col("conv_id") - F.col("conv_id") % 5, head=head, most=8))


def _op13_sql() -> str:
    return f"""
WITH {CRC_SQL},
told AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS own FROM told GROUP BY conv_id),
heads AS (SELECT conv_id, own, {_crc32_sql("conv_id::VARCHAR")} % 9 AS h FROM convs, crc),
rebuilt AS (SELECT c.conv_id, coalesce(b.own[1:c.h], []) || c.own[c.h + 1:] AS turns FROM heads c LEFT JOIN heads b ON b.conv_id = c.conv_id - c.conv_id % 5),
starts AS (SELECT conv_id, d, turns[1:d] AS told, len(turns) AS n FROM rebuilt, unnest(range(len(turns) + 1)) AS g(d)),
nodes AS (SELECT d, told, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(told[d].text), 0) AS n_bytes,
  coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '') AS ends FROM starts GROUP BY d, told),
children AS (SELECT d - 1 AS d, told[1:d - 1] AS told, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (d, told)),
up AS (SELECT a AS d, told[1:a] AS told, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * n_bytes)::BIGINT AS saved_tokens
  FROM counted, unnest(range(d + 1)) AS g(a) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, u.saved_tokens, sha256(n.ends) AS ends_sha256
FROM counted n JOIN up u USING (d, told) LEFT JOIN nodes p ON p.d = n.d - 1 AND p.told = n.told[1:n.d - 1]
"""


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracles():
    return {"op6_url_digest": OP6_SQL, "op7_poisson_mix": OP7_SQL, "op8_license_digest": _op8_sql(), "op11_merkle_exchange": _op11_sql(), "op12_pivot_topk": OP12_SQL, "op13_prefix_trie": _op13_sql()}
