"""The logical tables in DuckDB SQL, put before each query's twin."""

from __future__ import annotations

import re

_DAY = "DATE '2024-01-31'"

CTES = {
    "corpus_rows": f"""SELECT doc_id AS id, source AS owner_id,
  CASE doc_id % 10 WHEN 0 THEN 'Reference' WHEN 1 THEN 'Procedure' ELSE 'Note' END AS type,
  CASE WHEN t = '' THEN 'untitled' ELSE t END AS title,
  CASE WHEN doc_id % 3 <> 0 THEN replace(substr(text, 1, 80), chr(10), ' ') END AS description,
  concat_ws('/', lang, source) AS category,
  CASE WHEN toxic = 1 THEN 'deprecated' WHEN quality = 0 THEN 'draft' ELSE 'stable' END AS status,
  [lang, source] AS tags, CAST(1 + doc_id % 2 AS INT) AS current_version,
  CAST({_DAY} - (CAST(doc_id % 400 AS INT) + 30) AS TIMESTAMP) AS created_at,
  CAST({_DAY} - CAST(doc_id % 400 AS INT) AS TIMESTAMP) AS updated_at,
  CASE WHEN doc_id % 37 = 0 THEN CAST({_DAY} - CAST(doc_id % 50 AS INT) AS TIMESTAMP) END AS deleted_at,
  CAST(doc_id % 7 AS INT) AS retrieval_count,
  CASE WHEN doc_id % 7 > 0 THEN CAST({_DAY} - CAST(doc_id % 30 AS INT) AS TIMESTAMP) END AS last_retrieved_at,
  text AS body, 'sha256:' || sha256(text) AS content_hash
  FROM (SELECT d.*, l.toxic, l.quality, trim(regexp_replace(array_to_string(list_slice(string_split(text, ' '), 1, 2), ' '), '[.,|\\n]', '', 'g')) AS t
    FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) WHERE text IS NOT NULL)""",
    "corpus": "SELECT * FROM corpus_rows WHERE deleted_at IS NULL",
    "users": f"""SELECT DISTINCT source AS user_id, 'user ' || source AS username, CASE WHEN n = 0 THEN 'admin' ELSE 'user' END AS role, n % 5 = 4 AS disabled,
  CASE WHEN n % 3 > 0 THEN CAST({_DAY} - n AS TIMESTAMP) END AS last_login_at
  FROM (SELECT source, CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) AS n FROM documents WHERE source IS NOT NULL)""",
    "versions": """SELECT id AS concept_id, v AS version_number, CASE WHEN id % 5 <> 0 THEN title END AS title, CASE WHEN id % 5 <> 0 THEN description END AS description,
  CASE WHEN id % 5 <> 0 THEN category END AS category, CASE WHEN id % 5 <> 0 THEN status END AS status, CASE WHEN id % 5 <> 0 THEN type END AS type,
  CASE WHEN v = 2 OR id % 2 = 0 THEN body ELSE substr(body, 1, length(body) // 2) END AS body, CAST(created_at AS DATE) + 10 * v AS created_on
  FROM corpus_rows, (VALUES (1), (2)) AS vs(v)""",
    "attachments": """SELECT page_id, (page_id * 3) % n AS concept_id, 'key-' || page_id AS storage_key, CAST(coalesce(strlen(html), 0) AS BIGINT) AS size_bytes,
  page_id % 11 <> 0 AS has_metadata, page_id % 13 <> 0 AS has_file, page_id % 17 = 0 AS uploading FROM pages, (SELECT count(*) AS n FROM documents) WHERE n > 0""",
    "save_feed": """SELECT id AS concept_id, seq, owner_id, CASE WHEN seq = 2 THEN title || ' (draft)' ELSE title END AS title, description, category, status, type,
  CASE WHEN seq < 3 THEN substr(body, 1, length(body) // 2) ELSE body END AS body, CAST(created_at AS DATE) + seq AS saved_on FROM corpus_rows, (VALUES (1), (2), (3)) AS s(seq)""",
    "linked_corpus": """SELECT id, owner_id, title, description, category, status, type, tags, updated_at,
  body || chr(10) || chr(10) || '[[' || link || ']]' || CASE WHEN id % 4 = 0 THEN ' and [[' || link || '|alias]]' ELSE '' END
  || CASE WHEN id % 5 = 0 THEN chr(10) || '![[' || link || ']]' || chr(10) ELSE '' END || CASE WHEN id % 11 = 0 THEN ' [[missing-' || id || ']]' ELSE '' END AS body
  FROM (SELECT c.*, coalesce(o.title, 'nowhere') AS link FROM (SELECT c.*, (7 * id + 1) % n AS to_id FROM corpus c, (SELECT count(*) AS n FROM documents)) c
    LEFT JOIN corpus_rows o ON o.id = c.to_id)""",
    "headed_corpus": """SELECT id, owner_id, title, category, updated_at, '# ' || title || chr(10) || chr(10) || substr(body, 1, length(body) // 2) || chr(10) || chr(10) || '## part ' || (id % 3) || chr(10) || chr(10)
  || CASE WHEN id % 6 = 0 THEN '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) ELSE '' END || substr(body, CAST(length(body) // 2 AS BIGINT) + 1) AS body
  FROM (SELECT id, owner_id, category, updated_at, translate(title, '#`~', '---') AS title, translate(body, '#`~', '---') AS body FROM corpus)""",
    "folders": "SELECT DISTINCT source AS owner_id, lang || '/' || source || '/empty' AS path FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL",
    "query_table": r"""SELECT conv_id * 1000 + turn AS query_id, q || CASE WHEN conv_id % 5 = 0 THEN ' tag:en' ELSE '' END || CASE WHEN conv_id % 7 = 0 THEN ' status:draft' ELSE '' END
  || CASE WHEN conv_id % 35 = 0 THEN ' type:note' ELSE '' END
  || CASE WHEN conv_id % 22 = 0 THEN ' category:en/src1' WHEN conv_id % 11 = 0 THEN ' category:fr' ELSE '' END AS raw
  FROM (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN substr(q, 2, 1) || substr(q, 1, 1) || substr(q, 3) ELSE q END AS q
    FROM (SELECT conv_id, turn, trim(regexp_replace(substr(text, 1, 60), '\s+', ' ', 'g')) AS q FROM conversations WHERE role = 'user' AND text IS NOT NULL))""",
    "parsed": r"""SELECT query_id, regexp_replace(trim(regexp_replace(regexp_replace(raw, ' (tag|category|status|type):[^ ]*', '', 'g'), '\s+', ' ', 'g')), '^(.{200}).*$', '\1') AS needle,
  CASE WHEN raw LIKE '% tag:en%' THEN ['en'] ELSE []::VARCHAR[] END AS tags, CASE WHEN raw LIKE '% status:draft%' THEN 'draft' END AS status,
  CASE WHEN raw LIKE '% type:note%' THEN 'note' END AS type,
  CASE WHEN raw LIKE '% category:en/src1%' THEN 'en/src1' WHEN raw LIKE '% category:fr%' THEN 'fr' END AS category FROM query_table""",
    "chunk_vectors": "SELECT vec_id, vec_id % n AS concept_id, embedding, vec_id % 13 = 0 AS stale FROM embeddings, (SELECT count(*) AS n FROM documents) WHERE n > 0",
    "query_vectors": "SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 20 = 0",
    "request_log": """SELECT event_id, ts, user_id, CASE event_type WHEN 'error' THEN 500 ELSE 200 END AS status, CAST(floor(value * 10) AS INT) AS took_ms,
  CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'POST' ELSE 'GET' END AS method,
  CASE event_type WHEN 'purchase' THEN '/api/concepts' WHEN 'signup' THEN '/api/capture' WHEN 'click' THEN '/api/search' ELSE '/api/concepts' END AS path, user_id % 10 AS api_key_id FROM events""",
    "search_log": """SELECT event_id, ts, user_id, CAST(floor(value) AS INT) % 8 AS result_count, CAST(floor(value * 10) AS INT) AS took_ms,
  ['bm25', 'trgm-fallback', 'semantic-only', 'operators'][CAST(event_id % 4 AS INT) + 1] AS mode, CASE WHEN event_id % 10 = 0 THEN 'ingest' ELSE 'api' END AS source
  FROM events WHERE event_type IN ('view', 'click')""",
    "model_calls": """SELECT event_id AS call_id, ts, user_id AS actor, CAST(floor(value * 100) AS BIGINT) + 1 AS reserved,
  CASE WHEN event_id % 6 <> 0 THEN CAST(floor(value * 80) AS BIGINT) + 1 END AS actual, ts + INTERVAL 150 SECOND AS expires_at FROM events WHERE event_type IN ('purchase', 'signup')""",
    "answers": """SELECT conv_id * 1000 + turn AS answer_id, text || CASE turn % 3 WHEN 0 THEN ' [1] then [2][1]' WHEN 1 THEN ' see [2] and [9]' ELSE ' [1] [0] [12]' END AS answer
  FROM conversations WHERE role = 'assistant' AND text IS NOT NULL""",
    "bundle_rows": """SELECT *, 'sha256:' || sha256(body) AS content_hash FROM (SELECT id AS seq, owner_id,
  CASE WHEN id % 17 = 0 THEN 'shared title' WHEN id % 3 = 2 THEN 'new ' || id || ' ' || title WHEN id % 6 = 1 THEN 'incoming ' || title ELSE title END AS title,
  CASE WHEN id % 3 = 0 THEN body ELSE body || ' altered ' || (id % 7) END AS body FROM corpus)""",
    "review_pending": """SELECT id AS item_id, owner_id, CASE id % 3 WHEN 0 THEN 'near_duplicate' WHEN 1 THEN 'quality_risk' ELSE 'conflict' END AS kind,
  CASE WHEN id % 2 = 0 THEN 'ingest' ELSE 'import' END AS source, CASE WHEN id % 5 = 0 THEN 'resolved' ELSE 'pending' END AS status, title,
  body || ' revised' AS body, 'sha256:' || sha256(body || ' revised') AS content_hash, CASE WHEN id % 4 <> 0 THEN id END AS target_id, CAST(created_at AS DATE) AS created_on,
  CASE WHEN id % 5 = 0 THEN CAST(created_at AS DATE) + 3 END AS resolved_on, id % 7 = 0 AS edited FROM corpus""",
    "mentions": r"""SELECT target_id, source_id FROM (SELECT id AS target_id, lower(trim(title)) AS t, regexp_matches(lower(trim(title)), '^[\x20-\x7e]+$') AND regexp_matches(lower(trim(title)), '[a-z0-9]') AS is_ascii
    FROM linked_corpus WHERE length(trim(title)) >= 2)
  JOIN (SELECT id AS source_id, regexp_replace(lower(body), '!?\[\[[^\[\]\n]{1,200}\]\]', chr(57344), 'g') AS low FROM linked_corpus) ON contains(low, t) AND target_id <> source_id
  WHERE NOT is_ascii OR regexp_matches(low, '(?:^|[^a-z0-9])' || regexp_escape(t) || '(?:$|[^a-z0-9])')""",
    "links": r"""SELECT id, pos, trim(target) AS target, display, embed FROM (
  SELECT id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS raw, starts_with(raw, '!') AS embed, regexp_extract(raw, '\[\[([^\[\]\n]*)\]\]', 1) AS inner_text,
    string_split(inner_text, '|')[1] AS target, CASE WHEN contains(inner_text, '|') THEN trim(substr(inner_text, strpos(inner_text, '|') + 1)) END AS alias,
    coalesce(nullif(alias, ''), trim(target)) AS display
  FROM (SELECT id, regexp_extract_all(body, '!?\[\[[^\[\]\n]{1,200}\]\]') AS m FROM linked_corpus)) WHERE trim(target) <> ''""",
}


def sql(body: str) -> str:
    """``body`` behind the logical tables that it names, directly or through others."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    shared = ",\n".join(f"{name} AS ({text})" for name, text in CTES.items() if name in needed)
    if not shared:
        return body
    own = re.match(r"\s*WITH\s+", body)
    return f"WITH {shared}{',' if own else ''}\n{body[own.end() :] if own else body}"
