"""The queries of plans/queries.py in SQL (DuckDB), over the same tables."""

from __future__ import annotations

from . import layout_queries, run_queries, stored_queries, structure_queries
from .sql_parts import BUDGET, CHUNKS, CHUNK_SPANS, CLEAN, COLLAPSED, HELD, JUDGED, LINES, LISTING, MESSAGES, PASSAGES, QUESTIONS, SOURCE_INDEX, SPACES, STRIPS, URL, VECTOR_HITS, dense, key, overlap, page_text, postings, sparse, tail

SQL: dict[str, str] = {
    "strip_split": f'WITH RECURSIVE {STRIPS} SELECT doc_id, start, "end", strip FROM strips',
    "refine_internal": f"""
WITH RECURSIVE {sparse(3)}, {JUDGED}, {STRIPS},
chosen AS (SELECT query_id, doc_id FROM judged JOIN actions USING (query_id) WHERE action <> 'Incorrect' AND (relevance = 'relevant' OR (action = 'Ambiguous' AND relevance = 'uncertain')))
SELECT query_id, doc_id, start, "end", strip FROM chosen JOIN strips USING (doc_id) JOIN questions q USING (query_id) WHERE {overlap('q.text', 'strip')} >= 3""",
    "chunk_pack": f"""
WITH RECURSIVE {CHUNKS}
SELECT doc_id, substr(sha256(doc_id || chr(0) || ordinal || chr(0) || text), 1, 32) AS chunk_id, ordinal, text, length(text) AS char_count, shared <> '' AS has_overlap FROM chunk""",
    "chunk_spans": f"""
WITH RECURSIVE {CHUNKS},
{CHUNK_SPANS}
SELECT doc_id, ordinal, row_number() OVER (PARTITION BY doc_id, ordinal ORDER BY r) - 1 AS span, l - less AS chunk_char_start, e - less AS chunk_char_end, l + shift AS block_char_start, e + shift AS block_char_end, is_overlap FROM own WHERE l < e""",
    "chunk_stats_by_lang": f"""
WITH RECURSIVE {CHUNKS} SELECT lang, count(*) AS n_chunks, sum(length(c.text))::BIGINT AS chars, max(length(c.text)) AS longest, count(*) FILTER (shared <> '') AS overlapping FROM chunk c JOIN documents USING (doc_id) GROUP BY 1""",
    "page_text": f"SELECT page_id, {page_text("html")} AS text FROM pages",
    "page_top_passages": f'WITH RECURSIVE {PASSAGES} SELECT query_id, url, strip_id, start, "end", passage, candidate_no, rerank_score, retrieval_score FROM best',
    "web_strips": f"""
WITH RECURSIVE {PASSAGES}
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, place, candidate_no) AS position, strip_id, url, rerank_score FROM best WHERE rerank_score >= 2 QUALIFY position <= 8""",
    "mmr_select": f"""
WITH RECURSIVE {VECTOR_HITS},
worth AS (SELECT query_id, h.vec_id, rank, greatest(0, list_inner_product(q.u, w.u)) AS worth FROM hits h JOIN u w ON w.vec_id = h.vec_id JOIN u q ON q.vec_id = query_id),
near AS (SELECT a.query_id, a.rank AS one, b.rank AS other, greatest(0, list_inner_product(x.u, y.u)) AS near FROM hits a JOIN hits b USING (query_id) JOIN u x ON x.vec_id = a.vec_id JOIN u y ON y.vec_id = b.vec_id),
pick AS (SELECT query_id, vec_id, rank, worth, 0::DOUBLE AS closest, 0 AS step, NULL::INT AS place FROM worth
  UNION ALL SELECT p.query_id, p.vec_id, p.rank, p.worth, greatest(closest, near), step + 1, CASE WHEN rank = best THEN step + 1 ELSE place END
  FROM (SELECT *, first_value(rank) OVER (PARTITION BY query_id ORDER BY free DESC, 0.6::DOUBLE * worth - 0.4::DOUBLE * closest DESC, worth DESC, rank) AS best, bool_or(free) OVER (PARTITION BY query_id) AS more
    FROM (SELECT *, place IS NULL AND (step = 0 OR closest < 0.85) AS free FROM pick WHERE step < 8)) p
  JOIN near n ON n.query_id = p.query_id AND n.one = p.rank AND n.other = p.best WHERE more)
SELECT query_id, vec_id, min(place) AS place FROM pick WHERE place IS NOT NULL GROUP BY ALL""",
    "answer_lines": rf"""
WITH RECURSIVE {BUDGET}, three AS (SELECT query_id, doc_id FROM sparse WHERE rank <= 3),
{JUDGED.replace('FROM sparse s', 'FROM three s')},
w AS (SELECT query_id, number, replace(text, chr(10), ' ') AS claim, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}]+') AS c, ['không', 'chưa', 'not', 'never', 'no'] AS no FROM kept),
n AS (SELECT *, list_distinct([c[i + 1] || ' ' || c[i + 2] FOR i IN range(1, len(c) - 1) IF list_contains(no, c[i]) AND c[i + 1] <> 'chỉ']) AS turned FROM w),
good AS (SELECT query_id, number, claim FROM n WHERE len(turned) = 0 OR len([p FOR p IN range(1, len(c)) IF list_contains(turned, c[p] || ' ' || c[p + 1]) AND NOT list_has_any(c[greatest(p - 5, 1):p - 1], no)]) = 0),
lines AS (SELECT query_id, string_agg(claim || ' [' || number || ']', chr(10) ORDER BY number) AS lines, string_agg('[' || number || ']', ' ' ORDER BY number) AS used FROM good GROUP BY 1),
c AS (SELECT query_id, count(*) AS n, count(DISTINCT source_type) AS sources FROM kept GROUP BY 1),
state AS (SELECT query_id, CASE WHEN n IS NULL THEN 'no_evidence' WHEN action = 'Ambiguous' AND sources < 2 THEN 'partial' ELSE 'ready' END AS state FROM actions LEFT JOIN c USING (query_id))
SELECT query_id, CASE WHEN state = 'no_evidence' OR (lines IS NULL AND state = 'partial') THEN 'insufficient_evidence' WHEN lines IS NULL THEN 'model_abstained' WHEN state = 'partial' THEN 'partial' ELSE 'answered' END AS status,
  coalesce(CASE WHEN state = 'partial' THEN 'Bằng chứng hiện chưa đầy đủ; câu trả lời chỉ dựa trên các nguồn đã thu thập được.' || chr(10) ELSE '' END || lines, '') AS text, coalesce(used, '') AS used
FROM state LEFT JOIN lines USING (query_id)""",
    "clean_text": f"SELECT doc_id, t AS text, length(t) AS n_clean FROM (SELECT doc_id, {CLEAN} AS t FROM documents)",
    "paragraph_blocks": r"""
WITH p AS (SELECT page_id, replace(html, '</p>', chr(10) || ' ' || chr(10)) AS t FROM pages),
c AS (SELECT page_id, t, string_split_regex(t, '\n[ \t]*\n') AS parts, regexp_extract_all(t, '\n[ \t]*\n') AS gaps FROM p),
x AS (SELECT page_id, t, i, parts[i] AS raw, coalesce(list_sum([length(y) FOR y IN parts[1:i-1]]), 0) + coalesce(list_sum([length(y) FOR y IN gaps[1:i-1]]), 0) AS pos FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM c)),
s AS (SELECT page_id, t, i, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS text, pos + length(raw) - length(regexp_replace(raw, '^\s+', '')) AS start_char FROM x),
r AS (SELECT *, start_char + length(text) AS end_char FROM s WHERE text <> '')
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS ordinal, start_char, end_char,
  start_char - length(replace(substr(t, 1, start_char::INT), chr(10), '')) + 1 AS start_line, end_char - length(replace(substr(t, 1, end_char::INT), chr(10), '')) + 1 AS end_line, md5(text) AS text_md5 FROM r""",
    "margin_keys": f"SELECT doc_id, {key('l[1]')} AS first_key, {key('l[-1]')} AS last_key FROM (SELECT doc_id, {LINES} AS l FROM documents) WHERE len(l) > 0",
    "repeated_margins": f"""
WITH l AS (SELECT source, doc_id, {LINES} AS l FROM documents),
k AS (SELECT DISTINCT source, doc_id, unnest([{key('l[1]')}, {key('l[-1]')}]) AS key FROM l WHERE len(l) > 0),
n AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY 1)
SELECT source, key, count(*) AS pages FROM k JOIN n USING (source) WHERE key <> '' AND n >= 3 GROUP BY source, key, n HAVING count(*) >= greatest(3, floor(n * 0.002 + 0.999))""",
    "sentence_units": rf"""
WITH u AS (SELECT doc_id, [x FOR x IN string_split_regex(regexp_replace(text, '([.!?。！？])[{SPACES}\n\r]+', '\1' || chr(1), 'g'), '[\x01\n]+') IF regexp_replace(x, '[{SPACES}\n\r]+', '', 'g') <> ''] AS u FROM documents)
SELECT doc_id, len(u) AS n_units, coalesce(list_max([length(x) FOR x IN u]), 0) AS longest FROM u""",
    "chunk_ids": """
WITH d AS (SELECT doc_id, text, substr(sha256('/corpus/' || source || '/' || doc_id || '.txt'), 1, 24) AS document_id FROM documents)
SELECT doc_id, document_id, sha256(text) AS content_hash, substr(sha256(document_id || chr(0) || '0' || chr(0) || text), 1, 32) AS chunk_id FROM d""",
    "overlap_tail": """
SELECT doc_id, CASE WHEN length(text) <= 180 THEN text WHEN position(' ' IN right(text, 180)) > 0 THEN substr(right(text, 180), position(' ' IN right(text, 180)) + 1) ELSE right(text, 180) END AS tail FROM documents""",
    "span_clip": """
WITH d AS (SELECT doc_id, length(text) AS n, length(text) // 3 AS t FROM documents),
s AS (SELECT doc_id, n // 4 AS a, n // 2 AS z, unnest([{'s': 0, 'e': t, 'b': 7}, {'s': t, 'e': 2 * t, 'b': t + 9}, {'s': 2 * t, 'e': n, 'b': 2 * t + 11}], recursive := true) FROM d),
c AS (SELECT doc_id, a, s, b, greatest(a, s) AS l, least(z, e) AS r FROM s)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS span, 5 + l - a AS chunk_char_start, 5 + r - a AS chunk_char_end, b + l - s AS block_char_start, b + r - s AS block_char_end FROM c WHERE l < r""",
    "hash_embed_sparse": f"WITH {QUESTIONS}, {postings('qp', 'questions', 'query_id')} SELECT query_id, token_id, weight FROM qp",
    "hash_embed_dense": f"WITH {QUESTIONS}, {postings('qp', 'questions', 'query_id')}, {dense('qd', 'qp', 'query_id')} SELECT query_id, place, round(x, 6) AS x FROM qd",
    "vector_checks": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, len(v) AS dimensions, sqrt(list_sum([x * x FOR x IN v])) AS n FROM v)
SELECT vec_id, dimensions, round(n, 6) AS norm, n BETWEEN 0.98 AND 1.02 AS norm_ok FROM n""",
    "dense_topk": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v) AS score FROM v q CROSS JOIN v WHERE q.vec_id % 50 = 0)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
    "sparse_topk": f"WITH {sparse(10)} SELECT * FROM sparse",
    "rrf_hybrid": f"""
WITH {sparse(20)}, {dense('qd', 'qp', 'query_id')}, {dense('dd', 'dp', 'doc_id')},
near AS (SELECT query_id, doc_id, round(sum(q.x * d.x), 9) AS score FROM qd q JOIN dd d USING (place) GROUP BY ALL),
top AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= 20),
parts AS (SELECT query_id, doc_id, 1.0 / (1 + rank) AS s FROM top UNION ALL SELECT query_id, doc_id, 1.0 / (1 + rank) FROM sparse),
f AS (SELECT query_id, doc_id, round(sum(s::DOUBLE), 9) AS score FROM parts GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5""",
    "rerank_topk": f"""
WITH {sparse(30)}, h AS (SELECT s.query_id, s.doc_id, s.score AS retrieval_score, s.rank AS retrieval_rank, {overlap('q.text', 'd.text')} AS rerank_score FROM sparse s JOIN documents d USING (doc_id) JOIN questions q USING (query_id))
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, retrieval_rank) AS rank FROM h QUALIFY rank <= 10""",
    "route_decision": f"WITH {sparse(3)}, {JUDGED} SELECT * FROM actions",
    "allowed_parents": f"""
WITH {sparse(3)}, {JUDGED}
SELECT query_id, doc_id, relevance, action FROM judged JOIN actions USING (query_id) WHERE action <> 'Incorrect' AND (relevance = 'relevant' OR (action = 'Ambiguous' AND relevance = 'uncertain'))""",
    "judgment_problems": f"""
WITH {sparse(3)}, j AS (SELECT query_id, doc_id, CASE WHEN quality = 1 THEN 'relevant' WHEN toxic = 1 THEN 'bad' ELSE 'irrelevant' END AS relevance, CASE WHEN toxic = 1 THEN ' ' ELSE 'because' END AS reason FROM sparse JOIN labels USING (doc_id))
SELECT s.query_id, s.doc_id, CASE WHEN j.relevance IS NULL THEN 'missing' WHEN j.relevance = 'bad' THEN 'label' ELSE 'reason' END AS problem
FROM sparse s LEFT JOIN j USING (query_id, doc_id) WHERE j.relevance IS NULL OR j.relevance = 'bad' OR trim(j.reason) = ''""",
    "url_normalize": f"SELECT page_id, {URL} AS url FROM pages",
    "page_dedup": rf"""
WITH p AS (SELECT regexp_replace(url, '[?#].*$', '') AS raw, html FROM pages),
n AS (SELECT raw, html, regexp_replace(lower(regexp_extract(raw, '^([^:]+://[^/]+)', 1)), '$', '') || CASE WHEN regexp_extract(raw, '^[^:]+://[^/]+(.*)$', 1) = '' THEN '/' ELSE regexp_extract(raw, '^[^:]+://[^/]+(.*)$', 1) END AS url FROM p WHERE octet_length(encode(coalesce(html, ''))) <= 1000000),
o AS (SELECT url, html FROM n QUALIFY row_number() OVER (PARTITION BY url ORDER BY raw) = 1),
t AS (SELECT url, regexp_replace(substr({page_text("coalesce(html, '')")}, 1, 40000), '^[{SPACES}\n\r]+|[{SPACES}\n\r]+$', '', 'g') AS text FROM o)
SELECT url, sha256(text) AS content_sha256 FROM t WHERE text <> ''""",
    "lexical_preselect": f"""
WITH {sparse(5)}, h AS (SELECT s.query_id, s.doc_id, q.text AS query_text, string_split(d.text, chr(10)) AS l FROM sparse s JOIN documents d USING (doc_id) JOIN questions q USING (query_id)),
p AS (SELECT query_id, doc_id, query_text, unnest(l) AS passage, unnest(range(len(l))) AS passage_no FROM h),
o AS (SELECT *, {overlap('query_text', 'passage')} AS shared, count(*) OVER (PARTITION BY query_id, doc_id) AS n FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY shared DESC, passage_no) AS r FROM o),
k AS (SELECT * FROM r WHERE n <= 6 OR passage_no < 2 OR r <= 4)
SELECT query_id, doc_id, passage_no, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY passage_no) - 1 AS candidate_no, md5(passage) AS passage_md5 FROM k""",
    "web_query_rewrites": rf"""
WITH t AS (SELECT conv_id AS query_id, turn AS position, {COLLAPSED} AS text FROM conversations),
v AS (SELECT * FROM t WHERE length(text) BETWEEN 1 AND 200 AND NOT regexp_matches(text, '[\x00-\x1f]') QUALIFY row_number() OVER (PARTITION BY query_id, lower(text) ORDER BY position) = 1)
SELECT query_id, position, text FROM v QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY position) <= 2""",
    "context_budget": f"WITH RECURSIVE {BUDGET} SELECT query_id, place, doc_id, number, line_chars FROM kept",
    "context_status": f"""
WITH RECURSIVE {BUDGET}, three AS (SELECT query_id, doc_id FROM sparse WHERE rank <= 3),
{JUDGED.replace('FROM sparse s', 'FROM three s')},
c AS (SELECT query_id, count(*) AS n, sum(line_chars) AS chars, count(DISTINCT source_type) AS sources FROM kept GROUP BY 1)
SELECT query_id, CASE WHEN n IS NULL THEN 'no_evidence' WHEN action = 'Ambiguous' AND sources < 2 THEN 'partial' ELSE 'ready' END AS status, coalesce(chars + n - 1, 0) AS chars, coalesce(n, 0) AS markers FROM actions LEFT JOIN c USING (query_id)""",
    "branch_problems": f"""
WITH RECURSIVE {BUDGET}, three AS (SELECT query_id, doc_id FROM sparse WHERE rank <= 3),
{JUDGED.replace('FROM sparse s', 'FROM three s')}
SELECT query_id, doc_id::VARCHAR AS strip_id, CASE WHEN action = 'Correct' THEN 'web strip in a Correct branch' ELSE 'internal strip in an Incorrect branch' END AS problem
FROM kept JOIN actions USING (query_id) WHERE (action = 'Correct' AND source_type = 'web') OR (action = 'Incorrect' AND source_type = 'internal')""",
    "polarity_filter": rf"""
WITH t AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS source FROM conversations),
w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}]+') AS c, regexp_extract_all(lower(source), '[\p{{L}}\p{{M}}\p{{Nd}}]+') AS s, ['không', 'chưa', 'not', 'never', 'no'] AS no FROM t WHERE source IS NOT NULL AND text IS NOT NULL),
n AS (SELECT conv_id, turn, c, no, list_distinct([s[i + 1] || ' ' || s[i + 2] FOR i IN range(1, len(s) - 1) IF list_contains(no, s[i]) AND s[i + 1] <> 'chỉ']) AS turned FROM w),
h AS (SELECT conv_id, turn, len([p FOR p IN range(1, len(c)) IF list_contains(turned, c[p] || ' ' || c[p + 1]) AND NOT list_has_any(c[greatest(p - 5, 1):p - 1], no)]) AS hits FROM n)
SELECT conv_id, turn, hits > 0 AS reversed FROM h""",
    "mojibake_filter": r"""
SELECT doc_id, regexp_matches(text, '[ÃÂ][\x{0080}-\x{00bf}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]|\x{FFFD}|â€|ΓÇ') OR regexp_matches(text, '[\p{L}\p{M}\p{Nd}\p{Pc}]\x{00B4}(\s|$)') AS corrupted FROM documents""",
    "doc_status": f"""
WITH {HELD}
SELECT h.document_id, CASE WHEN chunk_count <> 1 THEN 'incomplete_update' WHEN pipeline_signature <> 'now' THEN 'outdated_pipeline' WHEN f.source_path IS NULL THEN 'source_missing' WHEN f.content_hash <> h.content_hash THEN 'source_changed' ELSE 'current' END AS status
FROM held h LEFT JOIN files f ON f.source_path = h.source_path""",
    "skip_unchanged": f"""
WITH {HELD} SELECT document_id FROM files f WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.document_id = f.document_id AND h.content_hash = f.content_hash AND h.pipeline_signature = 'now' AND h.chunk_count = 1)""",
    "doc_listing": f"WITH {SOURCE_INDEX}, {LISTING} SELECT * FROM listing",
    "mixed_index": f"WITH {SOURCE_INDEX}, {LISTING} SELECT document_id, n_chunks, chunk_count FROM listing WHERE index_incomplete",
    "stale_points": f"""
WITH {SOURCE_INDEX}, n AS (SELECT document_id, chunk_id || CASE WHEN ordinal % 2 = 0 THEN '' ELSE 'n' END AS chunk_id FROM ix)
SELECT document_id, chunk_id FROM ix WHERE document_id IN (SELECT document_id FROM n) AND chunk_id NOT IN (SELECT chunk_id FROM n)""",
    "replaced_index": f"""
WITH {SOURCE_INDEX} SELECT document_id, count(*) AS n, sum(char_count + 4)::BIGINT AS chars FROM ix GROUP BY 1""",
    "index_issues": f"""
WITH {SOURCE_INDEX}, {LISTING}, v AS (SELECT i.*, embedding::DOUBLE[] AS dense FROM ix i LEFT JOIN embeddings e ON e.vec_id = i.chunk_id::BIGINT),
n AS (SELECT sqrt(list_sum([x * x FOR x IN dense])) AS norm, len(dense) AS size FROM v),
x AS (
  SELECT 'incomplete_update' AS code FROM listing WHERE index_incomplete
  UNION ALL SELECT 'chunk_count_mismatch' FROM listing WHERE chunk_count <> n_chunks
  UNION ALL SELECT 'vector_dimensions' FROM n WHERE coalesce(size, -1) <> 64
  UNION ALL SELECT 'vector_norm' FROM n WHERE size = 64 AND norm NOT BETWEEN 0.98 AND 1.02
  UNION ALL SELECT 'sparse_vector_missing' FROM ix WHERE ordinal % 9 = 0
  UNION ALL SELECT 'sparse_vector_invalid' FROM ix WHERE ordinal % 9 <> 0 AND ordinal % 10 = 1
  UNION ALL SELECT 'char_count' FROM ix WHERE ordinal % 17 = 0)
SELECT 'error' AS severity, code, count(*) AS n FROM x GROUP BY 2""",
    "session_list": f"""
WITH {MESSAGES}, s AS (SELECT session_id, max(message_id) AS updated_at FROM m GROUP BY 1)
SELECT session_id, updated_at, coalesce((SELECT count(*) FROM m WHERE m.session_id = s.session_id AND role = 'user'), 0) AS turn_count FROM s""",
    "session_messages": f"""
WITH {MESSAGES}, u AS (SELECT * FROM m WHERE role IN ('user', 'assistant')),
g AS (SELECT session_id, count(*) AS n, md5(string_agg(role || ':' || text, chr(10) ORDER BY message_id)) AS digest FROM u GROUP BY 1)
SELECT s.session_id, n, digest FROM (SELECT DISTINCT session_id FROM m) s LEFT JOIN g USING (session_id)""",
    "session_title": f"WITH {MESSAGES} SELECT session_id, substr({COLLAPSED}, 1, 72) AS title FROM (SELECT session_id, arg_min(text, message_id) AS text FROM m WHERE role = 'user' GROUP BY 1)",
    "upload_names": r"""
WITH n AS (SELECT page_id, html, regexp_extract(url, '([^/]*)$', 1) || CASE WHEN page_id % 9 = 0 THEN '. ' WHEN page_id % 4 = 0 THEN '.md' WHEN page_id % 4 = 1 THEN '.TXT' ELSE '' END AS name FROM pages)
SELECT page_id, coalesce(length(name) BETWEEN 1 AND 180 AND NOT regexp_matches(name, '[/\\\\:*?"<>|\x00-\x1f]') AND NOT regexp_matches(name, '[ .]$') AND regexp_matches(lower(name), '.\.(txt|md|markdown|docx|pdf)$')
  AND octet_length(encode(html)) BETWEEN 1 AND 52428800, false) AS valid FROM n""",
    "managed_uploads": r"""
WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(source) ELSE source END AS folder FROM documents)
SELECT doc_id, doc_id % 3 = 0 AND doc_id % 2 = 0 AND regexp_matches(folder, '^[0-9a-f]{32}$') AS managed FROM p""",
    "run_summaries": f"""
WITH RECURSIVE {BUDGET}, three AS (SELECT query_id, doc_id FROM sparse WHERE rank <= 3),
{JUDGED.replace('FROM sparse s', 'FROM three s')},
c AS (SELECT query_id, count(*) AS n, count(DISTINCT source_type) AS sources FROM kept GROUP BY 1)
SELECT 'run-' || query_id AS run_id, action AS branch, CASE WHEN n IS NULL THEN 'no_evidence' WHEN action = 'Ambiguous' AND sources < 2 THEN 'partial' ELSE 'ready' END AS status, n AS n_citations
FROM actions LEFT JOIN c USING (query_id)""",
}
SQL |= layout_queries.SQL
SQL |= structure_queries.SQL | run_queries.SQL | stored_queries.SQL
