"""Parts of SQL (DuckDB) that the twins of several queries share."""

from __future__ import annotations

SPACES = r"\t\x0b\f \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"

CLEAN = rf"""
trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(regexp_replace(nfc_normalize(text), '\r\n?', chr(10), 'g'), chr(173), ''), chr(160), ' '),
  '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[{SPACES}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g'), ' ' || chr(10))"""


def terms(text: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({text}), '{WORD}{{2,}}'))"


def overlap(a: str, b: str) -> str:
    return f"len(list_intersect({terms(a)}, {terms(b)}))::DOUBLE"


def postings(name: str, table: str, key: str) -> str:
    """name(key, token_id, sign, weight)."""
    return rf"""
{name} AS (SELECT {key}, ('0x' || substr(h, 1, 8))::BIGINT AS token_id, CASE WHEN ('0x' || substr(h, 9, 2))::BIGINT % 2 = 1 THEN 1 ELSE -1 END AS sign, sum(n)::DOUBLE AS weight
  FROM (SELECT {key}, sha256(w) AS h, count(*) AS n FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '{WORD}+')) AS w FROM {table}) GROUP BY ALL) GROUP BY ALL)"""


def dense(name: str, posts: str, key: str) -> str:
    """name(key, place, x): components at length 1."""
    return f"""
{name}_p AS (SELECT {key}, (token_id % 64)::INT AS place, sum(sign * weight) AS x FROM {posts} GROUP BY ALL),
{name}_k AS (SELECT DISTINCT {key} FROM {posts}),
{name}_a AS (SELECT {key}, g.place::INT AS place, coalesce(x, 0.0) AS x FROM {name}_k CROSS JOIN range(64) g(place) LEFT JOIN {name}_p USING ({key}, place)),
{name} AS (SELECT {key}, place, CASE WHEN sqrt(sum(x * x) OVER (PARTITION BY {key})) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY {key})) ELSE x END AS x FROM {name}_a)"""


QUESTIONS = "questions AS (SELECT item_id AS query_id, text FROM benchmark)"


def sparse(k: int) -> str:
    """sparse(query_id, doc_id, score, rank)."""
    return f"""
{QUESTIONS}, {postings("qp", "questions", "query_id")}, {postings("dp", "documents", "doc_id")},
scored AS (SELECT query_id, doc_id, sum(q.weight * d.weight) AS score FROM qp q JOIN dp d USING (token_id) GROUP BY ALL),
sparse AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {k})"""


JUDGED = """
judged AS (SELECT s.*, CASE quality WHEN 1 THEN 'relevant' WHEN 0 THEN 'irrelevant' ELSE 'uncertain' END AS relevance FROM sparse s LEFT JOIN labels l USING (doc_id)),
actions AS (SELECT q.query_id, CASE WHEN bool_or(relevance = 'relevant') THEN 'Correct' WHEN count(relevance) = 0 OR bool_and(relevance = 'irrelevant') THEN 'Incorrect' ELSE 'Ambiguous' END AS action, count(relevance) AS n_hits
  FROM questions q LEFT JOIN judged j USING (query_id) GROUP BY 1)"""

BUDGET = (
    sparse(12)
    + """,
item AS (SELECT query_id, rank AS place, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'web' ELSE 'internal' END AS source_type, text FROM sparse JOIN documents USING (doc_id)),
fold AS (SELECT query_id, 0 AS place, 0 AS used, 0 AS number, false AS taken, 0 AS line_chars FROM questions
  UNION ALL SELECT query_id, i.place, CASE WHEN ok THEN used + cost ELSE used END, CASE WHEN ok THEN number + 1 ELSE number END, ok, n
  FROM (SELECT f.query_id, f.used, f.number, i.place, n, n + CASE WHEN f.number > 0 THEN 1 ELSE 0 END AS cost, f.used + n + CASE WHEN f.number > 0 THEN 1 ELSE 0 END <= 40000 AS ok
    FROM fold f JOIN (SELECT query_id, place, doc_id, source_type, text FROM item) i ON i.query_id = f.query_id AND i.place = f.place + 1,
    LATERAL (SELECT length('{"citation":"[' || (f.number + 1) || ']","source_type":"' || i.source_type || '","source_ref":"' || i.doc_id || '","text":' || to_json(i.text)::VARCHAR || '}')::INT AS n)) i),
kept AS (SELECT f.query_id, f.place, i.doc_id, i.source_type, i.text, f.number, f.line_chars FROM fold f JOIN item i USING (query_id, place) WHERE f.taken)"""
)

HELD = """
held AS (SELECT doc_id::VARCHAR AS document_id, '/corpus/' || CASE WHEN doc_id % 11 = 0 THEN 'gone/' ELSE '' END || doc_id AS source_path, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(text) END AS content_hash,
  CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE 'now' END AS pipeline_signature, CASE WHEN doc_id % 13 = 0 THEN 2 ELSE 1 END AS chunk_count FROM documents),
files AS (SELECT doc_id::VARCHAR AS document_id, '/corpus/' || doc_id AS source_path, sha256(text) AS content_hash FROM documents)"""

SOURCE_INDEX = """
ix AS (SELECT source AS document_id, '/corpus/' || source AS source_path, md5(source) AS content_hash, CASE WHEN doc_id = 3 THEN 'old' ELSE 'now' END AS pipeline_signature,
  count(*) OVER (PARTITION BY source) + CASE WHEN source = 'src5' THEN 1 ELSE 0 END AS chunk_count, doc_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ordinal, text, length(text) AS char_count FROM documents)"""

LISTING = """
listing AS (SELECT document_id, min(source_path) AS source_path, min(content_hash) AS content_hash, min(pipeline_signature) AS pipeline_signature, min(chunk_count) AS chunk_count, count(*) AS n_chunks,
  count(*) <> min(chunk_count) OR count(DISTINCT ordinal) <> count(*) OR min(ordinal) <> 0 OR max(ordinal) <> count(*) - 1
  OR count(DISTINCT (source_path, content_hash, pipeline_signature, chunk_count)) <> 1 AS index_incomplete FROM ix GROUP BY 1)"""

MESSAGES = "m AS (SELECT conv_id * 1000 + turn AS message_id, conv_id::VARCHAR AS session_id, role, text FROM conversations)"
COLLAPSED = rf"trim(regexp_replace(text, '[{SPACES}\n\r]+', ' ', 'g'))"
LINES = rf"[y FOR y IN [regexp_replace(x, '^[{SPACES}\r\n]+|[{SPACES}\r\n]+$', '', 'g') FOR x IN string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{0085}}\x{{2028}}\x{{2029}}]')] IF y <> '']"


def key(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '\p{{Nd}}+', '#', 'g'), '[{SPACES}\n\r]+', ' ', 'g'))"


BLANK = rf"[{SPACES}\n\r\x1c-\x1f]"


def pieces(limit: int, table: str, ends: str, marked: str, whole: bool) -> str:
    """piece(doc_id, r, a, z): ranges of sentences, cut at a space in their second half or at the limit; a text that fits is one if whole."""
    half = limit // 2
    return rf"""
sentence AS (SELECT doc_id, (unnest(range(1, len(p) + 1, 2)))::INT AS k, p FROM (SELECT doc_id, string_split({'CASE WHEN length(t) <= ' + str(limit) + ' THEN t ELSE ' if whole else ''}regexp_replace(t, '{ends}', '{marked}', 'g'){' END' if whole else ''}, chr(1)) AS p FROM {table})),
bare AS (SELECT doc_id, k, coalesce(list_sum([length(x) FOR x IN p[1:k-1]]), 0)::INT AS pos, p[k] AS x FROM sentence),
cuts AS (SELECT doc_id, k, (pos + length(x) - length(regexp_replace(x, '^{BLANK}+', '')))::INT AS here, (pos + length(regexp_replace(x, '{BLANK}+$', '')))::INT AS stop, NULL::INT AS a, NULL::INT AS z FROM bare
  UNION ALL SELECT doc_id, k, (cut + length(substr(t, cut + 1, stop - cut)) - length(regexp_replace(substr(t, cut + 1, stop - cut), '^{BLANK}+', '')))::INT, stop, here, (here + length(regexp_replace(substr(t, here + 1, cut - here), '{BLANK}+$', '')))::INT
  FROM (SELECT c.*, t, CASE WHEN contains(substr(t, here + {half + 1}, {half + 1}), ' ') THEN here + {limit} - length(regexp_extract(substr(t, here + {half + 1}, {half + 1}), '[^ ]*$')) ELSE here + {limit} END AS cut
    FROM cuts c JOIN {table} USING (doc_id) WHERE stop - here > {limit})),
piece AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY a) AS r, a, z
  FROM (SELECT doc_id, a, z FROM cuts WHERE a < z UNION ALL SELECT doc_id, here, stop FROM cuts WHERE here < stop AND stop - here <= {limit}))"""


STRIP_STEPS = rf"""
{pieces(360, "txt", f"([.!?。！？])({BLANK}+)([A-ZÀ-ỴĐ])", chr(92) + "1" + chr(1) + chr(92) + "2" + chr(1) + chr(92) + "3", False)},
near AS (SELECT doc_id, r, a, z, contains(substr(t, lag(z) OVER w + 1, a - lag(z) OVER w), chr(10) || chr(10)) AS apart FROM piece JOIN txt USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY r)),
strip_fold AS (SELECT doc_id, r, 1 AS g, a AS first, z, 1 AS held FROM near WHERE r = 1
  UNION ALL SELECT n.doc_id, n.r, CASE WHEN ok THEN g ELSE g + 1 END, CASE WHEN ok THEN first ELSE n.a END, n.z, CASE WHEN ok THEN held + 1 ELSE 1 END
  FROM (SELECT f.g, f.first, f.held, n.*, f.held < 2 AND n.z - f.first <= 360 AND NOT n.apart AS ok FROM strip_fold f JOIN near n ON n.doc_id = f.doc_id AND n.r = f.r + 1) n),
strips AS (SELECT doc_id, a AS start, z AS "end", substr(t, a + 1, z - a) AS strip FROM (SELECT doc_id, g, min(first) AS a, max(z) AS z FROM strip_fold GROUP BY ALL) JOIN txt USING (doc_id))"""
STRIPS = f"txt AS (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL), {STRIP_STEPS}"


def tail(text: str, limit: str) -> str:
    last = f"right({text}, {limit})"
    return f"CASE WHEN {limit} <= 0 THEN '' WHEN length({text}) <= {limit} THEN {text} WHEN contains({last}, ' ') THEN substr({last}, position(' ' IN {last}) + 1) ELSE {last} END"


CHUNKS = rf"""
txt AS (SELECT doc_id, t FROM (SELECT doc_id, {CLEAN} AS t FROM documents) WHERE t <> ''),
{pieces(1200, "txt", f"([.!?。！？])({BLANK}+)|({chr(92)}n+)", chr(92) + "1" + chr(1) + chr(92) + "2" + chr(92) + "3" + chr(1), True)},
pack AS (SELECT doc_id, r, 1 AS g, z - a AS size, z - a AS n FROM piece WHERE r = 1
  UNION ALL SELECT p.doc_id, p.r, CASE WHEN size + 2 + p.z - p.a <= 1200 THEN g ELSE g + 1 END, CASE WHEN size + 2 + p.z - p.a <= 1200 THEN size + 2 + p.z - p.a ELSE p.z - p.a END, p.z - p.a
  FROM pack f JOIN piece p ON p.doc_id = f.doc_id AND p.r = f.r + 1),
sizes AS (SELECT doc_id, g, max(size) AS size, max(g) OVER (PARTITION BY doc_id) AS groups, lag(max(size)) OVER (PARTITION BY doc_id ORDER BY g) AS before FROM pack GROUP BY doc_id, g),
member AS (SELECT doc_id, r, CASE WHEN g > 1 AND g = groups AND s.size < 120 AND before + 2 + s.size <= 1200 THEN g - 1 ELSE g END AS g FROM pack JOIN sizes s USING (doc_id, g)),
placed AS (SELECT doc_id, g, r, a, z, substr(t, a + 1, z - a) AS x, (sum(z - a + 2) OVER (PARTITION BY doc_id, g ORDER BY r) - (z - a + 2))::INT AS s FROM member JOIN piece USING (doc_id, r) JOIN txt USING (doc_id)),
base AS (SELECT doc_id, g, string_agg(x, chr(10) || chr(10) ORDER BY r) AS base FROM placed GROUP BY ALL),
prior AS (SELECT doc_id, g, base, coalesce(lag(base) OVER w, '') AS before, {tail("coalesce(lag(base) OVER w, '')", "180")} AS shared FROM base WINDOW w AS (PARTITION BY doc_id ORDER BY g)),
joined AS (SELECT doc_id, g, base, before, CASE WHEN shared <> '' AND 1200 - length(base) - 2 < length(shared) THEN {tail("shared", "(1200 - length(base) - 2)")} ELSE shared END AS shared FROM prior),
chunk AS (SELECT doc_id, (g - 1)::INT AS ordinal, base, before, shared, CASE WHEN shared <> '' THEN shared || chr(10) || chr(10) ELSE '' END || base AS text FROM joined)"""

URL = r"""lower(regexp_extract(url, '^([^:]+)', 1)) || '://' || lower(regexp_extract(url, '^[^:]+://([^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[^:]+://[^/?#]+([^?#]*)', 1) END
  || regexp_extract(url, '(\?[^#]+)', 1)"""


def page_text(html: str) -> str:
    """For pages as the tables have them: ignored elements are closed and not in one another."""
    x = rf"regexp_replace({html}, '<!--.*?-->|<![^>]*>', '', 'gs')"
    for tag in ("script", "style", "nav", "footer", "header", "aside", "form", "svg", "noscript"):
        x = rf"regexp_replace({x}, '<{tag}[ >].*?</{tag}>', '', 'gis')"
    x = rf"regexp_replace({x}, '</?(p|h[1-6]|li|blockquote|tr)( [^>]*)?>', chr(10) || chr(10), 'gi')"
    x = rf"regexp_replace(regexp_replace({x}, '<(br|td|th)( [^>]*)?/?>', ' ', 'gi'), '</?[a-zA-Z][^>]*>', '', 'g')"
    for name, code in (("quot", 34), ("middot", 183), ("copy", 169), ("lt", 60), ("gt", 62), ("nbsp", 160), ("amp", 38)):
        x = f"replace({x}, '&{name};', chr({code}))"
    x = rf"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t\r\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n\n\n+', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


PASSAGES = rf"""
{QUESTIONS},
once AS (SELECT {URL} AS url, html FROM pages WHERE octet_length(encode(coalesce(html, ''))) <= 1000000 QUALIFY row_number() OVER (PARTITION BY {URL} ORDER BY pages.url) = 1),
read AS (SELECT url, regexp_replace(substr({page_text("coalesce(html, '')")}, 1, 40000), '^[{SPACES}\n\r]+|[{SPACES}\n\r]+$', '', 'g') AS text FROM once),
fetched AS (SELECT url, text, sha256(text) AS content_sha256 FROM read WHERE text <> ''),
{postings("qp", "questions", "query_id")}, {postings("pp", "fetched", "url")},
found AS (SELECT query_id, url, sum(q.weight * d.weight) AS score FROM qp q JOIN pp d USING (token_id) GROUP BY ALL),
web AS (SELECT query_id, url, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, url) AS place FROM found QUALIFY place <= 5),
txt AS (SELECT url AS doc_id, text AS t FROM fetched), {STRIP_STEPS},
passage AS (SELECT query_id, url, place, content_sha256, start, "end", strip AS passage, {overlap("q.text", "strip")} AS shared, row_number() OVER (PARTITION BY query_id, url ORDER BY start) - 1 AS passage_no, count(*) OVER (PARTITION BY query_id, url) AS n
  FROM web JOIN questions q USING (query_id) JOIN fetched USING (url) JOIN strips ON doc_id = url),
likely AS (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY passage_no) - 1 AS candidate_no
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, url ORDER BY shared DESC, passage_no) AS r FROM passage) WHERE n <= 60 OR passage_no < 8 OR r <= 60 - 8),
best AS (SELECT query_id, url, 'web:' || substr(sha256(url || chr(0) || content_sha256 || chr(0) || start || chr(0) || "end"), 1, 24) AS strip_id, start, "end", passage, candidate_no, shared AS rerank_score, place, 1.0::DOUBLE / (place + 1) AS retrieval_score
  FROM likely QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY shared DESC, candidate_no) <= 4)"""

VECTOR_HITS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, v, [x / sqrt(list_sum([y * y FOR y IN v])) FOR x IN v] AS u FROM v),
hits AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.v, v.v), 9) AS score FROM v q CROSS JOIN v WHERE q.vec_id % 50 = 0) QUALIFY rank <= 20)"""

CHUNK_SPANS = """
own AS (
  SELECT doc_id, ordinal, r, a - s AS shift, greatest(s, length(before) - length(shared)) AS l, least(s + z - a, length(before)) AS e, length(before) - length(shared) AS less, true AS is_overlap FROM chunk JOIN placed p USING (doc_id) WHERE p.g = ordinal AND shared <> ''
  UNION ALL SELECT doc_id, ordinal, r, a - s, s, s + z - a, CASE WHEN shared <> '' THEN -length(shared) - 2 ELSE 0 END, false FROM chunk JOIN placed p USING (doc_id) WHERE p.g = ordinal + 1)"""
