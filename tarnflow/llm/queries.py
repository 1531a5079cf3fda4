"""The queries of the operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import decontaminate, html_extract, merkle, minhash, neighbours, packing, sessions, substring, suffix_tree, suffixes, token_counts, toxicity, warc
from .common import read

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op9_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.corpus_scores(read(spark, sf_dir, "documents"))


def op10_minhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op1_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_words(read(spark, sf_dir, "documents"))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), TOKENIZER)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_tokens(read(spark, sf_dir, "documents"), TOKENIZER)


def op11_session_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sessions.conversation_events(read(spark, sf_dir, "conversations"))
    return sessions.session_versions(events).withColumnRenamed("total", "h_sum")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    thirds = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0
    return merkle.manifest(read(spark, sf_dir, "documents"), thirds)


def op13_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_bytes(read(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op1_html_consensus": op1_html_consensus,
    "op2_toxicity": op2_toxicity,
    "op3_benchmark_containment": op3_benchmark_containment,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_warc_round_trip": op6_warc_round_trip,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_token_counts": op8_token_counts,
    "op9_suffix_tree_scores": op9_suffix_tree_scores,
    "op10_minhash_near_duplicates": op10_minhash_near_duplicates,
    "op11_session_versions": op11_session_versions,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_repeated_bytes": op13_repeated_bytes,
}


def _crc32(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text: the shift register over its bits, lowest first."""
    bits = f"flatten([[(ascii(({text})[i]) >> k) & 1 FOR k IN range(0, 8)] FOR i IN range(1, len({text}) + 1)])"
    return f"xor(list_reduce([4294967295::BIGINT] || {bits}::BIGINT[], lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295)"


_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))

SQL = {
    "op3_benchmark_containment": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
q AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS c FROM s JOIN q USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment FROM m JOIN n USING (item_id) WHERE 100 * c >= 75 * n""",
    "op5_repeated_passages": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
x AS (SELECT r, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM d),
s AS (SELECT r, i, md5(array_to_string(w[i:i+34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
m AS (SELECT r, i, count(*) OVER (PARTITION BY h) > 1 AS again FROM s),
c AS (SELECT x.r, x.i, x.t, coalesce(max(m.again::INT) OVER (PARTITION BY x.r ORDER BY x.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM x LEFT JOIN m ON m.r = x.r AND m.i = x.i),
k AS (SELECT r, sum(gone)::BIGINT AS gone, coalesce(string_agg(t, ' ' ORDER BY i) FILTER (WHERE gone = 0), '') AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)""",
    "op6_warc_round_trip": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS h FROM pages),
x AS (SELECT page_id, octet_length(h) AS n, upper(sha1(h)) AS s FROM p),
f AS (SELECT page_id, n, s, min(page_id) OVER (PARTITION BY s) AS f,
  [instr('0123456789ABCDEF', s[i]) - 1 FOR i IN range(1, 41)] AS v FROM x)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((v[5 * k // 4 + 1] * 16 + coalesce(v[5 * k // 4 + 2], 0)) >> (3 - (5 * k) % 4)) & 31)::INT, 1) FOR k IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM f""",
    "op10_minhash_near_duplicates": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i+4], ' ') ELSE array_to_string(w, ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
k AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, k.component_id, d.doc_id = k.component_id AS kept
FROM documents d JOIN k ON k.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id""",
    "op11_session_versions": rf"""
WITH c AS (SELECT conv_id, turn, {_crc32("conv_id::VARCHAR")} AS c, {_crc32("(conv_id || ':' || turn)")} AS h FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
e AS (SELECT row_number() OVER () AS r, 2 * floor(conv_id / 8)::BIGINT + c % 2 AS u, (c // 2) % 7200 + 300 * turn + h % 600 AS t, h // 600 AS g, h FROM c),
b AS (SELECT r, u, t, h, floor(t / 3600)::BIGINT + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS b FROM e),
q AS (SELECT a.u, a.b AS now, b.r, b.t, b.h, b.b, lag(b.t) OVER (PARTITION BY a.u, a.b ORDER BY b.t, b.r) AS p FROM (SELECT DISTINCT u, b FROM b) a JOIN b ON b.u = a.u AND b.b <= a.b),
s AS (SELECT *, sum(coalesce((t - p > 420)::INT, 0)) OVER (PARTITION BY u, now ORDER BY t, r) AS k FROM q),
v AS (SELECT u, now, min(t) AS s, max(t) AS e, count(*) AS n, count(*) FILTER (WHERE b = now) AS n_new, sum(h)::BIGINT AS h FROM s GROUP BY u, now, k HAVING n_new > 0),
x AS (SELECT o.u, o.now, o.s, min(w.now) AS by_now FROM v o JOIN v w ON w.u = o.u AND w.now > o.now AND w.s <= o.s AND w.e >= o.e GROUP BY ALL),
y AS (SELECT x.u, x.now, x.s, x.by_now, w.s AS by_s FROM x JOIN v o ON o.u = x.u AND o.now = x.now AND o.s = x.s JOIN v w ON w.u = x.u AND w.now = x.by_now AND w.s <= o.s AND w.e >= o.e),
z AS (SELECT u, by_now, by_s, count(*) AS n FROM y GROUP BY ALL)
SELECT v.u::BIGINT AS "user", v.now::BIGINT AS batch, v.s::BIGINT AS start_s, v.e::BIGINT AS end_s, v.n AS n_events, v.n_new, coalesce(z.n, 0) AS n_retracted, v.h AS h_sum, y.by_now::BIGINT AS retracted_batch, y.by_s::BIGINT AS retracted_start_s
FROM v LEFT JOIN y ON y.u = v.u AND y.now = v.now AND y.s = v.s LEFT JOIN z ON z.u = v.u AND z.by_now = v.now AND z.by_s = v.s""",
    "op12_merkle_manifest": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_FIELDS} || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_FIELDS} || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed
  FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
t AS (SELECT g, 0 AS level, i, n, leaf AS h FROM l
  UNION ALL SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, level, i // 8, n),
r AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 100 AS level, j AS i, n, subroot AS h FROM r
  UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 8, n),
a AS (SELECT g, level, i, n, h FROM t UNION ALL SELECT '*', level, i, n, h FROM u),
s AS (SELECT g, level, i, coalesce(string_agg(h, '') OVER (PARTITION BY g, level, i // 8 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lo,
    coalesce(string_agg(h, '') OVER (PARTITION BY g, level, i // 8 ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS hi FROM a WHERE n > 1),
k AS (SELECT row_number() OVER () AS k, l.doc_id, l.g, l.i, l.leaf, l.changed, r.subroot, r.j FROM l JOIN r USING (g)),
w AS (SELECT k.k, s.level, s.lo, s.hi FROM k JOIN s ON s.g = k.g AND s.i = k.i // (8 ** s.level)::BIGINT
  UNION ALL SELECT k.k, s.level, s.lo, s.hi FROM k JOIN s ON s.g = '*' AND s.i = k.j // (8 ** (s.level - 100))::BIGINT),
o AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY level) AS step, lo, hi FROM w),
f AS (SELECT k, 0 AS step, coalesce(changed, leaf) AS h FROM k UNION ALL SELECT f.k, o.step, sha256(o.lo || f.h || o.hi) FROM f JOIN o ON o.k = f.k AND o.step = f.step + 1),
p AS (SELECT k, sha256(string_agg(lo || hi, '' ORDER BY step)) AS proof FROM o GROUP BY k),
z AS (SELECT k, arg_max(h, step) AS h FROM f GROUP BY k)
SELECT k.doc_id, k.leaf, k.subroot, x.h AS root, coalesce(p.proof, sha256('')) AS proof_sha256, z.h AS folded_root, z.h = x.h AS verified
FROM k JOIN z USING (k) LEFT JOIN p USING (k), (SELECT h FROM u WHERE n = 1) x""",
    "op13_repeated_bytes": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i - 1, 400)) AS m FROM (SELECT r, h, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
a AS (SELECT r, i, count(*) OVER (PARTITION BY m) > 1 AS again FROM w),
s AS (SELECT r, i, CASE WHEN i - 200 > lag(i, 1, -1000) OVER (PARTITION BY r ORDER BY i) THEN 1 ELSE 0 END AS new FROM a WHERE again),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM s),
c AS (SELECT r, min(i) AS a, max(i) + 199 AS b FROM g GROUP BY r, k),
k AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS z FROM c),
t AS (SELECT k.r, count(*) AS spans, sum(b - a + 1)::BIGINT AS gone, string_agg(substr(d.h, 2 * z + 1, 2 * (a - z - 1)), '' ORDER BY a) || substr(any_value(d.h), 2 * max(b) + 1) AS kept FROM k JOIN d USING (r) GROUP BY k.r)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN t USING (r)""",
}
