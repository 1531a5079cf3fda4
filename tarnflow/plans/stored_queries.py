"""Queries of payloads and artifacts as they are stored, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import payloads
from .tables import read


def payload_issues(spark, d):
    """Documents as points of their source, with payloads of which some have keys that are missing, of a wrong type or untrue."""
    docs = read(spark, d, "documents")
    counts = docs.groupBy("source").agg(F.count("*").alias("n_source"), F.min("doc_id").alias("low"))
    rows = docs.join(counts, docs["source"].eqNullSafe(counts["source"]), "left").select(docs["*"], "n_source", "low")
    keys = {
        "document_id": "source",
        "chunk_id": "concat('c', doc_id)",
        "source_path": "concat('/corpus/', source)",
        "content_hash": "md5(source)",
        "pipeline_signature": "'now'",
        "media_type": "CASE WHEN doc_id % 7 = 0 THEN 'application/pdf' ELSE 'text/plain' END",
        "chunk_count": "n_source + CASE WHEN source = 'src5' THEN 1 ELSE 0 END",
        "ordinal": "CASE WHEN doc_id % 23 = 0 THEN 'first' ELSE concat(doc_id - low) END",
        "embedding_dimensions": "CASE WHEN doc_id % 41 = 0 THEN NULL WHEN doc_id % 83 = 0 THEN 3 ELSE 2 END",
        "text": "CASE WHEN doc_id % 19 = 0 THEN NULL ELSE text END",
        "char_count": "CASE WHEN doc_id % 31 = 0 THEN 'many' ELSE concat(length(text) + CASE WHEN doc_id % 29 = 0 THEN 1 ELSE 0 END) END",
        "heading_path": "CASE WHEN doc_id % 13 = 0 THEN NULL ELSE array(lang, 'part') END",
    }
    # Values of other types than the rest of a column has are put in as text: lists of pages, and what stands for metadata.
    head = "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in keys.items()) + "))"
    pages = "CASE WHEN doc_id % 11 = 0 THEN '\"1\"' WHEN doc_id % 37 = 0 THEN '[1, 0]' WHEN doc_id % 53 = 0 THEN '[true]' WHEN doc_id % 2 = 0 THEN '[]' ELSE '[2, 3]' END"
    payload = f"concat(trim(TRAILING '}}' FROM {head}), ', \"pages\": ', {pages}, ', \"metadata\": ', CASE WHEN doc_id % 17 = 0 THEN 'null' ELSE '{{\"k\": 1}}' END, CASE WHEN doc_id % 59 = 0 THEN '' ELSE '}}' END)"
    points = rows.selectExpr(
        f"{payload} AS payload",
        "CASE WHEN doc_id % 43 = 0 THEN array(1.0D) WHEN doc_id % 47 = 0 THEN array(3.0D, 4.0D) WHEN doc_id % 61 = 0 THEN NULL ELSE array(0.6D, 0.8D) END AS dense",
        "CASE WHEN doc_id % 67 = 0 THEN NULL WHEN doc_id % 71 = 0 THEN map(5L, -1.0D) ELSE map(5L, 1.0D) END AS lexical",
    )
    return payloads.payload_issues(points, 2, declared_points=0, status="red")


def artifact_faults(spark, d):
    """Documents as artifacts of one block a line, every other one as Markdown, every third as PDF with an image, with faults of every kind."""
    docs = read(spark, d, "documents").where("doc_id IS NOT NULL")
    listing = docs.selectExpr(
        "concat(doc_id) AS document_id", "concat('/corpus/', doc_id) AS source_path", "CASE WHEN doc_id % 3 = 0 THEN 'application/pdf' WHEN doc_id % 3 = 1 THEN 'text/markdown' ELSE 'text/plain' END AS media_type",
        "md5(text) AS content_hash", "'now' AS pipeline_signature", "CASE WHEN doc_id % 11 = 0 THEN 2 ELSE 1 END AS chunk_count",
    )
    path = "concat('/corpus/', doc_id, CASE WHEN doc_id % 13 = 0 AND i = 1 THEN '/other' ELSE '' END)"
    lines = f"named_struct('path', {path}, 'start_line', i + 1, 'end_line', CASE WHEN doc_id % 17 = 0 AND i = 2 THEN i ELSE i + 1 END, 'start_char', 0, 'end_char', CASE WHEN doc_id % 19 = 0 THEN NULL ELSE length(x) END)"
    box = f"named_struct('path', {path}, 'page', CASE WHEN doc_id % 23 = 0 THEN 0 ELSE i + 1 END, 'bbox', CASE WHEN doc_id % 29 = 0 THEN array(0.5D, 1D, 2D) ELSE array(0.5D, 1D, 2D, 3D) END)"
    image = "CASE WHEN i = 0 THEN named_struct('extracted_path', concat('/images/', doc_id), 'sha256', sha2(concat('image ', doc_id), 256)) END"
    plain = f"CASE WHEN doc_id % 31 = 0 AND i = 0 THEN '{{}}' ELSE to_json(named_struct('source', {lines})) END"
    pdf = f"CASE WHEN doc_id % 31 = 0 AND i = 0 THEN '{{}}' ELSE to_json(named_struct('source', {box}, 'image', {image})) END"
    blocks = f"transform(split(coalesce(text, ''), '\\n', -1), (x, i) -> named_struct('text', x, 'metadata', CASE WHEN doc_id % 3 = 0 THEN {pdf} ELSE {plain} END))"
    payload = f"to_json(named_struct('document_id', concat(doc_id), 'content_hash', CASE WHEN doc_id % 37 = 0 THEN 'old' ELSE md5(text) END, 'pipeline_signature', CASE WHEN doc_id % 41 = 0 THEN 'old' ELSE 'now' END, 'chunks', array('c'), 'blocks', {blocks}))"
    processed = docs.where("doc_id % 43 <> 0").selectExpr("concat(doc_id) AS document_id", f"substr({payload}, CASE WHEN doc_id % 47 = 0 THEN 2 ELSE 1 END) AS payload")
    images = docs.where("doc_id % 3 = 0 AND doc_id % 53 <> 0").selectExpr("concat(doc_id) AS document_id", "sha2(concat('image ', doc_id), 256) AS sha256", "encode(concat('image ', doc_id, CASE WHEN doc_id % 59 = 0 THEN '!' ELSE '' END), 'UTF-8') AS content")
    return payloads.artifact_faults(listing, processed, images)


QUERIES = {f.__name__: f for f in (payload_issues, artifact_faults)}

SQL = {
    "payload_issues": """
WITH t AS (SELECT doc_id, source, text, doc_id - min(doc_id) OVER (PARTITION BY source) AS ordinal, count(*) OVER (PARTITION BY source) AS n FROM documents),
f AS (SELECT *, CASE WHEN doc_id % 59 = 0 THEN 'json' WHEN doc_id % 23 = 0 THEN 'ordinal' WHEN doc_id % 41 = 0 THEN 'embedding_dimensions' WHEN doc_id % 19 = 0 OR text IS NULL THEN 'text'
  WHEN doc_id % 31 = 0 THEN 'char_count' WHEN doc_id % 11 = 0 OR doc_id % 37 = 0 OR doc_id % 53 = 0 THEN 'pages' WHEN doc_id % 13 = 0 THEN 'heading_path' WHEN doc_id % 17 = 0 THEN 'metadata' END AS fault,
  CASE WHEN doc_id % 59 <> 0 AND doc_id % 41 <> 0 THEN CASE WHEN doc_id % 83 = 0 THEN 3 ELSE 2 END END AS dims,
  CASE WHEN doc_id % 43 = 0 THEN 1 WHEN doc_id % 47 = 0 THEN 2 WHEN doc_id % 61 = 0 THEN -1 ELSE 2 END AS size FROM t),
v AS (SELECT *, coalesce(fault NOT IN ('json', 'ordinal', 'embedding_dimensions'), true) AS vectors FROM f),
own AS (
  SELECT 'invalid_payload' AS code, fault AS reason, * FROM v WHERE fault IS NOT NULL
  UNION ALL SELECT 'vector_dimensions', NULL, * FROM v WHERE vectors AND size <> dims
  UNION ALL SELECT 'vector_norm', NULL, * FROM v WHERE vectors AND size = dims AND doc_id % 47 = 0
  UNION ALL SELECT 'sparse_vector_missing', NULL, * FROM v WHERE vectors AND doc_id % 67 = 0
  UNION ALL SELECT 'sparse_vector_invalid', NULL, * FROM v WHERE vectors AND doc_id % 67 <> 0 AND doc_id % 71 = 0
  UNION ALL SELECT 'char_count', NULL, * FROM v WHERE vectors AND coalesce(fault NOT IN ('text', 'char_count'), true) AND doc_id % 29 = 0
  UNION ALL SELECT 'pdf_page_missing', NULL, * FROM v WHERE fault IS NULL AND doc_id % 7 = 0 AND doc_id % 2 = 0),
l AS (SELECT source, count(*) AS m, any_value(n) + CASE WHEN source = 'src5' THEN 1 ELSE 0 END AS declared, count(DISTINCT CASE WHEN doc_id % 23 <> 0 THEN ordinal END) AS o,
  min(CASE WHEN doc_id % 23 <> 0 THEN ordinal END) AS low, max(CASE WHEN doc_id % 23 <> 0 THEN ordinal END) AS high, max(dims) AS dims FROM f WHERE doc_id % 59 <> 0 AND source IS NOT NULL GROUP BY source),
g AS (SELECT *, coalesce(o <> m OR low <> 0 OR high <> m - 1, true) AS gap FROM l),
per AS (SELECT 'ordinal_gap' AS code, source FROM g WHERE gap UNION ALL SELECT 'chunk_count_mismatch', source FROM g WHERE declared <> m
  UNION ALL SELECT 'incomplete_update', source FROM g WHERE gap OR declared <> m UNION ALL SELECT 'collection_dimensions', source FROM g WHERE dims <> 2)
SELECT CASE code WHEN 'pdf_page_missing' THEN 'warning' ELSE 'error' END AS severity, code, reason, CASE WHEN doc_id % 59 <> 0 THEN source END AS document_id, CASE WHEN doc_id % 59 <> 0 THEN 'c' || doc_id END AS chunk_id FROM own
UNION ALL SELECT 'error', code, NULL, source, NULL FROM per
UNION ALL SELECT 'error', 'collection_status', 'red', NULL, NULL
UNION ALL SELECT 'error', 'point_count', NULL, NULL, NULL FROM documents HAVING count(*) <> 0""",
    "artifact_faults": r"""
WITH t AS (SELECT doc_id, doc_id % 3 AS k, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents WHERE doc_id IS NOT NULL),
w AS (SELECT *, CASE WHEN doc_id % 43 = 0 THEN 'missing' WHEN doc_id % 47 = 0 THEN 'json' WHEN doc_id % 37 = 0 THEN 'content_hash' WHEN doc_id % 41 = 0 THEN 'pipeline_signature' WHEN doc_id % 11 = 0 THEN 'chunks' END AS whole FROM t),
b AS (SELECT *, unnest(range(n)) AS i FROM w WHERE whole IS NULL AND k < 2),
s AS (SELECT doc_id, i, 1 AS step, CASE WHEN doc_id % 31 = 0 AND i = 0 THEN 'no_source' WHEN k = 1 AND doc_id % 19 = 0 THEN 'source_keys' WHEN doc_id % 13 = 0 AND i = 1 THEN 'source_path'
    WHEN k = 1 AND doc_id % 17 = 0 AND i = 2 THEN 'source_range' WHEN k = 0 AND (doc_id % 23 = 0 OR doc_id % 29 = 0) THEN 'source_box' END AS fault FROM b
  UNION ALL SELECT doc_id, i, 2, CASE WHEN doc_id % 53 = 0 THEN 'image_missing' WHEN doc_id % 59 = 0 THEN 'image_checksum' END FROM b WHERE k = 0 AND i = 0 AND doc_id % 31 <> 0)
SELECT doc_id::VARCHAR AS document_id, NULL::INT AS block, whole AS fault FROM w WHERE whole IS NOT NULL
UNION ALL SELECT doc_id::VARCHAR, i::INT, fault FROM s WHERE fault IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i, step) = 1""",
}
