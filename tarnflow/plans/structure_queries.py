"""Queries of operators/structure.py and operators/provenance.py, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, provenance, structure
from .sql_parts import CHUNK_SPANS, CHUNKS, STRIP_STEPS
from .tables import read

_PARENT = "CASE WHEN master_id <> client_id THEN master_id ELSE client_id div 3 END"


def inherited_clients(spark, d):
    """City and segment of a client from its masters, those of a master from the client of a third of its number."""
    clients = read(spark, d, "clients").select("client_id", F.expr(_PARENT).alias("parent"), "city", F.when(F.col("client_id") % 4 == 0, F.col("segment")).alias("segment"))
    return structure.inherited(clients, "client_id", "parent", ["city", "segment"]).drop("parent")


def nested_tables(spark, d):
    """A conversation as a table of turns: role, text; a text of several sentences is a table of them, a sentence with commas a table of its parts."""
    turns = read(spark, d, "conversations").where("turn IS NOT NULL").select("conv_id", F.col("turn").cast("int").alias("row"), "role", F.split("text", r"[.] ").alias("s"))
    sentences = turns.select("conv_id", "row", F.posexplode("s").alias("sentence", "t")).withColumn("pieces", F.split("t", ", "))
    name = lambda *c: F.concat_ws("/", *(F.col(x).cast("string") for x in c))
    zero, none = F.lit(0), F.lit(None).cast("string")
    part = lambda table, row, cell, text, nested: [F.col("conv_id"), table.alias("table"), row.alias("row"), cell.alias("cell"), F.lit(0).alias("part"), text.alias("text"), nested.alias("nested")]
    several = F.size("s") > 1
    one, many = F.size("pieces") <= 1, F.size("pieces") > 1
    inner = F.when(several, name("conv_id", "row")).when(F.size(F.split(F.col("s")[0], ", ")) > 1, F.concat(name("conv_id", "row"), F.lit("/0")))
    top = name("conv_id")
    parts = turns.select(*part(top, F.col("row"), zero, F.col("role"), none)).unionByName(turns.select(*part(top, F.col("row"), F.lit(1), F.when(inner.isNull(), F.col("s")[0]), inner)))
    count = F.max("sentence").over(Window.partitionBy("conv_id", "row")) > 0
    middle = sentences.withColumn("count", count).where("count")
    parts = parts.unionByName(middle.select(*part(name("conv_id", "row"), F.col("sentence"), zero, F.when(one, F.col("t")), F.when(many, name("conv_id", "row", "sentence")))))
    last = sentences.where(many).select("conv_id", "row", "sentence", F.posexplode("pieces").alias("k", "piece"))
    parts = parts.unionByName(last.select(*part(name("conv_id", "row", "sentence"), zero, F.col("k"), F.col("piece"), none)))
    return structure.rendered_tables(parts, ["conv_id"]).select("conv_id", "table", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


def _chunks(spark, d):
    """Chunks of documents of one block each; of a span's start in its block follow a page and a heading path."""
    docs = read(spark, d, "documents")
    no_path = F.array().cast("array<string>")
    blocks = docs.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(0).alias("ordinal"), T.clean_text(F.col("text")).alias("text"), F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("page"), no_path.alias("heading_path"), F.lit(None).cast("string").alias("metadata")).where("text <> ''")
    page = lambda s: (F.floor(s["block_char_start"] / 1000) + 1).cast("int")
    path = lambda s: F.when(page(s) % 3 == 0, no_path).otherwise(F.array(F.concat(F.lit("part "), (page(s) % 4).cast("string"))))
    spans = F.transform("source_spans", lambda s: s.withField("page", page(s)).withField("heading_path", path(s)))
    return blocks, chunking.chunks(blocks).withColumn("source_spans", spans)


def strip_provenance(spark, d):
    chunks = _chunks(spark, d)[1].withColumn("key", F.struct(F.col("document_id").cast("long").alias("doc_id"), "ordinal"))
    strips = provenance.strips_of(chunks, "key")
    paths = F.array_join(F.transform("heading_paths", lambda p: F.array_join(p, ">")), "|")
    return strips.select("key.doc_id", "key.ordinal", "start", "end", F.size("source_spans").alias("n_spans"), F.array_join("pages", ",").alias("pages"), F.array_join("heading_path", ">").alias("heading_path"), paths.alias("heading_paths"), "has_overlap")


def chunk_proof(spark, d):
    """Chunks against their blocks; of every fifth document the chunks' first characters are changed, of others a character is added at the end."""
    blocks, chunks = _chunks(spark, d)
    of = F.col("document_id").cast("long") % 5
    changed = F.when(of == 1, F.concat(F.lit("#"), F.substring("text", 2, 1 << 30))).when(of == 2, F.concat("text", F.lit("#"))).otherwise(F.col("text"))
    wrong = provenance.unproven(chunks.withColumn("text", changed), blocks)
    return wrong.groupBy(F.col("document_id").cast("long").alias("doc_id"), "code").agg(F.count("*").alias("n_chunks"), F.sum("spans").alias("n_spans"))


QUERIES = {f.__name__: f for f in (inherited_clients, nested_tables, strip_provenance, chunk_proof)}

_LINES = "array_to_string([s FOR s IN list_filter({}, lambda x: trim(x, ' |') <> '')], chr(10))"


def _inset(text: str, depth: int) -> str:
    return f"('[Nested table]' || chr(10) || '{'  ' * depth}' || replace({text}, chr(10), chr(10) || '{'  ' * depth}'))"


def _row(parts: str) -> str:
    """A table of one row: its cells."""
    return f"CASE WHEN trim(array_to_string([trim(x, ' ') FOR x IN {parts}], ' | '), ' |') <> '' THEN array_to_string([trim(x, ' ') FOR x IN {parts}], ' | ') ELSE '' END"


_SENTENCE = f"""CASE WHEN len(string_split(t, ', ')) > 1 THEN CASE WHEN {_row("string_split(t, ', ')")} = '' THEN '' ELSE {{}} END ELSE trim(t, ' ') END"""

SQL = {
    "inherited_clients": """
WITH RECURSIVE c AS (SELECT client_id, CASE WHEN master_id <> client_id THEN master_id ELSE client_id // 3 END AS parent, city, CASE WHEN client_id % 4 = 0 THEN segment END AS segment FROM clients),
walk AS (SELECT client_id AS k, client_id AS at, [client_id] AS seen, 0 AS step FROM c
  UNION ALL SELECT w.k, c.parent, list_append(w.seen, c.parent), w.step + 1 FROM walk w JOIN c ON c.client_id = w.at WHERE c.parent IS NOT NULL AND NOT list_contains(w.seen, c.parent)),
met AS (SELECT w.k, w.step, c.* FROM walk w JOIN c ON c.client_id = w.at)
SELECT k AS client_id, arg_min(city, step) FILTER (WHERE city IS NOT NULL) AS city, arg_min(client_id, step) FILTER (WHERE city IS NOT NULL) AS city_from,
  arg_min(segment, step) FILTER (WHERE segment IS NOT NULL) AS segment, arg_min(client_id, step) FILTER (WHERE segment IS NOT NULL) AS segment_from FROM met GROUP BY k""",
    "nested_tables": f"""
WITH turns AS (SELECT conv_id, turn, role, string_split(text, '. ') AS s FROM conversations WHERE turn IS NOT NULL),
lines AS (SELECT conv_id, turn, role, CASE WHEN len(s) > 1 THEN [{_SENTENCE.format(_inset(_row("string_split(t, ', ')"), 2))} FOR t IN s] END AS l, [{_SENTENCE.format(_inset(_row("string_split(t, ', ')"), 1))} FOR t IN s][1] AS one FROM turns),
cells AS (SELECT conv_id, turn, coalesce(trim(role, ' '), '') AS a, CASE WHEN l IS NULL THEN coalesce(one, '') WHEN {_LINES.format("l")} = '' THEN '' ELSE {_inset(_LINES.format("l"), 1)} END AS b FROM lines),
shown AS (SELECT conv_id, turn, a || ' | ' || b AS line FROM cells WHERE trim(a || ' | ' || b, ' |') <> ''),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS text FROM shown GROUP BY 1)
SELECT conv_id, conv_id::VARCHAR AS "table", length(text) AS n_chars, md5(text) AS text_md5 FROM texts""",
    "strip_provenance": f"""
WITH RECURSIVE chunked AS (WITH RECURSIVE {CHUNKS} SELECT doc_id * 1000000 + ordinal AS k, text FROM chunk),
spans AS (WITH RECURSIVE {CHUNKS}, {CHUNK_SPANS} SELECT doc_id * 1000000 + ordinal AS k, l - less AS a, e - less AS z, 1 + (l + shift) // 1000 AS page, is_overlap FROM own WHERE l < e),
txt AS (SELECT k AS doc_id, text AS t FROM chunked), {STRIP_STEPS},
met AS (SELECT s.doc_id AS k, s.start, s."end", p.a, p.page, CASE WHEN p.page % 3 = 0 THEN NULL ELSE 'part ' || (p.page % 4) END AS path, p.is_overlap
  FROM strips s LEFT JOIN spans p ON p.k = s.doc_id AND p.a < s."end" AND p.z > s.start),
paths AS (SELECT k, start, path, min(a) AS a FROM met WHERE path IS NOT NULL GROUP BY ALL),
listed AS (SELECT k, start, string_agg(path, '|' ORDER BY a) AS paths, arg_min(path, a) AS path FROM paths GROUP BY ALL),
pages AS (SELECT k, start, string_agg(page::VARCHAR, ',' ORDER BY page) AS pages FROM (SELECT DISTINCT k, start, page FROM met WHERE page IS NOT NULL) GROUP BY ALL)
SELECT k // 1000000 AS doc_id, (k % 1000000)::INT AS ordinal, start, "end", count(a) AS n_spans, coalesce(any_value(pages), '') AS pages, coalesce(any_value(path), '') AS heading_path,
  coalesce(any_value(paths), '') AS heading_paths, coalesce(bool_or(is_overlap), false) AS has_overlap
FROM (SELECT m.k, m.start, m."end", m.a, m.is_overlap FROM met m) m LEFT JOIN listed USING (k, start) LEFT JOIN pages USING (k, start) GROUP BY k, start, "end\"""",
    "chunk_proof": f"""
WITH RECURSIVE {CHUNKS}, {CHUNK_SPANS},
first AS (SELECT o.doc_id, o.ordinal, count(*) AS n FROM own o JOIN chunk c USING (doc_id, ordinal) WHERE o.doc_id % 5 = 1 AND l < e AND l - less = 0 AND left(c.text, 1) <> '#' GROUP BY ALL)
SELECT doc_id, 'span_text' AS code, count(*) AS n_chunks, sum(n)::BIGINT AS n_spans FROM first GROUP BY 1
UNION ALL SELECT doc_id, 'span_gap', count(*), count(*) FROM chunk c
  WHERE doc_id % 5 = 2 OR (doc_id % 5 = 1 AND NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = c.doc_id AND o.ordinal = c.ordinal AND l < e AND l - less = 0)) GROUP BY 1""",
}
