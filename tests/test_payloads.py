import json

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import artifacts, index
from tarnflow.operators.payloads import artifact_faults, decoded, payload_issues
from tarnflow.sources.pdf import parse_pdf
from tarnflow.streaming.ingest import ingest

GOOD = {
    "document_id": "d", "chunk_id": "c", "source_path": "/d", "content_hash": "h", "pipeline_signature": "s", "media_type": "text/plain", "chunk_count": 1,
    "ordinal": 0, "embedding_dimensions": 2, "text": "ab", "char_count": 2, "pages": [], "heading_path": [], "metadata": {},
}


def points(spark, payloads, dense=(0.6, 0.8), lexical=({5: 1.0})):
    rows = [(p if p is None or isinstance(p, str) else json.dumps(p), list(dense) if dense is not None else None, lexical) for p in payloads]
    return spark.createDataFrame(rows, "payload string, dense array<double>, lexical map<bigint,double>").selectExpr("*", "1 as text", "2 as fault", "3 as v")


def without(key):
    return {k: x for k, x in GOOD.items() if k != key}


@pytest.mark.parametrize(
    ("payload", "fault"),
    [
        (GOOD, None), (GOOD | {"ordinal": "3"}, None), (GOOD | {"ordinal": 3.7}, None), (GOOD | {"pages": [1, 2]}, None), (GOOD | {"text": ""}, None),
        (None, "json"), ("", "json"), ("[1]", "json"), ("{", "json"), ("null", "json"), ("{}", "ordinal"),
        (without("ordinal"), "ordinal"), (GOOD | {"ordinal": None}, "ordinal"), (GOOD | {"ordinal": "x"}, "ordinal"), (GOOD | {"ordinal": True}, "ordinal"), (GOOD | {"ordinal": [1]}, "ordinal"),
        (GOOD | {"embedding_dimensions": {}}, "embedding_dimensions"), (without("text"), "text"), (GOOD | {"char_count": None}, "char_count"), (without("char_count"), "char_count"),
        (GOOD | {"pages": None}, "pages"), (GOOD | {"pages": "1"}, "pages"), (GOOD | {"pages": [0]}, "pages"), (GOOD | {"pages": [1.5]}, "pages"), (GOOD | {"pages": ["1"]}, "pages"), (GOOD | {"pages": [None]}, "pages"),
        (GOOD | {"heading_path": [1]}, "heading_path"), (GOOD | {"heading_path": {}}, "heading_path"), (without("metadata"), "metadata"), (GOOD | {"metadata": []}, "metadata"),
        (GOOD | {"metadata": None, "heading_path": None}, "heading_path"),
    ],
)
def test_first_fault_of_a_payload(spark, payload, fault):
    assert [r["fault"] for r in decoded(points(spark, [payload])).collect()] == [fault]


def codes(frame):
    return sorted((r["code"], r["reason"], r["document_id"], r["chunk_id"]) for r in frame.collect())


def test_checks_stop_where_a_reader_would(spark):
    assert codes(payload_issues(points(spark, [GOOD]), 2)) == []
    # A text that is no string has no length to compare; a fault in the text hides its length, but not the vectors.
    assert codes(payload_issues(points(spark, [GOOD | {"text": 5, "char_count": 1}]), 2)) == [("char_count", None, "d", "c")]
    assert codes(payload_issues(points(spark, [without("text") | {"char_count": 9}], dense=[1.0]), 2)) == [("invalid_payload", "text", "d", "c"), ("vector_dimensions", None, "d", "c")]
    got = codes(payload_issues(points(spark, [without("ordinal")], dense=None, lexical=None), 2))
    assert got == [("incomplete_update", None, "d", None), ("invalid_payload", "ordinal", "d", "c"), ("ordinal_gap", None, "d", None)]
    assert [c for c, *_ in codes(payload_issues(points(spark, [GOOD], dense=[3.0, float("nan")], lexical={}), 2))] == ["sparse_vector_invalid", "vector_norm"]
    assert codes(payload_issues(points(spark, [GOOD | {"media_type": "application/pdf"}]), 2)) == [("pdf_page_missing", None, "d", "c")]


def test_codes_of_documents_and_of_the_collection(spark):
    long = GOOD | {"text": "é" * 300_000, "char_count": 300_000}
    twice = payload_issues(points(spark, [long, long]), 3, declared_points=3, status="red")
    assert codes(twice) == [
        ("chunk_count_mismatch", None, "d", None), ("collection_dimensions", None, "d", None), ("collection_status", "red", None, None), ("incomplete_update", None, "d", None),
        ("ordinal_gap", None, "d", None), ("point_count", None, None, None),
    ]
    assert codes(payload_issues(points(spark, []), 2, declared_points=0)) == []
    assert codes(payload_issues(points(spark, []), 2, declared_points=1, status="yellow")) == [("point_count", None, None, None)]
    assert codes(payload_issues(points(spark, [without("document_id")]), 2)) == []  # of no document


LISTING = "document_id string, source_path string, media_type string, content_hash string, pipeline_signature string, chunk_count int"


def faults(spark, kind, payload, images=()):
    listing = spark.createDataFrame([("d", "/d", kind, "h", "s", 1)], LISTING).selectExpr("*", "1 as v", "2 as at")
    processed = spark.createDataFrame([("d", p if isinstance(p, str) else json.dumps(p)) for p in payload], "document_id string, payload string")
    found = artifact_faults(listing, processed, spark.createDataFrame(list(images), "document_id string, sha256 string, content binary"))
    return [(r["block"], r["fault"]) for r in found.collect()]


def whole(*metadata, **changes):
    return {"document_id": "d", "content_hash": "h", "pipeline_signature": "s", "chunks": [{}], "blocks": [{"metadata": m} for m in metadata]} | changes


def test_faults_of_artifacts(spark):
    line = {"path": "/d", "start_line": 1, "end_line": 1, "start_char": 0, "end_char": 0}
    box = {"path": "/d", "page": 1, "bbox": [0, 1.5, 2, 3]}
    md, pdf = "text/markdown", "application/pdf"
    assert faults(spark, md, []) == [(None, "missing")]
    assert faults(spark, md, ["{"]) == [(None, "json")]
    assert faults(spark, md, [whole(content_hash=None)]) == [(None, "content_hash")]
    assert faults(spark, "text/plain", [whole({}, chunks=[])]) == [(None, "chunks")]
    assert faults(spark, "text/plain", [whole({})]) == faults(spark, md, [whole()]) == faults(spark, md, [whole({"source": line}, json.dumps({"source": line}))]) == []
    assert faults(spark, md, [whole({"source": line}, {})]) == [(1, "no_source")] == faults(spark, md, [whole({"source": line}, None)])
    assert faults(spark, md, [whole({"source": {k: x for k, x in line.items() if k != "end_line"}})]) == [(0, "source_keys")]
    assert faults(spark, md, [whole({"source": line | {"path": "/e"}})]) == [(0, "source_path")]
    for wrong in ({"start_line": 0}, {"start_line": 2}, {"start_char": -1}, {"start_char": 1}, {"end_char": "9"}):
        assert faults(spark, md, [whole({"source": line | wrong})]) == [(0, "source_range")]
    for wrong in ({"page": 0}, {"page": True}, {"bbox": [1, 2, 3]}, {"bbox": None}, {"bbox": [1, 2, 3, "4"]}):
        assert faults(spark, pdf, [whole({"source": box | wrong})]) == [(0, "source_box")]
    sha = "a0f52b02bc6dc9eb6e2d9d0aab49a3e5ad1a6ac4c6a5b8ac5a2a30c38fbe1aa6"
    shown = whole({"source": box}, {"source": box, "image": {"extracted_path": "x", "sha256": sha}})
    assert faults(spark, pdf, [shown]) == [(1, "image_missing")]
    assert faults(spark, pdf, [shown], [("d", sha, b"other"), ("e", sha, b"x")]) == [(1, "image_checksum")]
    assert faults(spark, pdf, [whole({"source": box, "image": {"extracted_path": ""}})]) == []


def pdf_with_image():
    text = b"BT /F1 10 Tf 12 TL 72 650 Td (A line of body text) Tj T* (and one more) Tj ET"
    return (
        b"%%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Kids[3 0 R]/MediaBox[0 0 612 792]>>endobj\n"
        b"3 0 obj<</Type/Page/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>/XObject<</I1 6 0 R>>>>>>endobj\n"
        b"4 0 obj<</Length %d>>stream\n%s\nendstream endobj\n5 0 obj<</Type/Font>>endobj\n6 0 obj<</Subtype/Image/Width 1/Height 1/Length 3>>stream\nRGB\nendstream endobj\n" % (len(text), text)
    )


def test_blocks_of_a_pdf_have_sources():
    out = parse_pdf(pdf_with_image(), "/d.pdf")
    sources = {b.kind: b.metadata["source"] for b in out.blocks}
    assert all(s["path"] == "/d.pdf" and s["page"] == 1 and len(s["bbox"]) == 4 for s in sources.values()) and set(sources) == {"image", "paragraph"}
    left, low, right, high = sources["paragraph"]["bbox"]
    assert (left, low, high) == (72, 638, 660) and right > 72


def test_ingested_artifacts_prove_their_sources_and_images(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.pdf").write_bytes(pdf_with_image())
    (tmp_path / "in/b.md").write_text("# Title\n\nA paragraph.\n")
    (tmp_path / "in/c.txt").write_text("!!! ??? ...")
    store, keep = index.IndexStore(spark, str(tmp_path / "ix")), artifacts.ArtifactStore(spark, str(tmp_path / "art"))
    got = {r["source_path"].rpartition("/")[2]: r["status"] for r in ingest(spark, str(tmp_path / "in"), store, keep=keep).collect()}
    assert got == {"a.pdf": "indexed", "b.md": "indexed", "c.txt": "no tokens"}
    kind = F.when(F.col("source_path").endswith("pdf"), "application/pdf").otherwise("text/markdown")
    listing = index.documents(store.read()).withColumn("media_type", kind)
    assert listing.count() == 2 and keep.images().count() == 1 and keep.faults(listing).collect() == []
    damaged = keep.images().withColumn("content", F.lit(b"RGX"))
    assert [r["fault"] for r in artifact_faults(listing, keep.processed(), damaged).collect()] == ["image_checksum"]
    keep.delete([listing.where("source_path LIKE '%pdf'").first()["document_id"]])
    assert keep.images().count() == 0 and [r["fault"] for r in keep.faults(listing).collect()] == ["missing"]
