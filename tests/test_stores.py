import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tarnflow.operators import artifacts, evidence, index
from tarnflow.operators.chat import NEW_TITLE, ChatStore
from tarnflow.sources.decode import decode
from tarnflow.streaming.ingest import ingest

DOCUMENT = "0123456789abcdef01234567"


def rows(spark, documents, text="t", path=None):
    out = [(d, path or f"/{d}", "h", "s", n, f"{d}{k}{text}", k, text, len(text), [1.0, 0.0], {1: 1.0}) for d, n in documents for k in range(n)]
    return spark.createDataFrame(out, "document_id string, source_path string, content_hash string, pipeline_signature string, chunk_count int, chunk_id string, ordinal int, text string, char_count int, dense array<double>, lexical map<bigint,double>")


def seen(store):
    return sorted((r["document_id"], r["ordinal"], r["text"]) for r in store.read().collect()) if store.read() is not None else []


def test_changes_equal_a_dictionary(spark, tmp_path):
    store, held, rng = index.IndexStore(spark, str(tmp_path / "ix"), fan=2), {}, random.Random(2)
    for step in range(8):
        if step % 4 == 3:
            names = rng.sample([f"d{i}" for i in range(30)], 6)
            store.delete(names)
            for n in names:
                held.pop(n, None)
        else:
            names = {f"d{rng.randrange(30)}": rng.randrange(1, 4) for _ in range(6)}
            store.replace(rows(spark, list(names.items()), f"s{step}"), 2)
            held |= {n: [(n, k, f"s{step}") for k in range(c)] for n, c in names.items()}
        assert seen(store) == sorted(x for own in held.values() for x in own)
        assert len(store.manifest()) <= 4
    store.vacuum()
    assert seen(store) == sorted(x for own in held.values() for x in own)
    assert {x.getName() for x in store._children("segments")} == {s["name"] for s in store.manifest()}


def test_a_change_writes_its_own_rows_and_a_level_once_more(spark, tmp_path, monkeypatch):
    store, wrote = index.IndexStore(spark, str(tmp_path / "ix"), fan=3), []
    segment = store._segment
    monkeypatch.setattr(store, "_segment", lambda *a: wrote.append(s := segment(*a)) or s)
    for step in range(10):
        store.replace(rows(spark, [(f"d{step}-{i}", 1) for i in range(10)]), 2)
    assert store.read().count() == 100
    assert sum(s["rows"] for s in wrote) <= 3 * 100 and len(store.manifest()) <= 2 * 3
    big = index.IndexStore(spark, str(tmp_path / "big"), fan=2)
    monkeypatch.setattr(index, "LEVEL_ROWS", 10)
    big.write(rows(spark, [("many", 200)]))
    for step in range(3):
        big.replace(rows(spark, [(f"d{step}", 1)]), 2)
    assert [s["rows"] for s in big.manifest()][0] == 200  # a large segment is not written again for small ones


def test_of_two_writers_one_commits(spark, tmp_path, monkeypatch):
    store, other = (index.IndexStore(spark, str(tmp_path / "ix")) for _ in range(2))
    store.replace(rows(spark, [("a", 2)]), 2)
    segment = store._segment

    def late(*a):
        out = segment(*a)
        other.replace(rows(spark, [("b", 1)], "other"), 2)
        return out

    monkeypatch.setattr(store, "_segment", late)
    with pytest.raises(index.Conflict):
        store.replace(rows(spark, [("b", 3)], "late"), 2)
    monkeypatch.undo()
    assert seen(store) == [("a", 0, "t"), ("a", 1, "t"), ("b", 0, "other")] and store.pending() is None
    assert len(store._children("segments")) == 2  # the loser's is gone
    with ThreadPoolExecutor(6) as pool:
        def publish(k):
            try:
                store._publish(100, [{"name": str(k), "level": 0, "rows": 0, "deletes": False}])
                return True
            except index.Conflict:
                return False
        assert sum(pool.map(publish, range(6))) == 1


def test_a_document_of_another_id_takes_a_path(spark, tmp_path):
    store = index.IndexStore(spark, str(tmp_path / "ix"))
    assert store.read() is None and store.chunks("a") is None and store.delete(["a"]) is None
    store.replace(rows(spark, [("d7", 3), ("d9", 2)]), 2)
    store.replace(rows(spark, [("d7", 1)], "new"), 2)
    store.replace(rows(spark, [("other", 1)], path="/d9"), 2)
    assert [r["text"] for r in store.chunks("d7").collect()] == ["new"]
    assert store.chunks("d9").count() == 0 and store.chunks("other").count() == 1
    before = store.manifest(1)
    store.delete(["d7", "other", "unknown"])
    assert store.read() is None and store.chunks("d7").count() == 0 and store.manifest(1) == before
    store.replace(rows(spark, [("d7", 2)], "again"), 2)
    assert seen(store) == [("d7", 0, "again"), ("d7", 1, "again")]


def test_a_failed_change_leaves_the_index_and_no_marker(spark, tmp_path, monkeypatch):
    store = index.IndexStore(spark, str(tmp_path / "ix"))
    store.replace(rows(spark, [("a", 2)]), 2)
    monkeypatch.setattr(store, "_commit", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        store.replace(rows(spark, [("a", 1)], "new"), 2)
    assert store.pending() is None and store.read().count() == 2
    monkeypatch.undo()
    rows(spark, [("a", 1)]).select("document_id").write.parquet(f"{store.folder}/pending/lost")  # as a lost job leaves it
    listing = index.documents(store.read(), store.pending()).collect()
    assert [r["index_incomplete"] for r in listing] == [True]
    store.replace(rows(spark, [("a", 1)], "new"), 2)
    assert store.pending() is None and [r["text"] for r in store.read().collect()] == ["new"]


@pytest.mark.parametrize(("dense", "lexical"), [([float("inf"), 1.0], {1: 1.0}), ([0.0, 0.0], {1: 1.0}), ([1.0], {1: 1.0}), ([1.0, 0.0], {-1: 1.0}), ([1.0, 0.0], {1: float("nan")}), ([1.0, 0.0], {})])
def test_bad_vectors_are_refused(spark, tmp_path, dense, lexical):
    new = rows(spark, [("a", 1)]).withColumns({"dense": F.lit(dense).cast("array<double>"), "lexical": F.lit(None).cast("map<bigint,double>") if not lexical else F.create_map(*(F.lit(x) for p in lexical.items() for x in p)).cast("map<bigint,double>")})
    with pytest.raises(ValueError):
        index.IndexStore(spark, str(tmp_path / "ix")).replace(new, 2)


def test_schema_is_reported(spark):
    own = rows(spark, [("a", 2)])
    assert index.schema_report(own, 2)["status"] == "ready" and index.schema_report(own, 3)["status"] == "collection_dimensions"
    assert index.schema_report(own.limit(0), 2)["status"] == "empty" and index.schema_report(own.drop("dense"), 2)["status"] == "hybrid_schema"
    codes = [r["code"] for r in index.issues(own.drop("dense"), 2).collect()]
    assert codes == ["hybrid_schema"]


def test_stored_again_after_delete(spark, tmp_path):
    store = artifacts.ArtifactStore(spark, str(tmp_path / "a"))
    files = spark.createDataFrame([(DOCUMENT, "/x.txt", bytearray(b"abc"))], "document_id string, path string, content binary")
    for _ in range(2):
        store.store_raw(files)
        store.store_raw(files)
        assert store.raw().count() == 1
        store.delete([DOCUMENT])
        assert store.raw().count() == 0


def test_ingest_keeps_copies_that_can_be_opened(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("One paragraph of text.\n\nAnother paragraph of text.")
    (tmp_path / "in" / "blank.txt").write_text(" \n ")
    store, keep = index.IndexStore(spark, str(tmp_path / "ix")), artifacts.ArtifactStore(spark, str(tmp_path / "art"))
    first = {r["source_path"].rpartition("/")[2]: r["status"] for r in ingest(spark, str(tmp_path / "in"), store, keep=keep).collect()}
    assert first["a.txt"] == "indexed" and first["blank.txt"] not in ("indexed", "skipped")
    again = {r["source_path"].rpartition("/")[2]: r["status"] for r in ingest(spark, str(tmp_path / "in"), store, keep=keep).collect()}
    assert again["a.txt"] == "skipped"
    listing = index.documents(store.read())
    row = listing.first()
    assert keep.source_file(row["document_id"], row["content_hash"]).startswith(b"One paragraph")
    assert index.artifact_issues(listing, keep.raw(), keep.processed()).isEmpty()


def test_chat_store(spark, tmp_path):
    store = ChatStore(spark, str(tmp_path / "chat"))
    a, b = store.create(), store.create()
    assert store.get(a)["title"] == NEW_TITLE and store.get(a)["messages"] == []
    store.append(a, "  What   is\nthis? " + "x" * 100, "0" * 32, "An answer", '{"answer": {"text": "An answer"}}')
    store.append(a, "More", "1" * 32, None, "{}")
    got = store.get(a)
    assert got["title"] == ("What is this? " + "x" * 100)[:72] and got["turn_count"] == 2
    assert [m["role"] for m in got["messages"]] == ["user", "assistant"] * 2 and got["messages"][1]["result"]["answer"]["text"] == "An answer"
    store.rename(b, "  My   title ")
    assert [(r["session_id"], r["title"]) for r in store.sessions().collect()] == [(b, "My title"), (a, got["title"])]
    store.delete(b)
    assert [r["session_id"] for r in store.sessions().collect()] == [a]
    for call in (lambda: store.get(b), lambda: store.rename("f" * 32, "x")):
        with pytest.raises(KeyError):
            call()
    for call in (lambda: store.get("x"), lambda: store.rename(a, " "), lambda: store.append(a, " ", "0" * 32, None, "{}"), lambda: store.append(a, "q", "run", None, "{}")):
        with pytest.raises(ValueError):
            call()


def test_upload_store(spark, tmp_path):
    store = artifacts.UploadStore(spark, str(tmp_path / "up"))
    path = store.write("a.txt", b"one")
    assert open(path, "rb").read() == b"one"
    own = spark.range(1).select(artifacts.managed_upload(F.lit(path), index.document_id(F.lit(path)), str(tmp_path / "up")).alias("m"))
    assert own.first()["m"]
    with pytest.raises(ValueError):
        store.replace(path, b"")
    assert open(path, "rb").read() == b"one"
    store.replace(path, b"two")
    assert open(path, "rb").read() == b"two"
    outside = tmp_path / "b.txt"
    outside.write_text("x")
    for call in (lambda: store.delete(str(outside)), lambda: store.write("../a.txt", b"x"), lambda: store.write("a.exe", b"x")):
        with pytest.raises(ValueError):
            call()
    store.delete(path)
    assert outside.exists() and not list((tmp_path / "up").rglob("*.txt"))


def test_answers_after_two_attempts(spark):
    contexts = spark.createDataFrame([(1, "ready"), (2, "ready"), (3, "partial"), (4, "no_evidence"), (5, "ready")], "query_id long, status string")
    claim = "query_id long, claim_no int, text string, refs array<string>"
    sources = spark.createDataFrame([(q, f"[{k}]", "It is not possible here.") for q in (1, 2, 3, 5) for k in (1, 2, 10)], "query_id long, marker string, text string")
    bad = "c� t�"
    first = spark.createDataFrame([(1, 1, "fine", ["[10]", "[2]"]), (1, 2, "also", ["[1]"]), (3, 1, "some", ["[1]"]), (5, 1, bad, ["[1]"])], claim)
    second = spark.createDataFrame([(1, 1, "not used", ["[1]"]), (5, 1, bad, ["[1]"])], claim)
    got = {r["query_id"]: r for r in evidence.answer_rounds(contexts, first, second, sources).collect()}
    assert got[1]["used"] == ["[1]", "[2]", "[10]"] and got[1]["attempts"] == 1 and got[1]["text"] == "fine [10] [2]\nalso [1]"
    assert (got[2]["status"], got[2]["attempts"], got[2]["retry"], got[2]["text"]) == ("model_abstained", 2, "abstained_with_ready_context", evidence.ABSTAINED_TEXT)
    assert got[3]["status"] == "partial" and got[3]["text"] == f"{evidence.PARTIAL_NOTICE}\nsome [1]"
    assert (got[4]["status"], got[4]["attempts"], got[4]["text"]) == ("insufficient_evidence", 1, evidence.NO_ANSWER_TEXT)
    assert got[5]["problem"] == "corrupted_unicode" and got[5]["text"] == ""
    replies = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True)], "query_id long, answerable boolean")
    assert sorted(r["query_id"] for r in evidence.conflicts(replies, first).collect()) == [3, 4]


def test_utf8_comes_before_guesses():
    assert decode(b"h\0i\0").encoding == "utf-8"
    assert decode("é".encode("utf-16-le") * 3 + b"\x41\x00" * 20).encoding == "utf-16-le"
