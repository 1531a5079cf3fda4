import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tarnflow.llm.packing import pack, pack_documents
from tarnflow.llm.token_counts import count_tokens, document_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_no_capacity_is_passed(rule):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 100, 500)
    bins, offsets = pack(lengths, 100, 4, 6000.0 + 100**2, rule)
    per = defaultdict(list)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        per[b].append((o, n))
    for items in per.values():
        items.sort()
        assert len(items) <= 4 and sum(n for _, n in items) <= 100 and sum(n * n for _, n in items) <= 16000
        assert [o for o, _ in items] == list(np.cumsum([0] + [n for _, n in items])[:-1])


def test_best_fit_fills_sequences():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 1025, 4000)
    bins, _ = pack(lengths, 1024, 1024, 1024.0**2)
    assert bins.max() + 1 <= 1.02 * max(-(-lengths.sum() // 1024), (lengths > 512).sum())


def test_bad_items_are_refused():
    with pytest.raises(ValueError):
        pack(np.array([5]), 4, 1, 100.0)
    with pytest.raises(ValueError):
        pack(np.array([5]), 10, 1, 100.0, "best")


ROWS = [(1, "Hello world. " * 400), (2, None), (3, ""), (4, "short é 日本"), (4, "short é 日本"), (None, "x"), (5, "<|endoftext|> in text"), (6, "word " * 2000), (7, "a\n\n  b\t c  d  ")]


def test_pieces_hold_all_ids(make_docs):
    tokenizer = Tokenizer.from_file(PATH)
    got = pack_documents(make_docs(ROWS), PATH).collect()
    wanted = []
    for doc_id, text in ROWS:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        wanted += [(doc_id, k, a, z - a, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr) == sorted(wanted, key=repr)
    per = defaultdict(list)
    for r in got:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in per.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 1024


def by_sequence(got):
    per = defaultdict(list)
    for r in got:
        per[r["sequence_id"]].append(r["length"])
    return per


def test_equal_rows_are_dealt_to_many_groups(make_docs):
    docs = make_docs([(1, "x")]).selectExpr("cast(null as long) doc_id", "'one and the same' text", "explode(sequence(1, 20000))")
    got = pack_documents(docs, PATH, group=500).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r["sequence_id"] >> 32] += 1
    assert len(got) == 20000 and len(sizes) == 40 and max(sizes.values()) < 700


def test_number_of_sequences_through_the_query(make_docs):
    rng = np.random.default_rng(3)
    got = pack_documents(make_docs([(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 1500, 1500))]), PATH).collect()
    lengths = np.array([r["length"] for r in got])
    assert len(by_sequence(got)) <= 1.02 * max(-(-lengths.sum() // 1024), (lengths > 512).sum())


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_documents_and_attention_bind_through_the_query(make_docs, rule):
    rng = np.random.default_rng(4)
    docs = make_docs([(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 25, 400))])
    per = by_sequence(pack_documents(docs, PATH, documents=3, attention=1000.0, tokens=64, rule=rule).collect())
    assert all(len(x) <= 3 and sum(x) <= 64 and sum(n * n for n in x) <= 1000 for x in per.values())
    assert any(len(x) == 3 for x in per.values())


def test_token_files_count_as_the_tokenizer(make_docs):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    got = document_tokens(make_docs(ROWS), PATH).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in got), key=repr) == sorted(((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids)) for d, t in ROWS), key=repr)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 5000])
def test_blocks_are_stitched(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    rows, wanted = [], set()
    for k in range(4):
        ids = rng.choice([9, 1, 2], 60, p=[0.2, 0.4, 0.4]).astype("<u2") if k else np.array([1] * 40 + [9], "<u2")
        path = tmp_path / f"{k}.tok"
        ids.tofile(path)
        rows.append((f"file://{path}", ids.nbytes))
        parts = np.split(ids, np.flatnonzero(ids == 9))
        lengths = [len(p) - (i > 0) for i, p in enumerate(parts)]
        wanted |= {(rows[-1][0], i, n) for i, n in enumerate(lengths) if i < len(lengths) - 1 or n}
    rows.append((f"file://{tmp_path}/empty.tok", 0))
    got = count_tokens(spark.createDataFrame(rows, "file string, n_bytes long"), 9, block=block)
    assert {(r["file"], r["ordinal"], r["n_tokens"]) for r in got.collect()} == wanted


def test_long_runs_are_carried_over_spans(spark, tmp_path, monkeypatch):
    import tarnflow.llm.token_counts as t

    monkeypatch.setattr(t, "SPAN", 3)
    ids = np.array([1] * 31 + [9] + [1] * 2 + [9] + [1] * 50, "<u2")
    ids.tofile(tmp_path / "a.tok")
    got = t.count_tokens(spark.createDataFrame([(f"file://{tmp_path}/a.tok", ids.nbytes)], "file string, n_bytes long"), 9, block=2)
    assert sorted((r["ordinal"], r["n_tokens"]) for r in got.collect()) == [(0, 31), (1, 2), (2, 50)]


def test_no_rows(make_docs):
    assert pack_documents(make_docs([]), PATH).count() == 0
    assert document_tokens(make_docs([]), PATH).count() == 0


def test_ids_that_do_not_fit_are_refused(make_docs):
    docs = make_docs([(1, "plain words of a text")])
    for wrong in ({"kind": "u1", "end": 255}, {"kind": "<u2", "end": 70_000}, {"kind": "<u2", "end": int(Tokenizer.from_file(PATH).encode("plain words", add_special_tokens=False).ids[0])}):
        with pytest.raises(Exception, match="does not fit|end identifier"):
            document_tokens(docs, PATH, **wrong).collect()
