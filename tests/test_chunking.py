import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnflow.config import Chunking, Refinement
from tarnflow.operators.chunking import chunk_document, overlap_tail, packed, piece_ranges, strip_ranges


def block(text, ordinal=0, page=None, path=()):
    return {"text": text, "ordinal": ordinal, "page": page, "kind": "paragraph", "heading_path": list(path), "metadata": None}


texts = st.lists(st.text(alphabet="ab .!?\nÀđ", min_size=1, max_size=300), min_size=1, max_size=5)


@settings(max_examples=80, deadline=None)
@given(texts, st.integers(100, 200), st.integers(0, 15), st.integers(0, 20))
def test_chunks_fit_and_lose_nothing(parts, limit, overlap, least):
    config = Chunking(limit, overlap, least)
    blocks = [block(t, i) for i, t in enumerate(parts)]
    rows = chunk_document("d", blocks, config)
    seen = {i: set() for i in range(len(parts))}
    for row in rows:
        assert row["char_count"] == len(row["text"]) <= limit
        for s in row["source_spans"]:
            a, z = s["block_char_start"], s["block_char_end"]
            assert row["text"][s["chunk_char_start"] : s["chunk_char_end"]] == parts[s["block_ordinal"]][a:z]
            seen[s["block_ordinal"]] |= set(range(a, z))
    for i, t in enumerate(parts):
        assert all(k in seen[i] for k, c in enumerate(t) if not c.isspace())
    assert len({r["chunk_id"] for r in rows}) == len(rows)


def test_short_tail_joins_the_group_before():
    assert packed([50, 50, 5], Chunking(104, 0, 10)) == [[0, 1], [2]]
    assert packed([50, 40, 5], Chunking(120, 0, 10)) == [[0, 1, 2]]
    assert packed([100, 5], Chunking(106, 0, 10)) == [[0], [1]]


def test_overlap_comes_from_base_text_and_shrinks():
    one, two = "y" * 30 + " two three", "z" * 48
    rows = chunk_document("d", [block(one, 0, 1), block(two, 1, 2), block("x" * 98, 2, 3)], Chunking(100, 8, 0))
    assert [r["text"] for r in rows] == [f"{one}\n\n{two}", "x" * 98]
    one, two = "y" * 70 + " three", "four " + "z" * 40
    rows = chunk_document("d", [block(one, 0, 1), block(two, 1, 2)], Chunking(100, 8, 0))
    assert rows[1]["text"] == f"three\n\n{two}"
    assert rows[1]["pages"] == [1, 2] and rows[1]["has_overlap"]


@pytest.mark.parametrize(("text", "limit", "out"), [("abc def", 4, "def"), ("abcdefgh", 3, "fgh"), ("a b c", 9, "a b c"), ("abc", 0, ""), ("", 5, "")])
def test_overlap_tail(text, limit, out):
    assert overlap_tail(text, limit) == out


def test_sentences_are_cut_only_where_a_block_is_too_long():
    assert piece_ranges("One. Two.", 20) == [(0, 9)]
    assert [("One. Two. " * 3)[a:z] for a, z in piece_ranges("One. Two. " * 3, 20)] == ["One.", "Two."] * 3
    assert [z - a for a, z in piece_ranges("x" * 25, 10)] == [10, 10, 5]


def test_strips_need_a_capital_and_respect_blank_lines():
    text = "First one. Second one. third goes on. Fourth.\n\nFifth."
    assert [text[a:z] for a, z in strip_ranges(text)] == ["First one. Second one. third goes on.", "Fourth.", "Fifth."]
    assert [z - a for a, z in strip_ranges("x" * 195, Refinement(80, 2, 12))] == [80, 80, 35]
    text = "không\n\nnhét vừa"
    assert strip_ranges(text) == [(0, len(text))]


def test_strips_cover_all_text():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("aB .!\n") for _ in range(400))
        spans = strip_ranges(text, Refinement(80, 2, 12))
        covered = {k for a, z in spans for k in range(a, z)}
        assert all(k in covered for k, c in enumerate(text) if not c.isspace())
        assert all(z - a <= 80 for a, z in spans)


def test_limits_are_checked():
    with pytest.raises(ValueError):
        Chunking(100, 100, 10)
    with pytest.raises(ValueError):
        Refinement(79, 1, 1)
    with pytest.raises(ValueError):
        Chunking(99, 0, 0)
