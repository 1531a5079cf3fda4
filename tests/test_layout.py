"""Layout operators against plain loops over small pages."""

import random
import statistics

import pytest

from tarnflow.operators import layout

WORD = "doc long, page int, word_no long, text string, x0 double, top double, x1 double, bottom double, size double, bold boolean, italic boolean"
BY = ["doc", "page"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(rng, n, docs=3):
    out = []
    for k in range(n):
        x, top, wide = rng.randrange(0, 600, 5), rng.choice([rng.randrange(0, 40), rng.randrange(0, 700)]) + rng.choice([0, 0.5]), rng.randrange(1, 60)
        out.append((rng.randrange(docs), rng.randrange(2), k, rng.choice(["a", "bc,", "Wort", "é"]), float(x), float(top), float(x + wide), float(top + 10), rng.choice([8.0, 9.0, 12.5]), rng.random() < 0.5, rng.random() < 0.3))
    return out


def brute_rows(page, units=3.0):
    rows = []
    for w in sorted(page, key=lambda w: (w[5], w[4], w[2])):
        for row in rows:
            if abs(row[0][5] - w[5]) <= units:
                row.append(w)
                break
        else:
            rows.append([w])
    return rows


def brute_segments(all_words, width):
    out = []
    for key in sorted({w[:2] for w in all_words}):
        for r, row in enumerate(brute_rows([w for w in all_words if w[:2] == key])):
            row.sort(key=lambda w: (w[4], w[5], w[2]))
            cuts = [[row[0]]]
            for before, w in zip(row, row[1:], strict=False):
                if w[4] - before[6] > max(36.0, width * 0.08):
                    cuts.append([])
                cuts[-1].append(w)
            for s, own in enumerate(cuts):
                styles = [own[0][8:]]
                for w in own[1:]:
                    if w[8:] != styles[-1]:
                        styles.append(w[8:])
                out.append((*key, r, s, " ".join(w[3] for w in own), min(w[4] for w in own), min(w[5] for w in own), max(w[6] for w in own), max(w[7] for w in own),
                            statistics.median(w[8] for w in own), any(w[9] for w in own), any(w[10] for w in own), len(own), len(styles)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_equal_brute_force(spark, seed):
    rows = words(random.Random(seed), 400)
    rows += [(9, 0, 1000 + k, "x", 0.0, 2.0 * k, 5.0, 2.0 * k + 1, 9.0, False, False) for k in range(40)]  # a chain of near tops
    rows += [(8, 0, 2000 + k, "same", 10.0, 10.0, 20.0, 20.0, 9.0, False, False) for k in range(5)]
    dropped = [(7, 0, 1, None, 1.0, 1.0, 2.0, 2.0, 9.0, False, False), (7, 0, 2, "x", None, 1.0, 2.0, 2.0, 9.0, False, False), (7, 0, 3, "x", 1.0, None, 2.0, 2.0, 9.0, False, False)]
    df = spark.createDataFrame(rows + dropped, WORD).selectExpr("*", "1 as row_id0", "'x' as source")
    got = layout.segments(df, BY, 600.0).collect()
    assert sorted((*r[:-1], len(r["runs"])) for r in got) == sorted(brute_segments(rows, 600.0))
    assert all(" ".join(x["text"] for x in r["runs"]) == r["text"] for r in got)


def test_null_styles_and_no_words(spark):
    df = spark.createDataFrame([(1, 0, 1, "a", 0.0, 0.0, 5.0, 5.0, None, None, None)], WORD)
    (row,) = layout.segments(df, BY, 600.0).collect()
    assert (row["font_size"], row["bold"], row["italic"]) == (0.0, False, False)
    assert layout.segments(df.where("false"), BY, 600.0).count() == 0


def test_words_outside_boxes(spark):
    rng = random.Random(5)
    rows = words(rng, 500)
    boxes = []
    for _ in range(60):
        x, y, w, h = rng.randrange(600), rng.randrange(700), rng.choice([0, 3, 30, 200]), rng.choice([0, 5, 40, 500])
        boxes.append((rng.randrange(3), rng.randrange(2), float(x), float(y), float(x + w), float(y + h)))
    odd = [(0, 0, None, 0.0, 9.0, 9.0), (0, 0, 100.0, 0.0, 50.0, 900.0), boxes[0], boxes[0]]
    df = spark.createDataFrame(rows + [(0, 0, 999, "x", None, 1.0, 2.0, 3.0, 1.0, False, False)], WORD)
    held = spark.createDataFrame(boxes + odd, "doc long, page int, x0 double, top double, x1 double, bottom double").selectExpr("*", "1 as word_no")
    got = layout.outside(df, held, BY)
    inside = lambda w, b: w[:2] == b[:2] and b[2] <= (w[4] + w[6]) / 2 <= b[4] and b[3] <= (w[5] + w[7]) / 2 <= b[5]
    assert sorted(r["word_no"] for r in got.collect()) == sorted([w[2] for w in rows if not any(inside(w, b) for b in boxes)] + [999])
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert layout.outside(df, held.where("false"), BY).count() == len(rows) + 1


BLOCK = "doc long, page int, row_id long, segment long, text string, x0 double, top double, x1 double, bottom double"


def brute_columns(blocks, width, height):
    rows = {}
    for b in blocks:
        if b[2] is not None:
            rows.setdefault(b[2], []).append(b)
    rows = [sorted(r, key=lambda b: (b[5], b[3])) for r in rows.values() if len(r) > 1]
    good = [r for r in rows if height * 0.03 <= r[0][6] <= height * 0.9 and len(r[0][4]) >= 6 and len(r[-1][4]) >= 6 and r[0][7] < width * 0.58 and r[-1][5] > width * 0.42]
    last = float("inf")
    order = lambda b: (b[6], b[5], last if b[2] is None else b[2], b[3])
    if len(good) < 2:
        return [(b, None) for b in sorted(blocks, key=order)]
    line = statistics.median((r[0][7] + r[-1][5]) / 2 for r in rows)
    high = min(b[6] for b in blocks if b[7] <= line or b[5] >= line)
    group = lambda b: 1 if b[7] <= line else 2 if b[5] >= line else 0 if b[6] <= high else 3
    return [(b, group(b)) for b in sorted(blocks, key=lambda b: (group(b), *order(b)))]


def test_columns_equal_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for doc in range(12):
        for row in range(rng.randrange(1, 12)):
            top = 20.0 + 50 * row
            left, right = rng.choice(["left text", "x"]), rng.choice(["right text", "right text", "y"])
            kind = rng.randrange(4) if doc % 3 else 3
            if kind < 2:
                pages += [(doc, 0, row, 0, left, 50.0, top, 250.0, top + 9), (doc, 0, row, 1, right, 330.0, top, 560.0, top + 9)]
            else:
                pages.append((doc, 0, row, 0, "across the page", 50.0, top, rng.choice([200.0, 500.0]), top + 9))
        pages.append((doc, 0, None, 0, "a table", 40.0, rng.choice([0.0, 300.0]), 590.0, 400.0))
    got = layout.columns(spark.createDataFrame(pages, BLOCK).selectExpr("*", "1 as line"), BY, 600.0, 700.0).collect()
    for doc in range(12):
        own = sorted((r for r in got if r["doc"] == doc), key=lambda r: r["place"])
        assert [(tuple(r[c] for c in ("doc", "page", "row_id", "segment", "text", "x0", "top", "x1", "bottom")), r["reading_group"]) for r in own] == brute_columns([b for b in pages if b[0] == doc], 600.0, 700.0)
    assert {r["multi_column"] for r in got} == {True, False}


def test_headings_by_size(spark):
    schema = "document_id long, n int, text string, kind string, font_size double, top double, bottom double, page_height double, heading_level int"
    body = [(1, k, "word " * 30, "paragraph", 10.0, 100.0, 110.0, 800.0, None) for k in range(4)]
    rows = body + [
        (1, 10, "Large", "paragraph", 20.0, 100.0, 120.0, 800.0, None), (1, 11, "Smaller", "paragraph", 14.004, 100.0, 120.0, 800.0, None), (1, 12, "Same size", "paragraph", 14.0, 100.0, 120.0, 800.0, None),
        (1, 13, "A sentence. ", "paragraph", 20.0, 100.0, 120.0, 800.0, None), (1, 14, "two\nlines", "paragraph", 20.0, 100.0, 120.0, 800.0, None), (1, 15, "one line\n", "list_item", 20.0, 100.0, 120.0, 800.0, None),
        (1, 16, "x" * 181, "paragraph", 20.0, 100.0, 120.0, 800.0, None), (1, 17, "edge", "paragraph", 20.0, 1.0, 20.0, 800.0, None), (1, 18, "no page", "paragraph", 20.0, None, None, None, None),
        (1, 19, "code", "code", 30.0, 100.0, 120.0, 800.0, None), (1, 20, "given", "heading", None, None, None, None, 3), (1, 21, None, "paragraph", 20.0, 100.0, 120.0, 800.0, None),
        (1, 22, "11.4 is too small", "paragraph", 11.4, 100.0, 120.0, 800.0, None), (2, 1, "alone", "paragraph", 10.0, 100.0, 110.0, 800.0, None), (3, 1, "no size", "paragraph", None, None, None, None, None),
    ]
    got = {(r["document_id"], r["n"]): r["heading_level"] for r in layout.sized_headings(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(rows)
    assert {k: v for k, v in got.items() if v is not None} == {(1, 10): 1, (1, 11): 2, (1, 12): 2, (1, 15): 1, (1, 18): 1, (1, 20): 3}


def test_body_size_is_the_weighted_median(spark):
    rng, rows = random.Random(2), []
    for doc in range(30):
        for _ in range(rng.randrange(1, 8)):
            rows.append((doc, " ".join(["w"] * rng.randrange(0, 30)), float(rng.randrange(8, 12))))
    got = {r[0]: r[1] for r in layout.body_size(spark.createDataFrame(rows + [(99, "x", None)], "document_id long, text string, font_size double")).collect()}
    assert got == {d: statistics.median(s for k, t, s in rows if k == d for _ in range(max(1, min(20, len(t.split()))))) for d in range(30)}


def test_heading_paths_equal_a_stack(spark):
    rng, rows, wanted = random.Random(4), [], {}
    for doc in range(25):
        stack = []
        for n in range(rng.randrange(0, 40)):
            level = rng.choice([None, None, rng.randrange(1, 7), rng.randrange(1, 7)])
            text = rng.choice([f"h{n}", "same", None])
            if level:
                stack = [*stack[: level - 1], text or ""]
            rows.append((doc, n, level, text))
            wanted[doc, n] = list(stack)
    df = spark.createDataFrame(rows + [(99, 0, 0, "under"), (99, 1, 50, "over")], "doc long, n int, heading_level int, text string").selectExpr("*", "1 as i")
    got = {(r["doc"], r["n"]): r["heading_path"] for r in layout.heading_paths(df, ["doc"], ["n"]).collect()}
    assert got == wanted | {(99, 0): ["under"], (99, 1): ["under", "over"]}
    assert layout.heading_paths(df.where("false"), ["doc"], ["n"]).count() == 0
