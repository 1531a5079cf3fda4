import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm.merkle import manifest
from tarnflow.llm.sessions import ActiveEvents, conversation_events, session_versions, unit_versions
from tarnflow.llm.suffixes import Classes, multikey_quicksort, packed, repeated_bytes

# -- repeated bytes --


def brute_bytes(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i + 1 : i + 1 + width] = True
        edges = np.flatnonzero(np.diff(gone.astype(int))).tolist()
        kept = bytes(b for b, g in zip(t, gone[1:], strict=False) if not g)
        out.append((d, len(t), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), tuple(edges)))
    return sorted(out, key=repr)


def texts(width):
    rng = random.Random(3)
    make = lambda n: "".join(rng.choice("abcdefghé ß") for _ in range(n))
    shared = [make(width + k) for k in (-30, 0, 1, 37, 300)]
    rows = []
    for k in range(80):
        text = make(rng.randrange(0, 500))
        for p in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(len(text) + 1)
            text = text[:at] + p + text[at:]
        rows.append((k, text))
    rows += [(100, "a" * (width + 30)), (101, "a" * (width - 1)), (102, None), (103, ""), (None, shared[1]), (7, "again"), (7, "again"), (104, "ab" * width), (105, make(30_000))]
    return rows + [(200 + i, shared[4]) for i in range(20)]


@pytest.mark.parametrize(("width", "gram"), [(200, 48), (40, 8), (24, 24)])
def test_removed_bytes_equal_brute_force(make_docs, width, gram):
    rows = texts(width)
    got = repeated_bytes(make_docs(rows), width, gram).collect()
    assert sorted([(*r[:5], tuple(r["spans"])) for r in got], key=repr) == brute_bytes(rows, width)


def test_a_passage_in_many_contexts_is_cut_between_buckets(make_docs, spark):
    """One passage shorter than a window in many contexts, and contexts that repeat, over more buckets than suffixes fit."""
    rng = random.Random(5)
    make = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    common, before, after = make(60), make(70), make(70)
    rows = [(k, (before if k % 3 == 0 else make(70)) + common + (after if k % 4 == 0 else make(70))) for k in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = repeated_bytes(make_docs(rows), 100, 20).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted([(*r[:5], tuple(r["spans"])) for r in got], key=repr) == brute_bytes(rows, 100)


def test_rows_alike_without_ids_and_long_texts(make_docs, monkeypatch):
    monkeypatch.setattr("tarnflow.llm.suffixes.PIECE", 1000)
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = [(None, long[:300])] * 300 + [(None, "short")] * 300 + [(1, long), (2, long[2000:3300] + "x" + long[:150])]
    got = repeated_bytes(make_docs(rows)).collect()
    assert sorted([(*r[:5], tuple(r["spans"])) for r in got], key=repr) == brute_bytes(rows, 200)


def test_no_texts(make_docs):
    assert repeated_bytes(make_docs([])).count() == 0
    with pytest.raises(ValueError):
        repeated_bytes(make_docs([]), 20, 30)


def test_multikey_quicksort_sorts():
    rng = np.random.default_rng(0)
    for n, kinds, length in ((0, 2, 9), (1, 2, 9), (500, 2, 40), (3000, 3, 20), (300, 200, 200)):
        strings = [rng.integers(1, kinds + 1, rng.integers(0, length + 1)).astype(np.uint8).tobytes() for _ in range(n)]
        order = multikey_quicksort(packed(strings, length)) if n else []
        assert [strings[i] for i in order] == sorted(strings)
    classes = Classes([b"abc", b"abd", b"x", b"abc"], 3)
    assert [len(set(classes.at(d).tolist())) for d in range(4)] == [1, 2, 2, 3]


# -- manifest --


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def tree(nodes):
        levels = [nodes]
        while len(nodes) > 1:
            nodes = [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
            levels.append(nodes)
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            a = i // 8 * 8
            out.append((level[a:i], level[i + 1 : a + 8]))
            i //= 8
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    of = {x: sorted([r for r in rows if r[2] == x], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tree([leaf(r) for r in of[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, r in enumerate(of[x]):
            way = siblings(trees[x], i) + siblings(top, k)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4]
            now = leaf((*r[:4], text))
            for a, b in way:
                now = sha("".join(a) + now + "".join(b))
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in way)), now, now == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("case", ["many", "one language", "one row", "many languages", "parts"])
def test_manifest_equals_brute_force(spark, case, monkeypatch):
    rng = random.Random(1)
    row = lambda k, lang: (k, rng.choice(["web", None, "é"]), lang, rng.choice([None, 5]), rng.choice([None, "", "Ab c", "no capitals", "É" * 50]))
    rows = {
        "many": lambda: [row(rng.choice([None, k]), rng.choice(["en", "en", "de", None, "", "é"])) for k in range(700)] + [(3, "a", "en", 1, "same")] * 9,
        "one language": lambda: [row(k, "en") for k in range(65)],
        "one row": lambda: [row(0, None)],
        "many languages": lambda: [row(k, f"l{k % 90}") for k in range(200)],
        "parts": lambda: [row(k, "en" if k % 10 else "de") for k in range(3000)],
    }[case]()
    if case == "parts":
        monkeypatch.setattr("tarnflow.llm.merkle.PART_ROWS", 40)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "1 as idx", "'x' as tree", "2 as part")
    got = manifest(docs, F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute_manifest(rows)


def test_manifest_of_nothing(spark):
    assert manifest(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


# -- sessions --


def brute_versions(events, gap):
    """events: (user, at, batch, total)."""
    out = []
    for user in {e[0] for e in events}:
        own = [e[1:] for e in events if e[0] == user]
        standing, versions = [], []
        for batch in sorted({e[1] for e in own}):
            sessions = []
            for e in sorted(e for e in own if e[1] <= batch):
                if sessions and e[0] - sessions[-1][-1][0] <= gap:
                    sessions[-1].append(e)
                else:
                    sessions.append([e])
            for s in sessions:
                new = sum(e[1] == batch for e in s)
                if new:
                    inside = [k for k in standing if versions[k][2] >= s[0][0] and versions[k][3] <= s[-1][0]]
                    for k in inside:
                        versions[k][8:] = [batch, s[0][0]]
                        standing.remove(k)
                    standing.append(len(versions))
                    versions.append([user, batch, s[0][0], s[-1][0], len(s), new, len(inside), sum(e[2] or 0 for e in s), None, None])
        out += map(tuple, versions)
    return sorted(out, key=repr)


@pytest.mark.parametrize(("gap", "cell"), [(420, 21600), (10, 10), (0, 7), (50, 100)])
def test_session_versions_equal_brute_force(spark, gap, cell):
    rng = random.Random(gap)
    spread = lambda: rng.randrange(-500, rng.choice([100, 3000, 40_000]) + 1)
    events = [(rng.choice([1, 2, 2, 2, 3, 10**12]), spread(), rng.randrange(12), rng.randrange(100)) for _ in range(1500)]
    events += [(5, 7 * i, i % 5, 1) for i in range(400)] + [(6, 100, 3, None)] * 50 + [(7, i, 100 - i, 2**32) for i in range(100)]
    df = spark.createDataFrame(events + [(None, 1, 1, 1), (1, None, 1, 1), (1, 1, None, 1)], "user long, at long, batch long, total long").selectExpr("*", "1 as unit", "2 as cell", "3 as n")
    assert sorted([tuple(r) for r in session_versions(df, gap, cell).collect()], key=repr) == brute_versions(events, gap)


def test_versions_of_a_unit_equal_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        events = [(1, rng.randrange(200), rng.randrange(8), 1) for _ in range(rng.randrange(1, 60))]
        rows = sorted((b, a, a, 1, t) for _, a, b, t in events)
        assert sorted([(1, *v) for v in unit_versions(rows, 6)], key=repr) == brute_versions(events, 6)


def test_long_session_takes_time_in_proportion():
    """Points in order, and in reverse, of one session: the search outward may not walk the session."""
    tree, seen = ActiveEvents(10), 0
    update = tree._update
    def counted(x):
        nonlocal seen
        seen += 1
        update(x)
    tree._update = counted
    for k in [*range(0, 20_000, 2), *range(19_999, 0, -2)]:
        tree.insert(k, k, 1, 1)
        assert tree.session(k)[0] == 0
    assert seen < 60 * 20_000


def test_no_events(spark):
    assert session_versions(spark.createDataFrame([], "user long, at long, batch long, total long")).count() == 0
    rows = spark.createDataFrame([(None, 1), (1, None)], "conv_id long, turn long")
    assert session_versions(conversation_events(rows)).count() == 0
