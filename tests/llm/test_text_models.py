import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import suffix_tree, toxicity
from tarnflow.llm.words import U, find_words, shingles, slices, text_buffers

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def held(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == 2


def test_words_are_those_of_the_pattern():
    texts = ["", None, "Ab  cD\nx", "   ", "é Zz\x0b1", "a" * 300, "x\x00y \xa0z", "abcdefgh abcdefghi abcdefgh"]
    data, offsets = text_buffers(pa.array(texts))
    seen = {}
    for lo, hi in slices(offsets, 5):
        w = find_words(data, offsets[lo : hi + 1], lower=True)
        for k in range(lo, hi):
            own = [w.data[a:z].tobytes() for a, z, t in zip(w.starts, w.ends, w.text, strict=True) if t == k - lo]
            assert own == [x.encode().translate(LOWER) for x in re.findall(r"[^\x20\x09-\x0D]+", texts[k] or "")]
        for a, z, h in zip(w.starts, w.ends, w.hashes, strict=True):
            assert seen.setdefault(w.data[a:z].tobytes(), h) == h
    assert len(set(seen.values())) == len(seen)


def test_shingles_stay_within_texts():
    data, offsets = text_buffers(pa.array(["a b c", "a b", "b c a b c"]))
    w = find_words(data, offsets)
    h, first = shingles(w, 3)
    assert list(w.text[first]) == [0, 2, 2, 2] and h[0] == h[3] and len(set(h)) == 3


# -- suffix tree --


def tree_of(texts, **limits):
    depth = limits.get("depth", 3)
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = list(suffix_tree._grams(depth)(iter([batch])))
    keys, counts = suffix_tree._summed(np.concatenate([x.column(0).to_numpy() for x in out]).view(U), np.concatenate([x.column(1).to_numpy() for x in out]))
    return suffix_tree.Tree(keys, counts, **limits), keys, counts


def norm(text):
    return b" " + b" ".join((text or "").encode().translate(LOWER).split()) + b"\0"


def brute_score(texts, text, depth):
    """Witten-Bell over all contexts that training texts hold."""
    counts = [{} for _ in range(depth + 1)]
    for t in texts:
        s = norm(t)
        for i in range(1, len(s)):
            for k in range(min(depth, i) + 1):
                own = counts[k].setdefault(s[i - k : i], {})
                own[s[i]] = own.get(s[i], 0) + 1
    s, total = norm(text), 0.0
    for i in range(1, len(s)):
        p = 1 / 257
        for k in range(min(depth, i) + 1):
            own = counts[k].get(s[i - k : i])
            if own is None:
                break
            p = (own.get(s[i], 0) + len(own) * p) / (sum(own.values()) + len(own))
        total += math.log10(p)
    return total


def test_tree_with_all_contexts_equals_brute_force():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 4))) for _ in range(30)) for _ in range(20)]
    tree, _, _ = tree_of(texts, depth=3, least=1, divergence=-1e9, most=10**6)
    for text in [texts[0], "abc cab", "", "zzz abc", "A  b", "c" * 700]:
        data, offsets = text_buffers(pa.array([text, "other"]))
        stream, bounds = suffix_tree.symbols(data, offsets)
        for piece in (256, 7):
            assert math.isclose(tree.scores(stream, bounds, piece)[0], brute_score(texts, text, 3), rel_tol=1e-5)


def test_divergence_prunes_contexts():
    texts = ["ab" * 200 + " " + "cd" * 200] * 3
    full, _, _ = tree_of(texts, depth=3, least=1, divergence=-1e9, most=10**6)
    small, _, _ = tree_of(texts, depth=3, least=10, divergence=5.0, most=4)
    assert small.states < full.states


def test_probabilities_sum_to_one():
    tree, _, _ = tree_of(["abc abd", "bcd"], depth=2, least=1, divergence=-1e9, most=1000)
    p = 10 ** tree.logp.reshape(tree.states, tree.width).astype(float)
    rest = 257 - (tree.width - 2)
    assert np.allclose(p[:, : tree.width - 2].sum(1) + rest * p[:, tree.width - 2], 1, atol=1e-5)


def test_corpus_scores(make_docs):
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "Delta", "epsilon"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(300)] + [(1000, None), (1001, ""), (None, "alpha beta"), (5, "alpha"), (1003, "unseen " * 50), (1004, "x" * 30000)]
    got = {(r["doc_id"], r["n_tokens"]): r for r in suffix_tree.corpus_scores(make_docs(rows)).collect()}
    assert len(suffix_tree.corpus_scores(make_docs(rows)).collect()) == len(rows)
    counts, ends = {}, 0
    for d, t in rows:
        if not held(d, 7):
            ends += 1
            for w in norm(t)[1:-1].split():
                counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    for d, t in rows:
        own = norm(t)[1:-1].split()
        r = got[d, len(own) + 1]
        assert r["held_out"] == held(d, 7) and r["train_tokens"] == total
        assert r["n_known"] == sum(w in counts for w in own) + 1
        base = sum(math.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in own) + math.log10((ends + 1) / (total + kinds + 1))
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    unseen = [r for r in got.values() if r["held_out"] and r["n_tokens"] > 10]
    assert unseen and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def test_scores_without_rows(make_docs):
    assert suffix_tree.corpus_scores(make_docs([])).count() == 0
    only = [(next(i for i in range(100) if held(i, 7)), "a b")]
    row = suffix_tree.corpus_scores(make_docs(only)).first()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and row["score"] < 0


def test_all_contexts_that_pass_are_kept(make_docs):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(9)) for _ in range(12000)]
    rows = [(i, " ".join(w for w in words[i * 30 : i * 30 + 30] for _ in range(8))) for i in range(400)]
    tree, _, _ = tree_of([t for i, t in rows if not held(i, 7)], depth=5, most=10**9)
    assert tree.states > 60_000
    stream, bounds = suffix_tree.symbols(*text_buffers(pa.array([t for _, t in rows])))
    one, two = ({r["doc_id"]: r["score"] for r in suffix_tree.corpus_scores(make_docs(rows), model_bytes=limit).collect()} for limit in (suffix_tree.MODEL_BYTES, 0))
    assert one == two  # broadcast and by buckets: to the last bit
    for (i, _), score in zip(rows, tree.scores(stream, bounds), strict=True):
        assert math.isclose(one[i], score, rel_tol=1e-5)


@pytest.mark.parametrize("limit", [suffix_tree.MODEL_BYTES, 0])
def test_scores_of_the_query_equal_brute_force(make_docs, limit):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abCé") for _ in range(rng.randint(1, 4))) for _ in range(25))) for i in range(40)] + [(90, None), (91, ""), (92, "zz a"), (None, "b b")]
    train = [t or "" for i, t in rows if not held(i, 7)]
    got = {r["doc_id"]: r["score"] for r in suffix_tree.corpus_scores(make_docs(rows), depth=3, least=1, divergence=-1e9, model_bytes=limit).collect()}
    for i, t in rows:
        assert math.isclose(got[i], brute_score(train, t or "", 3), rel_tol=1e-5)


# -- toxicity --


def toxic_corpus(n=900):
    rng = random.Random(9)
    make = lambda: "".join(rng.choice(["an", "er", "st", "io", "le"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        text = [make() for _ in range(rng.choice([10, 60, 400]))]
        bad = rng.random() < 0.15
        for _ in range(rng.randint(2, 4) if bad else 0):
            text.insert(rng.randrange(len(text) + 1), rng.choice(["Vile,", "vilest", "vilex" + make(), "RUDE!"]))
        rows.append((i, " ".join(text)))
        if i % 5:
            labels.append((i, int(bad)))
    return rows, labels, {i: "vil" in t.lower() or "RUDE" in t for i, t in rows}


def test_held_out_toxicity(spark, make_docs):
    rows, labels, truth = toxic_corpus()
    extra = [(5000, None), (5001, ""), (None, "plain"), (5002, "vilest rude vile " * 4000), (7, "anst"), (7, "anst")]
    scored = toxicity.toxicity(make_docs(rows + extra), spark.createDataFrame(labels + [(1, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(scored) == len(rows) + len(extra)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == held(r["doc_id"], 4) for r in scored)
    test = [r for r in scored if r["held_out"] and r["doc_id"] in truth and r["doc_id"] != 7]
    hit = sum(bool(r["predicted"]) == truth[r["doc_id"]] for r in test)
    assert hit / len(test) > 0.95
    by_id = {r["doc_id"]: r for r in scored if r["doc_id"] is not None and r["doc_id"] >= 5000}
    assert by_id[5002]["predicted"] == 1 and by_id[5000]["predicted"] == by_id[5001]["predicted"] == 0


def test_labels_of_held_out_rows_change_nothing(spark, make_docs):
    rows, labels, _ = toxic_corpus(300)
    other = [(i, 1 - t if held(i, 4) else t) for i, t in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(make_docs(rows), spark.createDataFrame(x, "doc_id long, toxic int")).collect()) for x in (labels, other))
    assert a == b


@pytest.mark.parametrize("labels", [[], [(1, 0), (3, 0)], [(1, 1)]])
def test_one_class_or_none(spark, make_docs, labels):
    got = toxicity.toxicity(make_docs([(1, "a b"), (2, None), (3, "c")]), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert got.count() == 3 and got.where(F.col("score").isNull()).count() == 0


def test_no_documents(spark, make_docs):
    assert toxicity.toxicity(make_docs([]), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
