import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tarnflow.llm.substring import FMIndex, RunLengths, repeated_words


def brute(rows, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_index_counts_as_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(40):
        depth = int(rng.integers(1, 40))
        texts = [rng.integers(1, 3, rng.integers(depth, 2 * depth + 3)) for _ in range(rng.integers(1, 10))]
        weights = rng.integers(1, 3, len(texts))
        text = np.concatenate([np.append(t, 0) for t in texts])
        lens = np.array([len(t) for t in texts])
        seen = Counter()
        for t, w in zip(texts, weights, strict=True):
            for i in range(len(t) - depth + 1):
                seen[tuple(t[i : i + depth])] += w
        index = FMIndex(text, np.repeat(weights, lens + 1), depth)
        for t, got in zip(texts, index.repeats(text, np.cumsum(lens + 1) - lens - 1, lens), strict=True):
            assert [i for i in range(len(t) - depth + 1) if seen[tuple(t[i : i + depth])] > 1] == list(got)


def test_ranks_of_runs_equal_brute_force():
    rng = np.random.default_rng(1)
    for n, sigma in ((0, 1), (1, 1), (5, 1), (300, 2), (2000, 70), (4000, 3)):
        sequence = np.repeat(rng.integers(0, sigma, n), rng.integers(1, 9, n))[:n]
        runs = RunLengths(sequence, sigma)
        for symbol in range(sigma):
            at = np.arange(n + 1)
            want = (sequence < symbol).sum() + np.concatenate([[0], np.cumsum(sequence == symbol)])
            assert (runs.rank(np.full(n + 1, symbol), at) == want).all()


def test_index_grows_with_what_is_new_not_with_copies():
    rng = np.random.default_rng(2)
    one = np.append(rng.integers(1, 1000, 500), 0)
    size = lambda k: FMIndex(np.tile(one, k), np.ones(501 * k, np.int64), 35).nbytes
    assert size(64) < 3 * size(1)


def corpus(window):
    rng = random.Random(7)
    vocabulary = [f"w{i}é" for i in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = [make(window + k) for k in (0, 1, 5, 40)]
    rows = []
    for k in range(60):
        text = make(rng.randrange(0, 80))
        for p in rng.sample(shared, rng.randrange(0, 3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = p
        rows.append((k, rng.choice([" ", "\n", " \t "]).join(text)))
    rows += [(100, " ".join(["same"] * (window + 3))), (101, " ".join(["same"] * (window - 1))), (102, None), (103, ""), (104, "  \x0b "), (None, " ".join(shared[0])), (7, "repeated id"), (7, "repeated id")]
    rows += [(200 + i, " ".join(shared[3])) for i in range(20)]
    rows += [(300, " ".join(make(20000))), (301, "x" * 5000 + " " + "y z " * 50)]
    return rows


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (6, 2), (5, 5), (3, 1)])
def test_removed_words_equal_brute_force(make_docs, window, gram):
    rows = corpus(window)
    got = repeated_words(make_docs(rows), window, gram).collect()
    assert sorted([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got], key=repr) == brute(rows, window)


def test_no_rows(make_docs):
    assert repeated_words(make_docs([])).count() == 0


def test_settings_are_checked(make_docs):
    with pytest.raises(ValueError):
        repeated_words(make_docs([]), 5, 6)
    with pytest.raises(ValueError):
        repeated_words(make_docs([]), 300, 5)
