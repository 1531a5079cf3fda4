import random
import re

from pyspark.sql import functions as F

from tarnflow.llm.components import components
from tarnflow.llm.minhash import near_duplicates

LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(6):  # chains: each text is a small change of the one before
        text = [rng.choice(words) for _ in range(120)]
        for _ in range(12):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randint(1, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
    rows += ["a b c", "A  b\tC", "a b d", "", "  \n", None, "one", "x y z w v u " * 3000, "x y z w v u " * 3001]
    rows += ["same text of some more words here"] * 25
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_components_equal_brute_force(make_docs):
    rows = corpus() + [(None, "one"), (None, "alone"), (3, "repeated id with other text"), (3, "repeated id with other text")]
    got = near_duplicates(make_docs(rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    assert all(r["kept"] == (r["doc_id"] is not None and r["doc_id"] == r["component_id"]) for r in got)


def test_no_rows(make_docs):
    assert near_duplicates(make_docs([])).count() == 0


def test_stars_find_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 80)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    least = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert got == least


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_result_has_the_promised_types(make_docs):
    got = near_duplicates(make_docs([(1, "a b c d e f"), (2, "a b c d e f")])).select("doc_id", "n_shingles", "component_id", "kept")
    assert got.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert got.where(F.col("kept")).count() == 1
