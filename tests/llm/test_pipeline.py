import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_minhash import brute as brute_components
from test_pages_and_search import brute_containment
from test_substring import brute as brute_repeats

import corpus_pipeline
from tarnflow.llm.tokens import encoder


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    rows, labels = [], []
    shared, item = make(50), make(30)
    for i in range(240):
        text = make(rng.randrange(5, 200))
        if i % 6 == 0:
            text[3:3] = ["vile", "rude"]
        elif i % 7 == 0:
            text[2:2] = shared
        elif i % 11 == 0:
            text[1:1] = item
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 6 == 0)))
    rows += [(1000 + i, rows[1][1]) for i in range(5)] + [(1100, rows[2][1] + " extra"), (1200, ""), (1201, None)]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "k1": F.lit(3), "kept": F.lit("k")})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, " ".join(item)), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, " ".join(item)


def test_stages_follow_the_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "substring_repeats", "decontamination", "best_fit_packing"]


def test_pipeline_equals_brute_force(spark, folder):
    path, rows, item = folder
    got = corpus_pipeline.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, path)
    assert kept.columns == docs.columns
    clean = {r["doc_id"] for r in kept.select("doc_id").collect()}
    truth = {i for i, t in rows if "vile" not in (t or "")}
    assert len(clean ^ truth) <= 0.03 * len(rows)
    left = [(i, t) for i, t in rows if i in clean]
    groups = {d: c for d, _, c in brute_components(left)}
    left = [(i, t) for i, t in left if groups[i] == i]
    removed = {d: n for d, _, n, _ in brute_repeats(left, 35)}
    left = [(i, _without_repeats(left, t, removed[i])) for i, t in left]
    leaks = {d for d, *_ in brute_containment(left, [(0, item)])}
    left = [(i, t) for i, t in left if i not in leaks]
    encode = encoder(corpus_pipeline.TOKENIZER)
    wanted = []
    for i, t in left:
        ids = np.append(encode(t or ""), np.uint32(2)).astype("<u4")
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        wanted += [(i, k, zlib.crc32(ids[a:z].tobytes())) for k, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == sorted(wanted)


def _without_repeats(rows, text, removed):
    if not removed:
        return text
    words = [(t or "").split() for _, t in rows]
    seen = {}
    for w in words:
        for k in range(len(w) - 34):
            seen[tuple(w[k : k + 35])] = seen.get(tuple(w[k : k + 35]), 0) + 1
    own = text.split()
    gone = {j for k in range(len(own) - 34) if seen[tuple(own[k : k + 35])] > 1 for j in range(k, k + 35)}
    return " ".join(x for j, x in enumerate(own) if j not in gone)


def test_stages_keep_columns_and_take_odd_tables(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), path)
        assert none.columns == docs.columns and none.count() == 0
        odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None), (1, None), (1, None), (2, "")], "doc_id long, text string"), allowMissingColumns=True)
        out = stage(spark, odd, path)
        assert out.schema.names == docs.columns and out.count() >= 3


def test_decisions_are_by_row_not_by_doc_id(spark, folder):
    path, rows, item = folder
    rng = random.Random(3)
    a, b, c = (" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(3))
    own = [(1, a), (3, a), (3, b), (None, c), (None, c), (7, c), (None, f"{b} {item}"), (8, f"x {item} y"), (8, "z " + " ".join(reversed(a.split())))]
    docs = spark.createDataFrame(own, "doc_id long, text string")
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0).unionByName(docs, allowMissingColumns=True)
    read = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    assert read(corpus_pipeline.drop_near_duplicates(spark, docs, path)) == sorted([(1, a), (3, b), (7, c), *own[6:]], key=repr)
    assert read(corpus_pipeline.drop_contaminated(spark, docs, path)) == sorted([*own[:6], own[8]], key=repr)
    more = spark.createDataFrame([(None, "vile " * 3 + "w1 w2 rude"), (2005, "vile rude w3 vile"), (2005, "w4 w5 w6")], "doc_id long, text string")
    toxic = spark.read.parquet(f"{path}/documents.parquet").unionByName(more, allowMissingColumns=True)
    assert read(corpus_pipeline.drop_toxic(spark, toxic, path).where("coalesce(doc_id, 2005) = 2005")) == [(2005, "w4 w5 w6")]


def test_pack_takes_empty_and_odd_tables(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert corpus_pipeline.pack(spark, docs.limit(0), path).count() == 0
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, None), (1, None), (1, None), (2, "w " * 30_000)], "doc_id long, text string"), allowMissingColumns=True)
    out = corpus_pipeline.pack(spark, odd, path).collect()
    assert sum(r["length"] == 1 for r in out) >= 3 and sum(r["length"] for r in out if r["doc_id"] == 2) > 30_000
    assert corpus_pipeline.run(spark, path).count() > 0
