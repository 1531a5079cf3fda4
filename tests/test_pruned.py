import random

import pytest

from tarnflow.operators.pruned import posting_blocks, pruned_top

POST = "doc long, token_id long, weight double"
ASK = "query_id long, token_id long, weight double"


def brute(queries, rows, k):
    out = []
    for q in sorted({x[0] for x in queries}):
        scores = {}
        for _, t, w in (x for x in queries if x[0] == q):
            for d, u, v in rows:
                if t == u:
                    scores[d] = scores.get(d, 0) + w * v
        out += [(q, d, s, n) for n, (d, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return out


@pytest.mark.parametrize(("k", "span"), [(3, 4), (10, 1), (500, 32)])
def test_same_rows_as_all_postings(spark, k, span):
    rng = random.Random(k)
    rows = [(d, t, float(rng.randrange(1, 5))) for d in range(300) for t in rng.sample(range(60), rng.randrange(1, 8))]
    rows += [(1000 + d, 7, 9.0) for d in range(40)]  # ties
    queries = [(q, t, float(rng.randrange(1, 3))) for q in range(8) for t in rng.sample(range(70), 4)] + [(99, 12345, 1.0)]
    odd = [(None, 7, 1.0), (5, None, 1.0), (6, 7, None)]
    index = posting_blocks(spark.createDataFrame(rows + odd, POST).selectExpr("*", "1 as block"), "doc", span)
    got, report = pruned_top(spark.createDataFrame(queries + [(1, None, 1.0), (None, 7, 1.0)], ASK).selectExpr("*", "1 as _w"), index, k)
    assert sorted(map(tuple, got.collect())) == sorted(brute(queries, rows, k))
    assert all(r["read"] <= r["blocks"] for r in report.collect())


def test_blocks_that_cannot_win_are_not_read(spark):
    rows = [(d, t, 1.0) for d in range(2000) for t in (1, 2)] + [(d, 3, 50.0) for d in range(5)]
    index = posting_blocks(spark.createDataFrame(rows, POST), "doc")
    got, report = pruned_top(spark.createDataFrame([(1, 1, 1.0), (1, 3, 1.0)], ASK), index, 5)
    assert sorted(r["doc"] for r in got.collect()) == [0, 1, 2, 3, 4]
    (row,) = report.collect()
    assert row["blocks"] >= 55 and row["read"] <= 5


def test_empty(spark):
    index = posting_blocks(spark.createDataFrame([], POST), "doc")
    got, report = pruned_top(spark.createDataFrame([(1, 1, 1.0)], ASK), index, 5)
    assert got.count() == report.count() == 0
    with pytest.raises(ValueError):
        pruned_top(spark.createDataFrame([], ASK), index, 0)
